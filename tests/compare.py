"""Runs queries beside their SQL in DuckDB and compares the rows: python tests/compare.py SF_DIR [NAME ...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "isoformat"):
        return str(x)
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> tuple[bool, str]:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    want = rows_of(names, got.fetchall())
    have = rows_of(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    if have == want:
        return True, f"{len(have)} rows"
    only = [r for r in have if r not in set(want)][:2], [r for r in want if r not in set(have)][:2]
    return False, f"{len(have)} rows against {len(want)}: {str(only)[:700]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(sys.argv[1]), entry.oracle_sql()
    names = sys.argv[2:] or [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]
    for name in names:
        began = time.time()
        try:
            df = entry.queries()[name](spark, sys.argv[1])
            ok, said = compare(df, con, sqls[name]) if name in sqls else (None, f"{df.count()} rows, no SQL")
        except Exception:
            ok, said = False, traceback.format_exc()[-900:]
        print({True: "ok  ", False: "FAIL", None: "rows"}[ok], name, f"{time.time() - began:.1f}s", said, flush=True)
