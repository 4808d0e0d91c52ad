"""Queries by name, each with the SQL that answers the same where SQL can express it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


#: The temporary folder of this process, if it needed one.
_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; on a local master, where that is unset, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or (_own[0] if _own else None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own.append(shared := "file://" + tempfile.mkdtemp(prefix="quillmesh-"))
        atexit.register(shutil.rmtree, shared.removeprefix("file://"), ignore_errors=True)
    return f"{shared.rstrip('/')}/quillmesh/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the scratch folder: what several branches of a plan need is made once, and its lineage ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(table: DataFrame) -> None:
    """Deletes a table of written() on which nothing depends any more."""
    if path := getattr(table, "_written", None):
        sc = table.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


#: Tables whose rows are costly to work on: long texts, markup.
TEXTS = ("documents", "pages", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Texts in fewer files or row groups than there are cores are dealt out, or one core would do all the work."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df
