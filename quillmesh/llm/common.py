"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a local session names no shared folder (tests, a laptop), lineage is cut in a folder of this process.
_own_dir: list[str] = []
#: What cut() has written and nothing has released: path -> session.
_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="quillmesh-"))
    return _own_dir[0]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there and a lost executor loses nothing.

    The table goes when release() is called on what this returns, or else when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmesh/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of cut() on which nothing depends any more but what has been written again."""
    for x in tables:
        path = getattr(x, "_written", None)
        if path in _written:
            _delete(_written.pop(path), path)


def _at(spark: SparkSession, path: str) -> tuple:
    """The store of a path, and the path in it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    store, at = _at(spark, path)
    store.delete(at, True)


@atexit.register
def _release_all() -> None:
    for path, spark in _written.items():
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(spark, path)
    for path in _own_dir:
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def private(*tables: DataFrame, stem: str = "_own") -> str:
    """A column name that none of these tables has, in any case of letters."""
    taken = {c.lower() for t in tables for c in t.columns}
    return next(x for i in itertools.count() if (x := f"{stem}{i}") not in taken)


#: The most rows of a narrow table (a few numbers each), and bytes of its files, that are broadcast; larger ones are shuffled.
SMALL_ROWS, SMALL_BYTES = 400_000, 16 << 20


def small(table_: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """table_, which was written by cut(), marked for broadcast if its counted rows and the bytes of its files are few enough."""
    path = getattr(table_, "_written", None)
    if path in _written:
        store, at = _at(_written[path], path)
        if store.getContentSummary(at).getLength() > size:
            return table_
    return F.broadcast(table_) if table_.count() <= rows else table_


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of doc_id as text, mod modulus; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def with_group_min(df: DataFrame, key: str, value: str, out: str, count: str, salts: int | None = None) -> DataFrame:
    """df plus the least `value` and the number of rows of its `key`, with no task holding all rows of a hot key.

    Rows are grouped by (key, salt) with map-side combine, the at most `salts` partial rows of a key are
    combined, and each partial row gets the result back; rows then join on (key, salt). A key with a third of
    all rows is thus spread over `salts` join keys. `value` is also the source of the salt.
    """
    salts = salts or max(64, partitions(df.sparkSession))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(value)), F.lit(salts)).cast("int"))
    part = salted.groupBy(key, "_salt").agg(F.min(value).alias("_m"), F.count(F.lit(1)).alias("_n"))
    whole = part.groupBy(key).agg(F.min("_m").alias(out), F.sum("_n").alias(count), F.collect_list("_salt").alias("_salts"))
    back = whole.select(key, out, count, F.explode("_salts").alias("_salt"))
    return salted.join(back, [key, "_salt"]).drop("_salt")
