"""Incremental ingestion: new documents are chunked and encoded as they come; changed ones replace their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmesh.operators.chunking import chunk
from quillmesh.operators.encoders import Encoder, encode


def chunk_vectors(docs: DataFrame, encoder: Encoder) -> DataFrame:
    """docs (doc_id, text, ...) -> chunks with a vector and a hash of the encoded text. No shuffle."""
    return encode(chunk(docs), encoder, "embed_text").withColumn("text_hash", F.xxhash64("embed_text"))


def start(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, encoder: Encoder, once: bool = True) -> StreamingQuery:
    """Parquet files that appear in source are appended to target, in one folder for each batch.

    A batch's folder is overwritten if the batch is run again, so a restart after a lost driver writes nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunk_vectors(batch, encoder).withColumn("arrived", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def latest(table: DataFrame) -> DataFrame:
    """The chunks of the last batch in which each document came."""
    newest = F.max("arrived").over(W.partitionBy("doc_id"))
    return table.withColumn("_new", newest).where(F.col("arrived") == F.col("_new")).drop("_new")


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of an event stream (or table) in tumbling windows, late events up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
