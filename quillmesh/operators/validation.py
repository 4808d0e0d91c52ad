"""Checks as queries: each rule yields rows (rule, severity, qid, item, detail) of what it found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import word_count

# Fixed values of the result format.
N_DOCUMENTS, N_FRAGMENTS, MAX_WORDS, FEW_WORDS = 3, 10, 250, 10
REQUIRED = ("chunk_id", "doc_id", "fuente", "formato", "fenomeno", "posicion", "texto", "num_tokens")


def _found(df: DataFrame, rule: str, severity: str, where: Column, item: Column, detail: Column) -> DataFrame:
    return df.where(where).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("query_id").alias("qid"), item.cast("string").alias("item"), detail.cast("string").alias("detail"))


def result_violations(results: DataFrame, n_expected: int) -> DataFrame:
    """results: query_id, documents array<struct<rank, doc_id>>, fragments array<struct<rank, chunk_id, doc_id, text>>."""
    none = F.lit(None).cast("string")
    docs = results.select("query_id", F.posexplode("documents").alias("_p", "_x"))
    frags = results.select("query_id", F.posexplode("fragments").alias("_p", "_x"))
    n = word_count(F.col("_x.text"))
    per_id = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    total = results.agg(F.count(F.lit(1)).alias("_n"), F.lit(None).cast(dict(results.dtypes)["query_id"]).alias("query_id"))
    one = F.size(F.array_distinct(F.transform("fragments", lambda f: f["doc_id"]))) == 1
    checks = [
        _found(total, "line_count", "error", F.col("_n") != n_expected, none, F.col("_n")),
        _found(results, "document_count", "error", F.size("documents") != N_DOCUMENTS, none, F.size("documents")),
        _found(results, "fragment_count", "error", F.size("fragments") != N_FRAGMENTS, none, F.size("fragments")),
        _found(docs, "document_rank", "error", F.col("_x.rank") != F.col("_p") + 1, F.col("_p") + 1, F.col("_x.rank")),
        _found(frags, "fragment_rank", "error", F.col("_x.rank") != F.col("_p") + 1, F.col("_p") + 1, F.col("_x.rank")),
        _found(frags, "fragment_too_long", "error", n > MAX_WORDS, F.col("_p") + 1, n),
        _found(frags, "fragment_short", "warning", n < FEW_WORDS, F.col("_p") + 1, n),
        _found(results, "one_document", "warning", one, none, F.size("fragments")),
        _found(per_id, "repeated_query", "error", F.col("_n") > 1, none, F.col("_n")),
    ]
    return reduce(DataFrame.unionAll, checks)


def metadata_violations(metadata: DataFrame, vectors: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """rule, detail: missing fields, repeated chunk ids, and rows without a vector or vectors without a row."""
    spark = metadata.sparkSession
    gone = [c for c in required if c not in metadata.columns]
    fields = spark.createDataFrame([("missing_field", c) for c in gone], "rule string, detail string")
    empty = [metadata.agg(F.count_if(F.col(c).isNull()).alias("_n")).where("_n > 0").select(F.lit("null_field").alias("rule"), F.concat(F.lit(c + ": "), F.col("_n").cast("string")).alias("detail")) for c in required if c in metadata.columns]
    twice = metadata.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.lit("repeated_chunk").alias("rule"), F.col("chunk_id").cast("string").alias("detail"))
    rowless = vectors.join(metadata, "row_id", "left_anti").select(F.lit("vector_without_row").alias("rule"), F.col("row_id").cast("string").alias("detail"))
    bare = metadata.join(vectors, "row_id", "left_anti").select(F.lit("row_without_vector").alias("rule"), F.col("row_id").cast("string").alias("detail"))
    return reduce(DataFrame.unionAll, [fields, *empty, twice, rowless, bare])


def completeness(chunks: DataFrame, every: int = 1) -> DataFrame:
    """Share of chunks that end at a sentence end, in a deterministic sample."""
    x = chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(every)) == 0)
    return x.agg(F.count(F.lit(1)).alias("n"), F.avg(F.trim("text").rlike("[.!?…»\"')\\]][\\d\\s]*$").cast("int")).alias("complete"))


def evidence_ratio(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("n"), F.avg((F.size("evidence") > 0).cast("int")).alias("with_evidence"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Queries whose documents or fragments differ between two result tables, or that only one of them has."""
    ids = lambda c, f: F.transform(c, lambda x: x[f])
    a = left.select("query_id", ids("documents", "doc_id").alias("_d"), ids("fragments", "chunk_id").alias("_f"))
    b = right.select("query_id", ids("documents", "doc_id").alias("_e"), ids("fragments", "chunk_id").alias("_g"))
    x = a.join(b, "query_id", "full")
    return x.select("query_id", (~F.col("_d").eqNullSafe(F.col("_e"))).alias("documents_differ"), (~F.col("_f").eqNullSafe(F.col("_g"))).alias("fragments_differ")).where("documents_differ or fragments_differ")
