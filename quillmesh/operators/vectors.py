"""Vectors: normalisation, exact top-k, centroids, similarity joins, verification and incremental upserts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Query vectors that one pass holds on each worker.
QUERY_BLOCK = 4096
#: Vectors in a block of the similarity self-join.
PAIR_BLOCK = 4096


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, as_double(v)).otherwise(F.transform(as_double(v), lambda x: x / n))


def build_index(vectors: DataFrame, vec: str = "v") -> DataFrame:
    """The index is the table itself, of unit vectors: search is an exact scan."""
    return vectors.withColumn(vec, normalised(F.col(vec)))


def top_k(queries: DataFrame, vectors: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """queries (qid, v), vectors (row_id, v) -> qid, row_id, score, rnk: the k greatest inner products, ties by row_id.

    Queries are held in blocks of bounded size, each against one scan; a batch of vectors is scored by a matrix
    product and keeps its own k best, so the ranking shuffles k rows for each query and batch and no more.
    """
    spark = vectors.sparkSession
    rows = sorted((r["qid"], r["v"]) for r in queries.select("qid", "v").collect())
    schema = f"qid {dict(queries.dtypes)['qid']}, row_id {dict(vectors.dtypes)['row_id']}, score double"
    parts = []
    for at in range(0, len(rows), block):
        ids = [q for q, _ in rows[at : at + block]]
        held = spark.sparkContext.broadcast(np.array([v for _, v in rows[at : at + block]], np.float64))

        def score(batches: Iterator[pd.DataFrame], ids=ids, held=held) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                v = np.array(batch["v"].tolist(), np.float64)
                s, own = v @ held.value.T, batch["row_id"].to_numpy()
                for j, q in enumerate(ids):
                    best = np.lexsort((own, -s[:, j]))[:k]
                    yield pd.DataFrame({"qid": q, "row_id": own[best], "score": s[best, j]})

        parts.append(vectors.select("row_id", "v").mapInPandas(score, schema))
    if not parts:
        return spark.createDataFrame([], schema + ", rnk int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    return ranked(found, "qid", "row_id").where(F.col("rnk") <= k)


def ranked(scored: DataFrame, group: str, tie: str, score: str = "score") -> DataFrame:
    """scored with rnk from 1: by score downwards, ties by the other column."""
    return scored.withColumn("rnk", F.row_number().over(W.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie))))


def centroids(vectors: DataFrame, group: str, vec: str = "v") -> DataFrame:
    """group, v: means of members, of unit length. Means are taken by position with map-side combine."""
    mean = vectors.select(group, F.posexplode(as_double(F.col(vec))).alias("_p", "_x")).groupBy(group, "_p").agg(F.avg("_x").alias("_x"))
    whole = mean.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_p", "_x"))).alias("_v"))
    return whole.select(group, normalised(F.transform("_v", lambda s: s["_x"])).alias("v"))


def similarity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner products of two small tables of vectors (class centroids)."""
    a, b = left.select(F.col(key).alias("a"), F.col("v").alias("_a")), right.select(F.col(key).alias("b"), F.col("v").alias("_b"))
    return a.join(F.broadcast(b)).select("a", "b", dot(F.col("_a"), F.col("_b")).alias("cosine"))


def similar_pairs(vectors: DataFrame, threshold: float, block: int = PAIR_BLOCK) -> DataFrame:
    """vectors (row_id, v) -> a, b, cosine with a < b and cosine above the threshold, exactly.

    Rows are dealt into blocks and each pair of blocks is one matrix product in a task of its own.
    """
    n = max(1, -(-vectors.count() // block))
    own = vectors.select("row_id", "v", F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int").alias("_b"))
    copies = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("row_id", "v", "_b", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"))

    def product(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = (rows[rows["_b"] == k] for k in key)
        v, w = (np.array(x["v"].tolist(), np.float64).reshape(len(x), -1) for x in (left, right))
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "cosine": []}).astype({"a": "int64", "b": "int64"})
        s = v @ w.T
        i, j = np.nonzero(s > threshold)
        a, b = left["row_id"].to_numpy()[i], right["row_id"].to_numpy()[j]
        out = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": s[i, j]})
        return out[(a < b) if key[0] == key[1] else (a != b)]

    return copies.groupBy("i", "j").applyInPandas(product, "a long, b long, cosine double")


def upsert(old: DataFrame, new: DataFrame, guard: float = 0.8) -> DataFrame:
    """old (row_id, v) with the vectors of new in place of theirs, what changed, and whether a change is suspicious."""
    n = new.select("row_id", F.col("v").alias("_new"))
    cosine = dot(F.col("v"), F.col("_new")) / (norm(F.col("v")) * norm(F.col("_new")))
    changed = F.col("_new").isNotNull()
    return old.join(n, "row_id", "left").select("row_id", F.coalesce("_new", "v").alias("v"), changed.alias("changed"), (changed & (cosine < guard)).alias("suspicious"))


def verify(index: DataFrame, source: DataFrame, tolerance: float = 1e-4, every: int = 1) -> DataFrame:
    """One row: rows of both, rows missing from the index, and the greatest difference of an element.

    every: a deterministic sample of one in so many rows is compared.
    """
    s = source.where(F.pmod(F.xxhash64("row_id"), F.lit(every)) == 0).select("row_id", normalised(F.col("v")).alias("_s"))
    far = F.aggregate(F.zip_with("v", "_s", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: F.greatest(acc, x))
    got = s.join(index.select("row_id", "v"), "row_id", "left")
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), F.max(far).alias("max_diff")).withColumn("ok", (F.col("missing") == 0) & (F.coalesce("max_diff", F.lit(0.0)) <= tolerance))
