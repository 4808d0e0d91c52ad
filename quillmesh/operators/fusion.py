"""Rank fusion over a table of ranked lists: qid, list_id, row_id, score, rnk (and optionally weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K0 = 60


def _weight(lists: DataFrame):
    return F.col("weight") if "weight" in lists.columns else F.lit(1.0)


def rrf(lists: DataFrame, k0: int = RRF_K0) -> DataFrame:
    return lists.groupBy("qid", "row_id").agg(F.sum(_weight(lists) / (F.lit(k0) + F.col("rnk"))).alias("score"))


def minmax(lists: DataFrame) -> DataFrame:
    """lists with score scaled to 0 .. 1 within each list; 1 throughout a list of one value."""
    w = W.partitionBy("qid", "list_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return lists.withColumn("score", F.when(hi - lo <= 1e-9, F.lit(1.0)).otherwise((F.col("score") - lo) / (hi - lo)))


def combsum(lists: DataFrame, normalize: bool = True) -> DataFrame:
    x = minmax(lists) if normalize else lists
    return x.groupBy("qid", "row_id").agg(F.sum(_weight(lists) * F.col("score")).alias("score"))


def combmnz(lists: DataFrame, normalize: bool = True) -> DataFrame:
    x = minmax(lists) if normalize else lists
    return x.groupBy("qid", "row_id").agg((F.sum(_weight(lists) * F.col("score")) * F.count(F.lit(1))).alias("score"))


FUSIONS = {"rrf": rrf, "combsum": combsum, "combmnz": combmnz}


def fuse(lists: DataFrame, method: str = "rrf", **options) -> DataFrame:
    """qid, row_id, score, rnk: ranked by score, ties by row_id."""
    if method not in FUSIONS:
        raise ValueError(f"unknown fusion: {method}")
    order = W.partitionBy("qid").orderBy(F.col("score").desc(), F.col("row_id"))
    return FUSIONS[method](lists, **options).withColumn("rnk", F.row_number().over(order))
