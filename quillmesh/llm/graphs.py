"""Connected components by least-label propagation with pointer jumping, over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import cut, release, small


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, label): the least node that each node of an edge reaches.

    Each round takes the least label of all neighbours and then the label of that label, so a path of n nodes
    needs about log n rounds. Labels of nodes only fall, and some label falls in every round but the last, so the loop ends. Labels are
    broadcast while they are few, else joined by a shuffle.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut(both, "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        known = small(labels).select("node", "label")
        heard = both.join(known.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        low = heard.join(known, "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        jump = known.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = cut(low.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        release(labels)
        labels = new
        if new.where("label <> was").isEmpty():
            release(both)
            return new.select("node", "label")


def merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """labels with the components that new edges join: the edges are taken between labels, of which there are fewer."""
    if labels is None or labels.isEmpty():
        return components(edges)
    known = small(labels)
    for end in ("a", "b"):
        got = known.select(F.col("node").alias(end), F.col("label").alias("_l"))
        edges = edges.join(got, end, "left").withColumn(end, F.coalesce("_l", end)).drop("_l")
    over = components(edges.where("a <> b"))
    top = small(over).select(F.col("node").alias("label"), F.col("label").alias("_top"))
    old = labels.join(top, "label", "left").select("node", F.coalesce("_top", "label").alias("label"))
    return cut(old.union(over.join(labels.select("node"), "node", "left_anti").select("node", "label")), "labels")
