"""Running heads and feet: lines that stand at the top or bottom of many pages of one document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import lines, strip, without_page_numbers


def boilerplate(pages: DataFrame, min_ratio: float = 0.3, band: int = 3) -> DataFrame:
    """pages (doc, page, text) -> (doc, line, n_pages): boilerplate lines of documents of at least four pages."""
    own = F.filter(F.transform(lines(F.col("text")), strip), lambda x: x != "")
    ends = pages.select("doc", "page", F.explode(F.array_distinct(F.concat(F.slice(own, 1, band), F.slice(F.reverse(own), 1, band)))).alias("line"))
    counts = ends.groupBy("doc", "line").agg(F.countDistinct("page").alias("n_pages"))
    size = pages.groupBy("doc").agg(F.countDistinct("page").alias("_pages"))
    least = F.greatest(F.lit(3), F.floor(F.col("_pages") * F.lit(min_ratio)))
    return counts.join(size, "doc").where((F.col("_pages") >= 4) & (F.col("n_pages") >= least) & (F.length("line") < 200)).select("doc", "line", "n_pages")


def drop_repeated_lines(pages: DataFrame, min_ratio: float = 0.3, band: int = 3) -> DataFrame:
    """pages without boilerplate and page numbers. The list of a document's lines is short: a few for each page."""
    gone = boilerplate(pages, min_ratio, band).groupBy("doc").agg(F.collect_set("line").alias("_gone"))
    kept = F.array_join(F.filter(lines(F.col("text")), lambda x: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<string>")), strip(x))), "\n")
    return pages.join(gone, "doc", "left").withColumn("text", without_page_numbers(kept)).drop("_gone")
