"""Sinks: JSON lines, tables, result objects and small reports."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import truncate_words

N_DOCUMENTS, N_FRAGMENTS, MAX_WORDS = 3, 10, 250


def result_objects(documents: DataFrame, fragments: DataFrame) -> DataFrame:
    """documents (qid, doc, rnk), fragments (qid, chunk_id, doc, text, rnk) -> query_id, documents, fragments (ordered arrays)."""
    d = documents.where(F.col("rnk") <= N_DOCUMENTS).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(F.col("rnk").alias("rank"), F.col("doc").alias("doc_id")))).alias("documents"))
    f = fragments.where(F.col("rnk") <= N_FRAGMENTS).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(F.col("rnk").alias("rank"), "chunk_id", F.col("doc").alias("doc_id"), truncate_words(F.col("text"), MAX_WORDS).alias("text")))).alias("fragments"))
    return d.join(f, "qid", "full").withColumnRenamed("qid", "query_id")


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object a line, keys in the order of the columns; a folder of part files."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "error") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def metadata(chunks: DataFrame, mandatory: list[str]) -> DataFrame:
    """Mandatory columns first, the others after them."""
    return chunks.select(*mandatory, *(c for c in chunks.columns if c not in mandatory))


def review_html(results: DataFrame, most: int = 50) -> str:
    """A page for reading by hand; for a bounded number of queries, as its name says."""
    rows = results.orderBy("query_id").limit(most).collect()
    item = lambda f: f"<li><b>{html.escape(str(f['chunk_id']))}</b> {html.escape(f['text'] or '')}</li>"
    body = "".join(f"<h2>{html.escape(str(r['query_id']))}</h2><p>{', '.join(html.escape(str(d['doc_id'])) for d in r['documents'] or [])}</p><ol>{''.join(map(item, r['fragments'] or []))}</ol>" for r in rows)
    return f"<!doctype html><meta charset='utf-8'><title>Review</title>{body}"
