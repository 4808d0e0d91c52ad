"""Token counts: the exact histogram of encoded lengths, whose suffix sums answer totals, quantiles and
truncated totals for every context limit.

Every whole text is encoded with a public tokenizer file (its path is a parameter). The histogram has one row for
each length that occurs, so its size depends on the longest text and not on the number of documents. Suffix sums
are taken in two levels - within blocks of lengths, then over block totals - so no task sorts the histogram.

Null or empty text: length 0. Repeated rows count each time. Extra columns pass through with_length, whatever their names;
a column named as its output is replaced. An empty table gives an empty histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.llm.common import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting pattern of that vocabulary (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Lengths in a block of the two-level sums.
BLOCK = 1024
#: Texts that one call of the encoder takes.
CALL = 64


def encoder(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_length(docs: DataFrame, text: str = "text", out: str = "n_tokens", path: str = TOKENIZER) -> DataFrame:
    """docs with the number of tokens of each text."""

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for batch in batches:
            texts = [x or "" for x in batch]
            yield pd.Series([len(t) for i in range(0, len(texts), CALL) for t in enc.encode_ordinary_batch(texts[i : i + CALL], num_threads=1)], index=batch.index, dtype="int64")

    scan.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out, F.pandas_udf(scan, "long")(F.col(text)))


def histogram(docs: DataFrame, text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """length, n_docs"""
    return with_length(docs.select(text), text, "length", path).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """hist, which is read twice and so is best a written table, with, for each length L: docs and tokens of at least L, and the tokens left if texts are cut to L.

    total_docs and total_tokens repeat the totals, so a row alone answers shares and quantiles.
    """
    h = hist.select("length", "n_docs", F.floor(F.col("length") / block).alias("_b"), (F.col("length") * F.col("n_docs")).alias("_t"))
    per = h.groupBy("_b").agg(F.sum("n_docs").alias("_d"), F.sum("_t").alias("_s"))
    over = W.orderBy(F.col("_b").desc()).rowsBetween(W.unboundedPreceding, -1)  # a row for each block of lengths
    every = W.partitionBy()
    per = per.select(
        "_b", F.coalesce(F.sum("_d").over(over), F.lit(0)).alias("_d_above"), F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_s_above"),
        F.sum("_d").over(every).alias("total_docs"), F.sum("_s").over(every).alias("total_tokens"),
    )
    within = W.partitionBy("_b").orderBy(F.col("length").desc()).rowsBetween(W.unboundedPreceding, 0)
    h = h.withColumn("_d", F.sum("n_docs").over(within)).withColumn("_s", F.sum("_t").over(within)).join(per, "_b")
    docs_ge, tokens_ge = F.col("_d") + F.col("_d_above"), F.col("_s") + F.col("_s_above")
    return h.select("length", "n_docs", docs_ge.alias("docs_at_least"), tokens_ge.alias("tokens_at_least"), (F.col("total_tokens") - tokens_ge + F.col("length") * docs_ge).alias("truncated_total"), "total_docs", "total_tokens")


def at_limits(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """limits (a small table with column context) with docs that exceed it and the tokens left when texts are cut.

    The answer is read from the least length above the limit; where there is none, nothing is cut.
    """
    above = F.min(F.when(F.col("length") > F.col("context"), F.struct("length", "docs_at_least", "tokens_at_least")))
    got = F.broadcast(limits.select(F.col("context").cast("long")).distinct()).join(sums, F.lit(True), "left").groupBy("context").agg(above.alias("_a"), F.max("total_tokens").alias("_t"))
    longer, tokens = F.coalesce(F.col("_a.docs_at_least"), F.lit(0)), F.coalesce(F.col("_a.tokens_at_least"), F.lit(0))
    return got.select("context", longer.alias("docs_longer"), (F.coalesce("_t", F.lit(0)) - tokens + F.col("context") * longer).alias("truncated_total"))


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """The least length such that at least this share of the documents is no longer than it."""
    up_to = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    return sums.where(up_to >= F.lit(share) * F.col("total_docs")).agg(F.min("length").alias("length"))


def digest(docs: DataFrame) -> DataFrame:
    return suffix_sums(cut(histogram(docs.select("text")), "histogram"))
