"""Encoders: text to vector. No weights ship; the default hashes words, deterministic on every machine."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Encoder:
    """load() runs once in each task and returns a function of a list of texts to a float matrix."""

    slug: str
    dim: int
    load: Callable[[], Callable[[list[str]], np.ndarray]]
    max_seq: int = 512
    query_prefix: str = ""
    passage_prefix: str = ""


def hashing(dim: int = 64, seed: int = 0) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Signed hashed counts of words and of their character trigrams."""

    def load() -> Callable[[list[str]], np.ndarray]:
        import zlib

        memo: dict[str, np.ndarray] = {}

        def of(word: str) -> np.ndarray:
            if word not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                v = np.zeros(dim)
                for part in [word, *(f"#{word}#"[i : i + 3] for i in range(len(word)))]:
                    h = zlib.crc32(part.encode("utf-8", "surrogatepass"), seed)
                    v[h % dim] += 1 if h >> 31 else -1
                memo[word] = v
            return memo[word]

        return lambda texts: np.array([sum((of(w) for w in t.lower().split()), np.zeros(dim)) for t in texts]).reshape(len(texts), dim)

    return load


#: Stand-ins for the three encoders: other sizes and prefixes, same interface.
ENCODERS = {e.slug: e for e in (Encoder("hash_a", 64, hashing(64, 1)), Encoder("hash_b", 96, hashing(96, 2)), Encoder("hash_c", 96, hashing(96, 3), query_prefix="query: ", passage_prefix="passage: "))}


def encode(df: DataFrame, encoder: Encoder, text: str, out: str = "v", is_query: bool = False) -> DataFrame:
    """df with a unit vector of each text; null counts as ''; a text without features has a zero vector."""
    prefix = encoder.query_prefix if is_query else encoder.passage_prefix

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder.load()
        for batch in batches:
            v = model([prefix + (t or "") for t in batch]).astype(np.float32)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list(v / np.where(n == 0, 1, n)), index=batch.index, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text)))


def encode_changed(rows: DataFrame, kept: DataFrame, encoder: Encoder, text: str) -> DataFrame:
    """rows (row_id, text) with vectors: those of kept (row_id, text_hash, v) where the text is the same, else new ones.

    The cache is keyed by a hash of what is encoded, so rows that moved or changed are found by an equi-join.
    """
    x = rows.withColumn("text_hash", F.xxhash64(F.lit(encoder.slug), F.col(text)))
    old = x.join(kept.select("row_id", "text_hash", "v"), ["row_id", "text_hash"])
    new = encode(x.join(kept.select("row_id", "text_hash"), ["row_id", "text_hash"], "left_anti"), encoder, text)
    return old.unionByName(new.select(old.columns))


def misaligned(rows: DataFrame, index: DataFrame, encoder: Encoder, text: str, least: float = 0.98, every: int = 1) -> DataFrame:
    """row_id, cosine of rows whose stored vector isn't that of their text; every: one in so many rows is encoded again."""
    from quillmesh.operators.vectors import dot

    again = encode(rows.where(F.pmod(F.xxhash64("row_id"), F.lit(every)) == 0).select("row_id", text), encoder, text, "_again")
    return again.join(index.select("row_id", "v"), "row_id").select("row_id", dot(F.col("v"), F.col("_again")).alias("cosine")).where(F.col("cosine") < least)


def token_count(text: Column) -> Column:
    """Tokens where no tokenizer is plugged in: runs of letters and digits, and single other signs."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"))
