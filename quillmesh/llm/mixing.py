"""Mixing sources to target weights.

Each source's texts are laid end to end in a pseudorandom order and cut into blocks of `block` words. Targets say
how many words the mix takes from each source; the slots of the mix are spread over output shards of `shard_slots`
slots. A shard's source counts are multinomial draws given the exact totals: a binary tree of shards is walked from
its root, and at each node the counts of the left half are drawn without replacement with a seed of that node, so
every shard finds its counts, and its first slot number in each source, on its own. Slot i of a source with B blocks
takes block p(i mod B) in pass i div B, where p is a keyed Feistel permutation of that source and pass. Slots join
blocks by (source, block).

Documents are placed by a hash of doc_id and text; equal rows (of one doc_id, source and text) are placed together, one
after another. Offsets are summed within ranges of the hash, whose number follows the number of rows, so no task holds a
source. A block's text keeps all characters of its documents: a piece goes from its first word up to the next piece's.

No source is taken more than `most` times, so no block and no document is. Weights go by the rank of a source in
code-point order, null last, repeating; what a source can't hold is shared by weight among the others.

Null text: no words. Null source: a source of its own. Null doc_id: an id of its own. Repeated rows: each has its
own place. Texts without words are in no block. Extra columns are not returned and may have any name. Empty tables, or tables without words: sizes and takes of 0. Reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.llm.common import cut

WEIGHTS = (1, 2, 3)
MOST = 3
#: Words in a block.
BLOCK = 128
#: Slots in an output shard.
SHARD_SLOTS = 4096
#: Rows that a range of the hash order should hold when all rows are of one source.
RANGE_ROWS = 50_000
#: What follows each document's text in a block.
BETWEEN = "\n"
_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))


def with_size(docs: DataFrame, text: str = "text", out: str = "size") -> DataFrame:
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([len(x.encode("utf-8", "surrogatepass").split()) if x else 0 for x in batch], index=batch.index, dtype="int64")

    scan.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out, F.pandas_udf(scan, "long")(F.col(text)))


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Words to take of each source: shares of the total by weight, none above `most` times its size."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = float(sum(size.values())), [s for s, _ in order], {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: float(most * size[s]) for s in full}
        left -= sum(most * size[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. n-1: four Feistel rounds over the next even power of two, walked back into range."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 2**63, 4, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(33)) & mask)
        return (left << np.uint64(half)) | right

    out = once(i.astype(np.uint64))
    while (bad := out >= n).any():
        out[bad] = once(out[bad])
    return out.astype(np.int64)


def shard_counts(totals: np.ndarray, shard: int, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in the shard, slots of each source in the shards before it)."""
    lo, hi, before, counts = 0, -(-int(totals.sum()) // slots), np.zeros_like(totals), totals.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.array(_left_half(tuple(map(int, counts)), lo, hi, slots, seed), np.int64)
        if shard < mid:
            hi, counts = mid, left
        else:
            lo, before, counts = mid, before + left, counts - left
    return counts, before


@lru_cache(4096)
def _left_half(counts: tuple[int, ...], lo: int, hi: int, slots: int, seed: int) -> tuple[int, ...]:
    """Of the counts of shards lo .. hi - 1, those of the left half: a draw without replacement, source by source."""
    draw = np.random.default_rng([seed, lo, hi])
    rest, need, left = sum(counts), ((lo + hi) // 2 - lo) * slots, []
    for c in counts:
        rest -= c
        left.append(_hypergeometric(draw, c, rest, need))
        need -= left[-1]
    return tuple(left)


def _hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Of n drawn from good + bad, the good ones.

    numpy draws from fewer than 10^9; beyond, the distribution function is inverted over twelve standard deviations on
    either side of the mode, outside of which lies less than 10^-30 of it.
    """
    if n == 0 or good == 0:
        return 0
    total = good + bad
    if total < 10**9:
        return int(draw.hypergeometric(good, bad, n))
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = 20 + int(12 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))))
    first, last = max(0, n - bad, mode - reach), min(good, n, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    log_p = np.concatenate([[0.0], np.cumsum(np.log((good - k) / (k + 1)) + np.log((n - k) / (bad - n + k + 1)))])
    up_to = np.cumsum(np.exp(log_p - log_p.max()))
    return first + int(np.searchsorted(up_to, draw.random() * up_to[-1]))


def placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, offset within its source's stream, _t; source, source_size), a row for each document."""
    sized = with_size(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", F.xxhash64("text").alias("_t"))
    sized = cut(sized, "sizes")
    bits = max(8, math.ceil(math.log2(max(1, sized.count() / RANGE_ROWS))))
    group = sized.groupBy("source", "doc_id", "_t", "size").agg(F.count(F.lit(1)).alias("_copies")).withColumn("_o", F.xxhash64("doc_id", "_t"))
    group = cut(group.withColumn("_range", F.shiftrightunsigned("_o", 64 - bits)).withColumn("_all", F.col("size") * F.col("_copies")), "groups")
    within = W.partitionBy("source", "_range").orderBy("_o", "doc_id", "_t", "size").rowsBetween(W.unboundedPreceding, 0)
    of_range = group.groupBy("source", "_range").agg(F.sum("_all").alias("_n"))
    before = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    of_range = of_range.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = group.withColumn("_sum", F.sum("_all").over(within)).join(of_range, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    first = F.col("_before") + F.col("_sum") - F.col("_all")
    at = at.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    return at.select("doc_id", "source", "size", (first + F.col("_i") * F.col("size")).alias("offset"), "_t"), sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def plan(source_sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> list[dict]:
    """A row for each source with its size, target, blocks and slots. The number of sources bounds this list."""
    sizes = [(r["source"], r["source_size"]) for r in source_sizes.collect()]
    goal = targets(sizes, weights, most)
    out = []
    for s, n in sorted(sizes, key=lambda x: (x[0] is None, x[0] or "")):
        blocks = -(-n // block)
        out.append({"source": s, "source_size": n, "target": goal[s], "blocks": blocks, "slots": min(most * blocks, round(goal[s] * blocks / n)) if n else 0})
    return out


def slots(spark, planned: list[dict], shard_slots: int = SHARD_SLOTS, seed: int = 17) -> DataFrame:
    """shard, slot, _n (number of the source in the plan), block: the slots of the mix."""
    totals = np.array([p["slots"] for p in planned], np.int64)
    blocks = [p["blocks"] for p in planned]
    shards = -(-int(totals.sum()) // shard_slots) if len(totals) else 0

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                counts, first = shard_counts(totals, int(shard), shard_slots, seed)
                source, block = [], []
                for n, (c, f) in enumerate(zip(counts, first, strict=True)):
                    i = np.arange(f, f + c)
                    for turn in np.unique(i // max(1, blocks[n])):
                        own = i[i // blocks[n] == turn]
                        block.append(permute(own - turn * blocks[n], blocks[n], seed * 1_000_003 + n * 101 + int(turn)))
                        source.append(np.full(len(own), n))
                if source:
                    source, block = np.concatenate(source), np.concatenate(block)
                    mixed = np.random.default_rng([seed, int(shard)]).permutation(len(source))
                    yield pd.DataFrame({"shard": int(shard), "slot": np.arange(len(source)), "_n": source[mixed], "block": block[mixed]})

    drawn = spark.range(0, shards, 1, max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(draw, "shard long, slot long, _n int, block long")
    return drawn.hint("merge")  # the planner takes it for as small as the range and would broadcast it


def source_table(spark, planned: list[dict]) -> DataFrame:
    rows = [(n, p["source"], p["source_size"], float(p["target"])) for n, p in enumerate(planned)]
    return spark.createDataFrame(rows, "_n int, _source string, source_size long, target double")


def taken(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes, repeats counted."""
    at, per_source = placed(docs)
    spark = docs.sparkSession
    planned = plan(per_source, block=block)
    sources = F.broadcast(source_table(spark, planned))
    at = at.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    uses = slots(spark, planned, shard_slots).groupBy("_n", "block").agg(F.count(F.lit(1)).alias("uses")).hint("merge")
    pieces = at.where("size > 0").select("_n", "size", "offset", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block))).alias("block"))
    overlap = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("offset", F.col("block") * block)
    # texts with words have offsets of their own within a source
    of_doc = pieces.join(uses, ["_n", "block"]).groupBy("_n", "offset").agg(F.sum(overlap * F.col("uses")).alias("_taken"))
    of_doc = of_doc.select(F.col("_n").alias("_n2"), F.col("offset").alias("_offset2"), "_taken")
    on = (F.col("_n") == F.col("_n2")) & (F.col("offset") == F.col("_offset2")) & (F.col("size") > 0)
    return at.join(of_doc, on, "left").select("doc_id", F.col("size").cast("long"), "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix itself: shard, slot, source, block, n_words, doc_ids (of the texts in the block, in order), text.

    Blocks are as long as `block` words but for the last of each source. Laid end to end, a source's blocks give its
    documents' texts, each followed by BETWEEN.
    """
    at, per_source = placed(docs)
    spark = docs.sparkSession
    planned = plan(per_source, block=block)
    sources = F.broadcast(source_table(spark, planned))
    own = docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.xxhash64("text").alias("_h"), "text")
    # rows that agree in id, source and text stand at several offsets; each offset gets the text once
    own = own.dropDuplicates(["_id", "_src", "_h"])
    full = at.where("size > 0").join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_src")) & (F.col("_t") == F.col("_h")))
    full = full.join(sources, F.col("source").eqNullSafe(F.col("_source"))).select("_n", "doc_id", "offset", "text")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows = []
                for n, doc, offset, text in batch.iloc[at : at + 500].itertuples(index=False):
                    raw = text.encode("utf-8", "surrogatepass")
                    inside = ~_BLANK[np.frombuffer(raw, np.uint8)]
                    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
                    done, begin = 0, 0
                    while done < len(starts):
                        b = (offset + done) // block
                        k = min(len(starts) - done, (b + 1) * block - offset - done)
                        last = done + k == len(starts)
                        end = len(raw) if last else int(starts[done + k])
                        rows.append((n, b, offset + done, doc, k, raw[begin:end].decode("utf-8", "surrogatepass") + BETWEEN * last))
                        done, begin = done + k, end
                yield pd.DataFrame(rows, columns=["_n", "block", "_o", "doc_id", "_k", "text"])

    pieces = full.mapInPandas(split, "_n int, block long, _o long, doc_id long, _k long, text string")
    blocks = pieces.groupBy("_n", "block").agg(F.sort_array(F.collect_list(F.struct("_o", "doc_id", "_k", "text"))).alias("_p"))
    p = F.col("_p")
    blocks = blocks.select("_n", "block", F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x["_k"]).alias("n_words"), F.transform(p, lambda x: x["doc_id"]).alias("doc_ids"), F.array_join(F.transform(p, lambda x: x["text"]), "").alias("text"))
    got = slots(spark, planned, shard_slots).join(blocks, ["_n", "block"]).join(sources, "_n")
    return got.select("shard", "slot", F.col("_source").alias("source"), "block", "n_words", "doc_ids", "text")


def digest(docs: DataFrame) -> DataFrame:
    return taken(docs)
