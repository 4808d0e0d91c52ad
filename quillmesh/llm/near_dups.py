"""MinHash near-dedup with HyperMinHash registers.

Sketch: one 64-bit hash of each distinct word shingle. Its upper bits route it to one of `REGISTERS` buckets; a bucket's
register keeps the least of its values as the count of leading zeros and the `MANTISSA` bits after the leading one, or 0
where the bucket is empty. Consecutive registers form bands, fewer and wider ones for small sets (`BANDS`): between two
sets at 0.8, differing shingles spoil at most as many bands as there are of them, and of large sets a band of six registers
agrees with a chance of 0.8 to the sixth; at every size a pair shares no band with a chance below 3e-6 (see the tests). Documents with one shingle set
are one class, represented by its least doc_id. Pairs of representatives that share a band are first compared by their
registers, with Jaccard similarity corrected for registers that collide by chance; pairs more than six standard errors
below the threshold go (a true pair does with a chance of some 1e-9), and all others are confirmed on full shingle sets.

Bands are not expanded into all pairs. Each member is paired with the least member of its bucket; links are confirmed and
components found. In buckets that still hold several components, members are paired with the most typical one, whose
shingles have the most owners. What then still stands in different components is joined by prefixes: shingles are
ordered by rarity, and two sets that reach the threshold have one of their first n - 0.8 n + 1 in common, at places and
sizes that leave enough of both sets. So no pair that shares a band and could join two components is skipped. Hot keys
are grouped with map-side combine and joined by (key, salt).

Null or blank text: an empty set, linked with nothing. A null doc_id: linked with nothing, its component is null and
it is kept. Rows of one doc_id count as one document. Extra columns pass through keep_first, whatever their names. An
empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.llm.common import cut, partitions, private, release, small, with_group_min
from quillmesh.llm.graphs import merged

WORDS = 5
THRESHOLD = 0.8
REGISTERS = 252
MANTISSA = 10
#: Number of bands by set size, from the size on: (size, bands). Smaller sets equal another or don't reach 0.8.
BANDS = ((5, 28), (7, 12), (12, 9), (26, 12), (43, 14), (62, 18), (88, 28), (176, 36), (255, 42))
#: The most doc_ids that are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 200_000

_ODD = np.random.default_rng(20240301).integers(1, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHash(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, width: int, memo: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit shingles of the words, A-Z in lower case; of fewer words, the one whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: only A-Z, and the six ASCII blanks
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter((memo[x] for x in words), np.uint64, len(words))
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : len(w) - k + 1 + i]) * _ODD[0, i % 8]
        h ^= h >> np.uint64(29)
    return np.unique(h * _ODD[1, 0])


def registers(h: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of sorted hashes: leading zeros in the upper bits, mantissa below; 0 is an empty bucket."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(h):
        return out
    bucket = ((h >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)  # rises with h
    v = (h ^ (h >> np.uint64(31))) * _ODD[1, 1]
    v = (v ^ (v >> np.uint64(28))) * _ODD[1, 2]
    first = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
    m, e = np.frexp(np.maximum(np.minimum.reduceat(v, first), 1).astype(np.float64))
    zeros = np.minimum(64 - e, 62).astype(np.uint16)
    mantissa = np.minimum(((m - 0.5) * 2 * (1 << MANTISSA)).astype(np.uint16), np.uint16((1 << MANTISSA) - 1))
    out[bucket[first].astype(np.int64)] = (zeros << np.uint16(MANTISSA) | mantissa) + np.uint16(1)
    return out


def _cells() -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds, in 0 .. 1, of the values of each register content (to 40 leading zeros)."""
    lz, mantissa = np.divmod(np.arange(40 << MANTISSA), 1 << MANTISSA)
    unit = 0.5 ** (lz + 1.0)
    return unit * (1 + mantissa / (1 << MANTISSA)), unit * (1 + (mantissa + 1) / (1 << MANTISSA))


class Collisions:
    """Chance that registers of buckets with so many values agree though their least values differ."""

    def __init__(self) -> None:
        self.low, self.high = _cells()
        self.law: dict[int, np.ndarray] = {}
        self.known: dict[tuple[int, int], float] = {}

    def of(self, n: int, m: int) -> float:
        """For sets of n and m shingles."""
        at = tuple(sorted(max(0, round(np.log2(max(1, x / REGISTERS)))) for x in (n, m)))
        if at not in self.known:
            for e in at:
                if e not in self.law:
                    self.law[e] = np.exp(2**e * np.log1p(-self.low)) - np.exp(2**e * np.log1p(-np.minimum(self.high, 1 - 1e-16)))
            self.known[at] = float((self.law[at[0]] * self.law[at[1]]).sum())
        return self.known[at]


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int, collisions: Collisions) -> tuple[float, int]:
    """Jaccard similarity from two sketches, corrected for chance agreement, and the number of buckets it rests on."""
    filled = int(((a | b) > 0).sum())
    if not filled:
        return 0.0, 0
    c = collisions.of(n, m)
    agree = int(((a == b) & (a > 0)).sum())
    return max(0.0, (agree / filled - c) / (1 - c)), filled


def hopeful(a: np.ndarray, b: np.ndarray, n: int, m: int, threshold: float, collisions: Collisions) -> bool:
    """The estimate isn't more than six standard errors below the threshold."""
    j, filled = estimate(a, b, n, m, collisions)
    return j >= threshold - 6 * (threshold * (1 - threshold) / max(1, filled)) ** 0.5


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set (a digest of the shingle set), regs."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHash()
        for batch in batches:
            for at in range(0, len(batch), 1000):
                rows = []
                for doc, text in batch.iloc[at : at + 1000].itertuples(index=False):
                    h = shingles(text, width, memo)
                    rows.append((doc, len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), registers(h).tobytes() if len(h) else b""))
                yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set", "regs"]).astype({"n_shingles": "int64"})

    return docs.select("doc_id", "text").mapInPandas(scan, "doc_id long, n_shingles long, set binary, regs binary")


def bandings(n: int, threshold: float) -> list[int]:
    """Places in BANDS of a set of n shingles: its own, and those that a larger set at the threshold has as its own."""
    own = [i for i, (size, _) in enumerate(BANDS) if size <= n]
    return ([own[-1]] if own else []) + [i for i, (size, _) in enumerate(BANDS) if n < size <= n / threshold + 1e-9]


def buckets(classes: DataFrame, threshold: float) -> DataFrame:
    """key, rep, n: a row for each band, of each representative, that has a shingle in it."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                if not len(part):
                    continue
                regs = np.frombuffer(b"".join(part["regs"]), np.uint16).reshape(len(part), REGISTERS).astype(np.uint64)
                rep, n = part["rep"].to_numpy(), part["n"].to_numpy()
                at_sizes = {x: bandings(int(x), threshold) for x in np.unique(n)}
                for i, (_, bands) in enumerate(BANDS):
                    own = np.array([i in at_sizes[x] for x in n])
                    if not own.any():
                        continue
                    r = regs[own].reshape(int(own.sum()), bands, REGISTERS // bands)
                    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(64 * i), r.shape[:2]).copy()
                    for k in range(r.shape[2]):
                        key = (key ^ r[:, :, k]) * _ODD[0, 8 + k % 32]
                        key ^= key >> np.uint64(31)
                    full = r.any(2)
                    yield pd.DataFrame({"key": key[full].astype(np.int64), "rep": np.repeat(rep[own], full.sum(1)), "n": np.repeat(n[own], full.sum(1))})

    return classes.select("rep", "n", "regs").mapInPandas(scan, "key long, rep long, n long")


def shared(rows: DataFrame) -> DataFrame:
    """Rows of buckets with at least two representatives."""
    salts = max(64, partitions(rows.sparkSession))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int"))
    part = salted.groupBy("key", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    many = part.groupBy("key").agg(F.sum("_n").alias("_n"), F.collect_list("_salt").alias("_salts")).where("_n > 1").select("key", F.explode("_salts").alias("_salt"))
    return salted.join(many, ["key", "_salt"]).drop("_salt")


def _alike(n: str, m: str, threshold: float) -> Column:
    """Sets of these sizes can reach the threshold."""
    return F.least(n, m) >= F.ceil(threshold * F.greatest(n, m) - 1e-9)


def _with(rows: DataFrame, per_key: DataFrame, key: str = "key") -> DataFrame:
    """rows joined with a written table of one row for each key: by broadcast while it is small, else over (key, salt)."""
    few = small(per_key)
    if few is not per_key:
        return rows.join(few, key)
    salts = max(64, partitions(rows.sparkSession))
    x = rows.withColumn("_salt", F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int"))
    return x.join(x.select(key, "_salt").distinct().join(per_key, key), [key, "_salt"]).drop("_salt")


def star(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the centre of a bucket, its least representative, with each other member."""
    centre = cut(rows.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("_c")), "centres")
    x = _with(rows, centre).where((F.col("rep") != F.col("_c.rep")) & _alike("n", "_c.n", threshold))
    return x.select(F.col("_c.rep").alias("a"), F.col("rep").alias("b")).distinct()


def unsettled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows, with their labels, of the buckets that hold several components."""
    at = rows.drop("label").join(small(labels).withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    several = cut(at.groupBy("key").agg((F.min("label") != F.max("label")).alias("_open")).where("_open").select("key"), "open")
    return cut(at.join(small(several), "key", "left_semi"), "buckets")


def hashed(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id, v (a number of the set), n, regs, s (the sorted hashes): the sets of these ids, each once.

    A known number of ids is broadcast, more are shuffled.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        memo = WordHash()
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows = []
                for doc, text in batch.iloc[at : at + 500].itertuples(index=False):
                    h = shingles(text, width, memo)
                    rows.append((doc, xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63), len(h), registers(h).tobytes(), h.tobytes()))
                yield pd.DataFrame(rows, columns=["doc_id", "v", "n", "regs", "s"])

    own = docs.select("doc_id", "text").join(small(ids, BROADCAST_IDS), "doc_id")
    return own.mapInPandas(scan, "doc_id long, v long, n long, regs binary, s binary").where("n > 0").dropDuplicates(["doc_id", "v"])


def owned(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """s, rep, v, n, df: a row for each shingle of each representative in rows that has several owners, and their number."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                n = part["n"].to_numpy()
                s = np.frombuffer(b"".join(part["s"]), np.int64)
                yield pd.DataFrame({"s": s, "rep": np.repeat(part["doc_id"].to_numpy(), n), "v": np.repeat(part["v"].to_numpy(), n), "n": np.repeat(n, n)})

    ids = cut(rows.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    every = sets.join(small(ids), "doc_id", "left_semi").select("doc_id", "v", "n", "s").mapInPandas(scan, "s long, rep long, v long, n long")
    every = cut(every, "shingles")
    owners = cut(every.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "owners")
    out = cut(_with(every, owners, "s"), "owned")
    release(ids, every, owners)
    return out


def typical(rows: DataFrame, shared_: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the most typical member of a bucket, and of its largest component, with the members in other components.

    A member is typical if the logarithms of its shingles' owners, that is, of how many sets it could be near, have a
    high mean.
    """
    worth = cut(shared_.groupBy("rep", "v", "n").agg((F.sum(F.log2("df")) / F.first("n")).alias("w")).groupBy("rep").agg(F.max("w").alias("w")), "worth")
    x = rows.join(small(worth), "rep", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    best = F.max(F.struct("w", F.negative("rep").alias("_o"), "rep", "n", "label"))
    per = x.groupBy("key", "label").agg(F.count(F.lit(1)).alias("_n"), best.alias("_b"))
    per = per.groupBy("key").agg(F.max("_b").alias("_c"), F.max(F.struct("_n", "_b")).alias("_m"))
    per = cut(per.select("key", F.array_distinct(F.array(F.struct("_c.rep", "_c.n", "_c.label"), F.struct("_m._b.rep", "_m._b.n", "_m._b.label"))).alias("_c")), "centres")
    x = _with(rows, per).select("rep", "n", "label", F.explode("_c").alias("_c"))
    return x.where((F.col("label") != F.col("_c.label")) & _alike("n", "_c.n", threshold)).select(F.col("_c.rep").alias("a"), F.col("rep").alias("b")).distinct()


def prefixed(rows: DataFrame, shared_: DataFrame, threshold: float) -> DataFrame:
    """(a, b): representatives in different components that have a shingle of their prefixes in common.

    Shingles are ordered by owners, rarest first, so those without a second owner come before all others and are only
    counted. At place p of n, at most n - p + 1 shingles can be in common from there on, which suffices for sizes up to
    (n - p + 1) (1 + t) / t - n. A place goes if its shingle has no owner of such a size, or none in another component.
    """
    t = threshold
    place = F.row_number().over(W.partitionBy("rep", "v").orderBy("df", "s")) + F.col("n") - F.count(F.lit(1)).over(W.partitionBy("rep", "v"))
    x = shared_.withColumn("p", place).where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * t - 1e-6) + 1)
    x = x.withColumn("most", F.floor((F.col("n") - F.col("p") + 1) * ((1 + t) / t) + 1e-6) - F.col("n"))
    x = x.join(small(cut(rows.select("rep", "label").distinct(), "labels")), "rep").select("s", "rep", "n", "most", "label")
    for _ in range(2):
        x = cut(x, "places")
        per = x.groupBy("s").agg(F.min("n").alias("_n"), F.min("label").alias("_l"), F.max("label").alias("_g")).where("_l <> _g").select("s", "_n")
        x = _with(x, cut(per, "owners"), "s").where("most >= _n").drop("_n")
    x = cut(x, "places")
    one = x.select("s", F.col("rep").alias("a"), "n", "most", "label")
    other = x.select(F.col("s").alias("_s"), F.col("rep").alias("b"), F.col("n").alias("_n"), F.col("most").alias("_most"), F.col("label").alias("_label"))
    fits = (F.col("a") < F.col("b")) & (F.col("label") != F.col("_label")) & (F.col("most") >= F.col("_n")) & (F.col("_most") >= F.col("n")) & _alike("n", "_n", t)
    return one.join(other, (F.col("s") == F.col("_s")) & fits).select("a", "b").distinct()


def _sides(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with these columns of both members, as <column>_a and <column>_b.

    a may be in a third of all pairs, so it meets its row over (a, salt); b is in few pairs.
    """
    x = pairs.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(max(16, partitions(pairs.sparkSession)))).cast("int"))
    own = lambda e: sets.select(F.col("doc_id").alias(e), *(F.col(c).alias(f"{c}_{e}") for c in columns))
    return x.join(x.select("a", "_salt").distinct().join(own("a"), "a"), ["a", "_salt"]).join(own("b"), "b").drop("_salt")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs that reach the threshold, as a written table: first by the registers' estimate, and what it leaves by the full sets."""
    percent = round(100 * threshold)

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        collisions = Collisions()
        for p in batches:
            a, b = (np.frombuffer(b"".join(p[f"regs_{e}"]), np.uint16).reshape(len(p), REGISTERS) for e in "ab")
            ok = np.array([hopeful(x, y, n, m, threshold, collisions) for x, y, n, m in zip(a, b, p["n_a"], p["n_b"], strict=True)], bool)
            yield p.loc[ok, ["a", "b"]]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = []
            for x, y in zip(p["s_a"], p["s_b"], strict=True):
                s, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(s, v, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(v) - both))
            yield p.loc[np.array(ok, bool), ["a", "b"]]

    left = cut(_sides(pairs, sets, ["n", "regs"]).mapInPandas(guess, "a long, b long").distinct(), "hopeful")
    out = cut(_sides(left, sets, ["s"]).mapInPandas(verify, "a long, b long").distinct(), "found")
    release(left)
    return out


def classify(docs: DataFrame, width: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that a document reaches over confirmed links."""
    sketch = cut(sketches(docs, width), "sketches")
    own = sketch.where("n_shingles > 0 and doc_id is not null")
    member = with_group_min(own, "set", "doc_id", "rep", "copies")
    member = cut(member.select("doc_id", "rep", F.col("n_shingles").alias("n"), F.when(F.col("doc_id") == F.col("rep"), F.col("regs")).alias("regs")), "members")
    classes = member.where("doc_id = rep").select("rep", "n", "regs")
    rows = cut(shared(buckets(classes, threshold).distinct()), "buckets")
    ids = cut(rows.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    sets = cut(hashed(docs, ids, width), "sets")
    release(ids)
    # rows of one doc_id that differ in text are one document: their classes are linked through it
    known = member.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).join(classes.select(F.col("rep").alias("b")), "b", "left_semi").select("a", "b")
    known = cut(known, "links")
    labels = docs.sparkSession.createDataFrame([], "node long, label long") if known.isEmpty() else merged(None, known)

    def link(pairs: DataFrame, tried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Components with the links among pairs that weren't tried before, and all pairs tried."""
        if tried is not None:
            ends = [F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")]
            pairs = pairs.select("a", "b", *ends).join(small(tried), ["x", "y"], "left_anti").select("a", "b")
        pairs = cut(pairs, "pairs")
        now = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        found = confirmed(pairs, sets, threshold)
        more = labels if found.isEmpty() else merged(labels, found)
        tested = cut(now if tried is None else tried.select("x", "y").union(now), "tried")
        release(pairs, found, *([tried] if tried is not None else []))
        return more, tested

    def still(rows: DataFrame) -> DataFrame:
        left = unsettled(rows, labels)
        release(rows)
        return left

    labels, tried = link(star(rows, threshold), None)
    rows = still(rows)
    if not rows.isEmpty():
        common = owned(sets, rows)
        labels, tried = link(typical(rows, common, threshold), tried)
        rows = still(rows)
        if not rows.isEmpty():
            left = cut(rows.select("rep").distinct(), "ids")
            labels, tried = link(prefixed(rows, common.join(small(left), "rep", "left_semi"), threshold), tried)
        release(common)
    release(tried, rows, sets)
    own = member.select("doc_id", "rep").join(small(labels).withColumnRenamed("node", "rep"), "rep", "left").withColumn("rep", F.coalesce("label", "rep"))
    got = own.groupBy(F.col("doc_id").alias("_id")).agg(F.min("rep").alias("_component"))
    return sketch.select("doc_id", "n_shingles").join(got, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, width: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those whose component has an earlier document; their columns stay as they are.

    Of repeated rows of one doc_id, all stay or all go.
    """
    own = private(docs)
    gone = classify(docs, width, threshold).where("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(own), "left_anti")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of op8: 4-word shingles."""
    c = classify(docs, 4, 0.8)
    return c.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
