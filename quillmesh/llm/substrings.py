"""Substring dedup by hashing lines and the sentences of long lines.

Units: a line of at most `line_chars` characters is one unit; a longer line is split after . ! or ? and a blank (a long
sentence after , ; or :, too), so a passage that was pasted into the middle of a line still yields whole units. A unit is normalised to its lower-case
words, without ASCII signs. Digests of 128 bits are grouped over all documents; the occurrence of least (doc_id, unit number) stays and the others
go. The words just before and just after a removed unit go too, up to the first that differs from the words beside
the kept occurrence, however many they are, which restores the ends of a passage whose first or last sentence runs on
into other text. Words themselves are compared, not hashes. Offsets are code points of the original text, end exclusive.

A key that occurs in a third of all rows is grouped by (key, salt) and never meets in one task. Units of fewer than
`min_words` words (sentences of long lines: `min_sentence`) are left alone. Null text: no units, stays null. Empty
text: no units. Rows with one doc_id and one text rank equally, so repeated rows keep equal results. Rows with a null
doc_id rank last and are documents of their own: of equal ones, one keeps its text if no document with an id has it.
Extra columns, whatever their names, are not returned. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import cut as written
from quillmesh.llm.common import partitions, release

LINE_CHARS = 80
MIN_WORDS, MIN_SENTENCE = 3, 5
#: Words beside a unit that are compared at first, and how much longer each further stretch is.
EDGE_WORDS, EDGE_GROWTH = 16, 8
SENTENCE = re.compile(r"[.!?][\"')\]]*\s+")
#: A sentence of more characters is split at these, too.
SENTENCE_CHARS = 160
CLAUSE = re.compile(r"[,;:]\s+")
#: ASCII signs and controls stand between words; all else is part of one.
_SIGNS = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))
_SIGN_CHARS = {i: " " for i in range(128) if not chr(i).isalnum()}
LAST = (1 << 63) - 1


def normalised(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SIGNS).split()


def units(text: str, line_chars: int = LINE_CHARS, min_words: int = MIN_WORDS, min_sentence: int = MIN_SENTENCE) -> Iterator[tuple[int, int, list[bytes], bool]]:
    """(start, end, normalised words, eligible) of each unit that has a word."""
    at = 0
    for line in text.split("\n"):
        if len(line) > line_chars:
            a = 0
            for end in [*(m.end() for m in SENTENCE.finditer(line)), len(line)]:
                for b in [*(m.end() for m in CLAUSE.finditer(line, a, end)), end] if end - a > SENTENCE_CHARS else [end]:
                    if own := normalised(line[a:b]):
                        yield at + a, at + b, own, len(own) >= min_sentence
                    a = b
        elif own := normalised(line):
            yield at, at + len(line), own, len(own) >= min_words
        at += len(line) + 1


def occurrences(docs: DataFrame) -> DataFrame:
    """d1, d2 (a digest of 128 bits), _id, _h, idx: a row for each eligible unit."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            for at in range(0, len(batch), 500):
                digest, ids, hs, idxs = [], [], [], []
                for doc, h, text in batch.iloc[at : at + 500].itertuples(index=False):
                    for idx, (_, _, words, eligible) in enumerate(units(text or "")):
                        if eligible:
                            digest.append(xxhash.xxh3_128_digest(b" ".join(words)))
                            ids.append(doc)
                            hs.append(h)
                            idxs.append(idx)
                if digest:
                    d = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                    yield pd.DataFrame({"d1": d[:, 0], "d2": d[:, 1], "_id": ids, "_h": hs, "idx": np.array(idxs, np.int32)})

    return docs.select("_id", "_h", "text").mapInPandas(scan, "d1 long, d2 long, _id long, _h long, idx int")


def stretches(docs: DataFrame, asked: DataFrame, at: int, size: int) -> DataFrame:
    """asked (_id, _h, idx, side, stop) with words: up to `size` words beside a unit, from the at-th on, nearest first.

    side 1: after the unit, -1: before it. The words of unit `stop` and those beyond it are left out (-1: none are).
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, h, text, asks in batch[["_id", "_h", "text", "_asks"]].itertuples(index=False):
                got = list(units(text or ""))
                line = [w for u in got for w in u[2]]
                starts = [0, *accumulate(len(u[2]) for u in got)]
                for ask in asks:
                    idx, side, stop = ask["idx"], ask["side"], ask["stop"]
                    if side > 0:
                        a = starts[idx + 1] + at
                        own = line[a : min(a + size, starts[stop] if stop >= 0 else len(line))]
                    else:
                        b = starts[idx] - at
                        own = line[max(b - size, starts[stop + 1] if stop >= 0 else 0) : max(b, 0)][::-1]
                    out.append((i, h, idx, side, stop, b" ".join(own)))
            yield pd.DataFrame(out, columns=["_id", "_h", "idx", "side", "stop", "words"])

    per = asked.groupBy("_id", "_h").agg(F.collect_list(F.struct("idx", "side", "stop")).alias("_asks"))
    said = docs.select("_id", "_h", "text").join(per, ["_id", "_h"]).mapInPandas(scan, "_id long, _h long, idx int, side int, stop int, words binary")
    # rows with one doc_id and one text say the same
    return said.dropDuplicates(["_id", "_h", "idx", "side", "stop"])


def in_common(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """How many words two stretches begin with alike."""
    for own, other in pairs:
        n = []
        for a, b in zip(own, other, strict=True):
            x, y = a.split(), b.split()
            n.append(next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y))))  # noqa: B905
        yield pd.Series(n, dtype="int32")


def place(text: str, got: list, starts: np.ndarray, number: int) -> tuple[int, int]:
    """Start and end of a word, by its number among the words of all units."""
    n = int(np.searchsorted(starts, number, "right")) - 1
    a, b, _, _ = got[n]
    words = [(a + m.start(), a + m.end()) for m in re.finditer("[^ ]+", text[a:b].translate(_SIGN_CHARS))]
    return words[number - int(starts[n])]


def later_occurrences(docs: DataFrame, salts: int) -> DataFrame:
    """_id, _h, idx of units to remove, _kid, _kh, _kidx of the occurrence that stays.

    The first occurrences are found with map-side combine, so a unit that is in a third of all rows reaches no task as
    rows; the occurrences then meet them over (digest, salt).
    """
    table = written(occurrences(docs), "occurrences")
    occ = table.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int"))
    first = occ.groupBy("d1", "d2").agg(F.min(F.struct("_id", "_h", "idx")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = written(first.where("_n > 1").select("d1", "d2", F.col("_first._id").alias("_kid"), F.col("_first._h").alias("_kh"), F.col("_first.idx").alias("_kidx")), "first")
    found = occ.join(occ.select("d1", "d2", "_salt").distinct().join(first, ["d1", "d2"]), ["d1", "d2", "_salt"])
    found = found.where((F.col("_id") != F.col("_kid")) | (F.col("_h") != F.col("_kh")) | (F.col("idx") != F.col("_kidx")))
    out = written(found.select("_id", "_h", "idx", "_kid", "_kh", "_kidx").dropDuplicates(["_id", "_h", "idx"]), "later")
    release(table, first)
    return out


def edges(docs: DataFrame, later: DataFrame, salts: int) -> list[DataFrame]:
    """Tables of _id, _h, idx, side, n: how many words beside a removed unit equal those beside the one that stays.

    Removed units that follow one another, as their first occurrences do, share their edges: only the ends of such a row
    are asked for, up to the next removed unit that goes on with it. The words on both sides are compared in stretches
    of EDGE_WORDS, then of `EDGE_GROWTH` times as many for the ends that are still equal, until none is.
    """
    way = Window.partitionBy("_id", "_h", "_kid", "_kh", F.col("_kidx") - F.col("idx")).orderBy("idx")
    ends = later.withColumn("_prev", F.lag("idx").over(way)).withColumn("_next", F.lead("idx").over(way))
    end = lambda side, near: F.when(F.col(near).isNull() | (F.col(near) != F.col("idx") + side), F.struct(F.lit(side).alias("side"), F.coalesce(near, F.lit(-1)).alias("stop")))
    ends = ends.withColumn("_e", F.explode(F.filter(F.array(end(-1, "_prev"), end(1, "_next")), lambda e: e.isNotNull())))
    ends = ends.select("_id", "_h", "idx", "_kid", "_kh", "_kidx", "_e.side", "_e.stop", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("_salt"))
    out, at, size = [], 0, EDGE_WORDS
    alike = F.pandas_udf(in_common, "int")
    kept = {"_id": "_kid", "_h": "_kh", "idx": "_kidx"}
    ends = written(ends, "ends")
    while at == 0 or not ends.isEmpty():
        asked = ends.select("_id", "_h", "idx", "side", "stop").union(ends.select("_kid", "_kh", "_kidx", "side", F.lit(-1)))
        said = written(stretches(docs, asked.distinct(), at, size), "stretches")
        other = said.where("stop = -1").select(*(F.col(a).alias(b) for a, b in kept.items()), "side", F.col("words").alias("_other"))
        other = ends.select(*kept.values(), "side", "_salt").distinct().join(other, [*kept.values(), "side"])
        both = ends.join(said, ["_id", "_h", "idx", "side", "stop"]).join(other, [*kept.values(), "side", "_salt"])
        done = written(both.select(*ends.columns, alike("words", "_other").alias("_n")), "edges")
        release(said)
        out.append(done.where((F.col("_n") < size) & (F.col("_n") + at > 0)).select("_id", "_h", "idx", "side", (F.col("_n") + at).alias("n")))
        ends, at, size = done.where(F.col("_n") == size).drop("_n"), at + size, size * EDGE_GROWTH
    return out


def ranked(docs: DataFrame) -> DataFrame:
    """doc_id, text, _id and _h, by which documents are ranked: doc_id, then a hash of the text.

    Rows without a doc_id come last and are numbered, so each is a document of its own; they are written first, so that
    they keep their numbers.
    """
    plain = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_h"))
    nameless = docs.where(F.col("doc_id").isNull()).select("doc_id", "text")
    if nameless.isEmpty():
        return plain
    return plain.union(written(nameless.select("doc_id", "text", F.lit(LAST).alias("_id"), F.monotonically_increasing_id().alias("_h")), "nameless"))


def deduplicate(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """doc_id, text without later occurrences, n_removed, removed (array of start, end in the original text)."""
    salts = salts or max(64, partitions(docs.sparkSession))
    own = ranked(docs)
    later = later_occurrences(own, salts)
    gone = reduce(DataFrame.union, edges(own, later, salts), later.select("_id", "_h", "idx", F.lit(0).alias("side"), F.lit(0).alias("n")))
    gone = gone.groupBy("_id", "_h").agg(F.collect_list(F.struct("idx", "side", "n")).alias("_gone"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, gone in zip(batch["text"], batch["gone"], strict=True):
                if gone is None or not len(gone):
                    rows.append((text, 0, []))
                    continue
                got = list(units(text or ""))
                starts = np.cumsum([0, *(len(u[2]) for u in got)])
                spans = []
                for g in gone:
                    idx, side, n = g["idx"], g["side"], g["n"]
                    s, e, _, _ = got[idx]
                    if side < 0:
                        s = place(text, got, starts, int(starts[idx]) - n)[0]
                    elif side > 0:
                        e = place(text, got, starts, int(starts[idx + 1]) + n - 1)[1]
                    spans.append((int(s), int(e)))
                merged: list[list[int]] = []
                for s, e in sorted(spans):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                kept, at = [], 0
                for s, e in merged:
                    kept.append(text[at:s])
                    at = e
                rows.append(("".join([*kept, text[at:]]), sum(g["side"] == 0 for g in gone), [{"start": s, "end": e} for s, e in merged]))
            yield pd.DataFrame(rows, columns=["text", "n_removed", "removed"])

    cut.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    done = F.pandas_udf(cut, "struct<text:string,n_removed:long,removed:array<struct<start:int,end:int>>>")
    joined = own.join(gone, ["_id", "_h"], "left").select("doc_id", done(F.struct("text", F.col("_gone").alias("gone"))).alias("_r"))
    return joined.select("doc_id", "_r.*")


def digest(docs: DataFrame) -> DataFrame:
    return deduplicate(docs)
