"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is a run of `width` consecutive words of an item (or the whole item if shorter), seen as the set of its two-word
shingles with their places. A document that holds a window holds all of its shingles, so with exact containment one of
them is a sufficient prefix: a window's shingles are ordered by how rare they are in the corpus, and the rarest is
joined with the documents' shingles (an item of one word has that word as its shingle). A length and a positional bound
discard places where the window can't lie, and the aligned words are then compared exactly as far as windows reach. The
words of every confirmed run are hit.

Items are cut once into shingles, which meet their counts by one join; windows then choose within one array an item, so
nothing grows with the product of windows and item length. Only the words around a place that may start a match leave
the array of a document's words, so rows stay short however long the text. While the prefixes are few (their number is
counted), places are picked inside the scan of the documents and prefixes are broadcast; more are joined by a shuffle.

Null or empty text: no words, nothing hit. Items without words have no window; an item whose id is null marks words
but isn't listed. Rows with one doc_id and one text have equal results; a doc_id may be null. Extra columns, whatever
their names, are not returned by hits() and pass through remove(). An empty benchmark hits nothing; empty documents give
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import cut, private

WIDTH = 10
#: The most shingles that are picked or counted inside the scan; and the most rows of prefixes, each with two times `width`
#: words at most, and of distinct shingles that are broadcast.
PICKED_KEYS = 30_000
BROADCAST_ROWS, BROADCAST_SHINGLES = 50_000, 500_000
#: Fixed by the contract: a word is a run of digits, letters and all beyond ASCII. Case is left for later: full
#: lower-casing is cheap and never splits or joins words, so it finds candidates (with one form of sigma, the only letter
#: whose lower case depends on its neighbours); A-Z alone are lowered to confirm them.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(text, BETWEEN), ""), F.array().cast("array<string>"))


def lowered(a: Column) -> Column:
    """The words with A-Z in lower case; a blank is in no word."""
    return F.when(F.size(a) == 0, a).otherwise(F.split(F.translate(F.array_join(a, " "), UPPER, LOWER), " "))


def fold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def folded(a: Column) -> Column:
    return F.when(F.size(a) == 0, a).otherwise(F.split(fold(F.array_join(a, " ")), " "))


def shingles(low: Column) -> Column:
    """The two-word shingle at each place of an array of words in lower case; at the last place, the word alone."""
    return F.when(F.size(low) == 0, low).otherwise(F.zip_with(low, F.slice(low, 2, F.greatest(F.size(low) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def _set(values: set[str]) -> str:
    """SQL's list of words; they have no ASCII sign but the blank, so nothing needs to be escaped."""
    return ", ".join(f"'{x}'" for x in sorted(values))


def _found(pairs: list[str]) -> str:
    """SQL's test whether place i of _l begins one of these shingles: its word alone is looked up first."""
    if not pairs:
        return "false"
    return f"_l[i - 1] IN ({_set({k.split(' ')[0] for k in pairs})}) AND concat_ws(' ', _l[i - 1], get(_l, i)) IN ({_set(set(pairs))})"


def _places(words_: str, test: str) -> Column:
    """The places, from 1, of an array of words for which SQL's test of i holds. Rows without words aren't filtered out
    before: a filter on the array would be pushed below it and cut the text once more."""
    return F.expr(f"CASE WHEN size({words_}) > 0 THEN filter(sequence(1, size({words_})), i -> {test}) END")


def prefixes(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """key, item_id, word, left and right (the words beside it as far as windows reach), need (words in a window)."""
    own = items.select("item_id", "text").distinct().select("item_id", F.xxhash64("item_id", "text").alias("_k"), words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    own = own.select("item_id", "_k", lowered(F.col("_w")).alias("w"), F.least(F.size("_w"), F.lit(width)).alias("need"), (folded(F.col("_w")) if width == 1 else shingles(folded(F.col("_w")))).alias("_s"))
    own = cut(own, "items")
    spot = own.select("_k", F.posexplode("_s").alias("pos", "key"))
    vocabulary = cut(spot.select("key").distinct(), "shingles")
    # an item of one word has one shingle, whose count doesn't matter
    few = [r["key"] for r in vocabulary.limit(PICKED_KEYS + 1).collect()]
    low = docs.select(words(fold(F.col("text"))).alias("_l"))
    if len(few) <= PICKED_KEYS:
        at = _places("_l", _found([k for k in few if " " in k]))
        counts = low.select(F.explode(F.transform(at, lambda i: F.concat_ws(" ", F.get("_l", i - 1), F.get("_l", i)))).alias("key"))
    else:
        counts = low.select(F.explode(shingles(F.col("_l"))).alias("key"))
        counts = counts.join(F.broadcast(vocabulary) if vocabulary.count() <= BROADCAST_SHINGLES else vocabulary, "key")
    counts = counts.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct("pos", F.coalesce("n", F.lit(0)).alias("n"), "key")
    ranked = spot.join(counts, "key", "left").groupBy("_k").agg(F.array_sort(F.collect_list(place)).alias("_t")).withColumnRenamed("_k", "_k2")
    window = lambda at: F.array_min(F.transform(F.slice("_t", at, F.greatest(F.col("need") - 1, F.lit(1))), lambda x: F.struct(x["n"], x["key"], x["pos"])))
    chosen = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("need") + 1), window))
    pos = lambda c: c["pos"] + 1
    first = lambda c: F.greatest(F.lit(1), pos(c) - F.col("need") + 1)
    beside = lambda c: F.struct(  # noqa: E731  left is read outwards from the word
        c["key"].alias("key"), F.reverse(F.slice("w", first(c), pos(c) - first(c))).alias("left"), F.slice("w", pos(c) + 1, F.col("need") - 1).alias("right"), F.get("w", c["pos"]).alias("word"),
    )
    x = own.join(ranked, F.col("_k") == F.col("_k2"))
    return x.select("item_id", "need", F.explode(F.transform(chosen, beside)).alias("_c")).select("_c.key", "item_id", "need", "_c.left", "_c.right", "_c.word").distinct()


def _agree(theirs: Column, ours: Column) -> Column:
    """The number of leading words that are equal."""
    differ = F.filter(F.zip_with(theirs, ours, lambda a, b: ~a.eqNullSafe(b)), lambda x: x)
    first = F.array_position(F.zip_with(theirs, ours, lambda a, b: ~a.eqNullSafe(b)), True).cast("int")
    return F.when(F.size(differ) == 0, F.least(F.size(theirs), F.size(ours))).otherwise(first - 1)


def picked(d: DataFrame, keys: list[str]) -> DataFrame:
    """d (_w: words) with _at: the places, from 1, of these shingles; picked inside the scan of the documents."""
    pairs, single = [k for k in keys if " " in k], [k for k in keys if " " not in k]
    where = f"{_found(pairs)} OR _l[i - 1] IN ({_set(set(single))})" if single else _found(pairs)
    return d.withColumn("_l", folded(F.col("_w"))).withColumn("_at", _places("_w", where)).drop("_l")


def joined(d: DataFrame, prefix: DataFrame) -> DataFrame:
    """As picked(), for any number of shingles: the documents' shingles meet them by a shuffle, without their texts."""
    low = folded(F.col("_w"))
    spot = d.select("doc_id", "_h", F.posexplode(F.zip_with(shingles(low), low, lambda a, b: F.array_distinct(F.array(a, b)))).alias("_p", "_s")).select("doc_id", "_h", "_p", F.explode("_s").alias("key"))
    spot = spot.join(prefix.select("key").distinct(), "key", "left_semi")
    per = spot.groupBy(F.col("doc_id").alias("_id"), F.col("_h").alias("_h2")).agg(F.collect_set(F.col("_p") + 1).alias("_at"))
    return d.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_h2"))).drop("_id", "_h2")


def runs(docs: DataFrame, prefix: DataFrame, width: int = WIDTH, most_keys: int = PICKED_KEYS, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, _h, item_id, first, last: confirmed runs of words, numbered from 1. prefix: a written table."""
    d = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_h"), words(F.col("text")).alias("_w"))
    keys = [r["key"] for r in prefix.select("key").distinct().limit(most_keys + 1).collect()]
    d = picked(d, keys) if len(keys) <= most_keys else joined(d, prefix)
    low = lambda i: F.greatest(F.lit(1), i - (width - 1))
    around = F.transform("_at", lambda i: F.struct(i.alias("p"), F.get("_w", i - 1).alias("x"), F.reverse(F.slice("_w", low(i), i - low(i))).alias("l"), F.slice("_w", i + 1, width - 1).alias("r")))
    d = d.select("doc_id", "_h", F.size("_w").alias("_n"), F.explode(around).alias("_c")).select("doc_id", "_h", "_n", "_c.*")
    d = d.withColumn("_x", fold(F.col("x"))).withColumn("_next", fold(F.get("r", F.lit(0))))
    d = d.withColumn("_key", F.explode(F.array_distinct(F.array(F.concat_ws(" ", "_x", "_next"), "_x"))))
    # length and positional bounds: a window of so many words fits in the text with this word at its place
    fits = (F.col("_n") >= F.col("need")) & (F.size("l") + F.size("r") + 1 >= F.col("need"))
    p = F.broadcast(prefix) if prefix.count() <= most_rows else prefix
    found = d.join(p, (F.col("_key") == F.col("key")) & fits).where(F.translate("x", UPPER, LOWER) == F.col("word"))
    found = found.select("doc_id", "_h", "item_id", "p", "need", _agree(F.col("left"), lowered(F.col("l"))).alias("_l"), _agree(F.col("right"), lowered(F.col("r"))).alias("_r"))
    return found.where(F.col("_l") + F.col("_r") + 1 >= F.col("need")).select("doc_id", "_h", "item_id", (F.col("p") - F.col("_l")).alias("first"), (F.col("p") + F.col("_r")).alias("last"))


def covered(spans: Column) -> Column:
    """How many words sorted spans (first, last) cover."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"] - 1, acc["end"]))).alias("n"), F.greatest(acc["end"], s["last"]).alias("end"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def hits(docs: DataFrame, items: DataFrame, width: int = WIDTH, most_keys: int = PICKED_KEYS, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, _h, spans (sorted, of hit words), item_ids (sorted as strings): documents with a window only."""
    prefix = cut(prefixes(docs, items, width), "prefixes")
    found = runs(docs, prefix, width, most_keys, most_rows)
    return found.groupBy("doc_id", "_h").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))


def remove(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold a window; their columns stay as they are."""
    i, t = private(docs, stem="_id"), private(docs, stem="_text")
    h = hits(docs, items).select(F.col("doc_id").alias(i), F.col("_h").alias(t))
    return docs.join(h, F.col("doc_id").eqNullSafe(F.col(i)) & (F.coalesce(F.xxhash64("text"), F.lit(0)) == F.col(t)), "left_anti")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of op2."""
    h = hits(docs, items).select(F.col("doc_id").alias("_id"), F.col("_h").alias("_t"), "spans", "item_ids")
    every = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_h"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce(covered(F.col("spans")), F.lit(0).cast("long"))
    return every.join(h, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_t")), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("item_ids", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
