"""Retrieval quality, batched over queries: NDCG, F1, token recall, reciprocal rank, probes and duplicate rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions.text import word_count, words
from quillmesh.operators.vectors import dot


def dcg(relevance: Column, rank: Column) -> Column:
    return F.sum(relevance / F.log2(rank + 1))


def ndcg(results: DataFrame, ideal: DataFrame, k: int = 10) -> DataFrame:
    """results (qid, rnk, rel), ideal (qid, rel) -> qid, ndcg; 0 where the ideal has no gain. ideal may hold more than was returned."""
    order = W.partitionBy("qid").orderBy(F.col("rel").desc())
    best = ideal.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).groupBy("qid").agg(dcg(F.col("rel"), F.col("_r")).alias("_best"))
    own = results.where(F.col("rnk") <= k).groupBy("qid").agg(dcg(F.col("rel"), F.col("rnk")).alias("_own"))
    return best.join(own, "qid", "left").select("qid", F.when(F.col("_best") > 0, F.coalesce("_own", F.lit(0.0)) / F.col("_best")).otherwise(0.0).alias("ndcg"))


def dcg_ratio(results: DataFrame, n_gold: DataFrame, k: int = 10) -> DataFrame:
    """DCG over that of min(n_gold, k) relevant items; not bounded by 1, as more items than gold ones may score."""
    own = results.where(F.col("rnk") <= k).groupBy("qid").agg(dcg(F.col("rel"), F.col("rnk")).alias("_own"))
    best = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(k))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return n_gold.where("n_gold > 0").join(own, "qid", "left").select("qid", (F.coalesce("_own", F.lit(0.0)) / best).alias("dcg_ratio"))


def f1_at(results: DataFrame, relevant: DataFrame, k: int = 3) -> DataFrame:
    """results (qid, doc, rnk), relevant (qid, doc) -> qid, f1; recall is over min(relevant, k)."""
    got = results.where(F.col("rnk") <= k).select("qid", "doc")
    n = relevant.distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("_rel"))
    returned = got.groupBy("qid").agg(F.count(F.lit(1)).alias("_got"))
    hit = got.distinct().join(relevant.distinct(), ["qid", "doc"]).groupBy("qid").agg(F.count(F.lit(1)).alias("_hit"))
    x = n.join(returned, "qid", "left").join(hit, "qid", "left").na.fill(0, ["_got", "_hit"])
    p, r = F.col("_hit") / F.greatest("_got", F.lit(1)), F.col("_hit") / F.least("_rel", F.lit(k))
    return x.select("qid", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def token_recall(pairs: DataFrame, gold: str, candidate: str) -> DataFrame:
    """pairs (id, gold, candidate) -> id, recall: the part of gold's words, with repeats, that the candidate has."""
    side = lambda c: pairs.select("id", F.explode(words(F.lower(F.col(c)))).alias("w")).groupBy("id", "w").agg(F.count(F.lit(1)).alias(c))
    both = side(gold).join(side(candidate), ["id", "w"], "left")
    return both.groupBy("id").agg((F.sum(F.least(F.col(gold), F.coalesce(F.col(candidate), F.lit(0)))) / F.sum(gold)).alias("recall"))


def reciprocal_rank(results: DataFrame, known: DataFrame) -> DataFrame:
    """results (qid, doc, rnk), known (qid, doc) -> qid, rr, found_at (null if absent)."""
    hit = results.join(known, ["qid", "doc"]).groupBy("qid").agg(F.min("rnk").alias("found_at"))
    return known.select("qid").distinct().join(hit, "qid", "left").select("qid", F.coalesce(1 / F.col("found_at"), F.lit(0.0)).alias("rr"), "found_at")


def known_items(rows: DataFrame, n: int, least: int = 60, take: int = 45) -> DataFrame:
    """Pseudo-queries (qid, text, doc): the first words of n rows, drawn by a hash of row_id."""
    x = rows.where(word_count(F.col("text")) >= least).orderBy(F.md5(F.col("row_id").cast("string"))).limit(n)
    return x.select(F.col("row_id").alias("qid"), F.array_join(F.slice(words(F.col("text")), 1, take), " ").alias("text"), "doc")


def title_queries(docs: DataFrame, n: int, least: int = 15) -> DataFrame:
    """Pseudo-queries (qid, text, doc) from titles, one for each document."""
    x = docs.where(F.length("title") >= least).groupBy("doc").agg(F.min("title").alias("title")).orderBy(F.md5(F.col("doc").cast("string"))).limit(n)
    return x.select(F.col("doc").alias("qid"), F.col("title").alias("text"), "doc")


def probe(results: DataFrame, known: DataFrame) -> DataFrame:
    """One row: recall at 3 and 10, mean reciprocal rank and NDCG at 10 of known items."""
    at = reciprocal_rank(results, known)
    gain = F.when(F.col("found_at") <= 10, 1 / F.log2(F.col("found_at") + 1)).otherwise(0.0)
    share = lambda k: F.avg((F.coalesce("found_at", F.lit(1 << 30)) <= k).cast("double"))
    return at.agg(share(3).alias("recall_3"), share(10).alias("recall_10"), F.avg("rr").alias("mrr"), F.avg(gain).alias("ndcg_10"), F.count(F.lit(1)).alias("n"))


def coherence(results: DataFrame, expected: DataFrame, classes: DataFrame) -> DataFrame:
    """Share of queries whose first document is of the expected class, and of all returned documents that are."""
    x = results.join(expected.select("qid", F.col("class").alias("_want")), "qid").join(classes.select("doc", "class"), "doc", "left")
    ok = (F.coalesce("class", F.lit(0)) == F.col("_want")).cast("double")
    return x.agg(F.avg(F.when(F.col("rnk") == 1, ok)).alias("first"), F.avg(ok).alias("all"))


def class_of_query(number: Column) -> Column:
    """Queries 1-16, 17-32 and 33-50 belong to classes 1, 2 and 3; 0 for others."""
    return F.when(number.between(1, 16), 1).when(number.between(17, 32), 2).when(number.between(33, 50), 3).otherwise(0)


def file_key(name: Column) -> Column:
    """Letters and digits of a file name without its extension, lower-case."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"\.(pdf|json|csv|xlsx|txt|png|jpe?g|pbf)$", ""), "[^a-z0-9]", "")


#: The most bytes of names and their runs that are broadcast.
BROADCAST_BYTES = 16 << 20


def match_files(names: DataFrame, docs: DataFrame, size: int = 6) -> DataFrame:
    """names (name), docs (doc, file) -> name, doc: the first document whose key ends in, begins, or holds the other.

    A key that holds another has all runs of `size` of its characters: the pairs that are compared share the first run of
    the shorter key. Keys shorter than that meet as themselves, over every run of their length. Documents of one key meet
    once, as the first of them. Names of few bytes, by their counted letters, are broadcast and documents never leave the
    scan with their runs; of more names neither side is broadcast, whatever it shrinks to when it is compressed.
    """
    n = names.select("name", file_key(F.col("name")).alias("_n")).where("_n <> ''").distinct()
    d = docs.select("doc", file_key(F.col("file")).alias("_d")).where("_d <> ''").groupBy("_d").agg(F.min("doc").alias("doc"))
    a_run = F.length("_n").cast("long") + F.length("name") + size + 64
    few = n.agg(F.coalesce(F.sum(size * F.length("_n") * a_run), F.lit(0))).first()[0] <= BROADCAST_BYTES

    def meeting(inner: DataFrame, i: str, outer: DataFrame, o: str) -> DataFrame:
        """Pairs whose inner key stands in the outer one, of all lengths up to size and beyond."""
        k = F.least(F.length(i), F.lit(size))
        short = inner.withColumn("_gram", F.substring(F.col(i), F.lit(1), k))
        lengths = F.sequence(F.lit(1), F.least(F.lit(size), F.length(o)))
        grams = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), F.length(o) - m + 1), lambda p: F.substring(F.col(o), p, m))))
        runs = outer.withColumn("_gram", F.explode(F.array_distinct(grams)))
        own, other = (short, runs) if i == "_n" else (runs, short)
        return other.join(F.broadcast(own) if few else own.hint("merge"), "_gram").where(F.col(o).contains(F.col(i)))

    hit = meeting(n, "_n", d, "_d").select("name", "doc").unionAll(meeting(d, "_d", n, "_n").select("name", "doc"))
    return hit.groupBy("name").agg(F.min("doc").alias("doc"))


def holders(rows: DataFrame, items: DataFrame) -> DataFrame:
    """rows (row_id, text), items (qid, text) -> qid, row_id: rows that hold an item word for word.

    A text that holds an item has each piece between two of the item's blanks between two blanks, too. Rows meet an item
    if they have its longest such piece; only items without one are looked for in every row.
    """
    q = items.select("qid", F.col("text").alias("_t"), F.split("text", " ").alias("_p"))
    longest = F.reduce(F.expr("slice(_p, 2, size(_p) - 2)"), F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
    long = q.where(F.size("_p") > 2).select("qid", "_t", longest.alias("_piece"))
    short = q.where(F.size("_p") <= 2).select("qid", "_t")
    pieces = long.agg(F.collect_set("_piece").alias("_pieces"))
    near = rows.select("row_id", "text").join(F.broadcast(pieces)).select("row_id", "text", F.explode(F.array_intersect(F.split("text", " "), "_pieces")).alias("_piece"))
    out = near.join(F.broadcast(long), "_piece").where(F.col("text").contains(F.col("_t"))).select("qid", "row_id")
    if short.isEmpty():
        return out
    return out.unionAll(rows.join(F.broadcast(short), F.col("text").contains(F.col("_t"))).select("qid", "row_id"))


def diagnose(systems: dict[str, DataFrame], known: DataFrame) -> DataFrame:
    """The probe of every system (name -> qid, doc, rnk) on the same known items: a row for each."""
    rows = [probe(results, known).select(F.lit(name).alias("system"), "*") for name, results in systems.items()]
    return reduce(DataFrame.unionAll, rows)


def sweep(dense: DataFrame, lexical: DataFrame, grid: DataFrame, known: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of two lists (qid, row_id, rnk) for every (weight, k0) of a small grid, probed on known items.

    All settings are fused in one plan: the lists, short by nature, are joined with the grid.
    """
    both = dense.select("qid", "row_id", "rnk", F.lit(False).alias("_lexical")).unionAll(lexical.select("qid", "row_id", "rnk", F.lit(True)))
    gain = F.when(F.col("_lexical"), F.col("weight")).otherwise(1.0) / (F.col("k0") + F.col("rnk"))
    fused = both.join(F.broadcast(grid)).groupBy("weight", "k0", "qid", "row_id").agg(F.round(F.sum(gain), 9).alias("score"))
    place = F.row_number().over(W.partitionBy("weight", "k0", "qid").orderBy(F.col("score").desc(), "row_id"))
    at = fused.withColumn("rnk", place).join(known.select("qid", F.col("doc").alias("row_id")), ["qid", "row_id"]).groupBy("weight", "k0", "qid").agg(F.min("rnk").alias("at"))
    every = known.select("qid").distinct().join(F.broadcast(grid)).join(at, ["weight", "k0", "qid"], "left")
    return every.groupBy("weight", "k0").agg(F.avg((F.coalesce("at", F.lit(1 << 30)) <= 3).cast("double")).alias("recall_3"), F.avg(F.coalesce(1 / F.col("at"), F.lit(0.0))).alias("mrr"), F.count(F.lit(1)).alias("n"))


def against_gold(results: DataFrame, fragments: DataFrame, gold: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: F1 of documents, NDCG and fragment coverage, averaged over the questions that have a gold document.

    results (qid, doc, rnk, rel), fragments (qid, rnk, text), gold (qid, doc), wanted (qid, fragment): coverage is the share
    of a gold fragment's words that the returned fragments have.
    """
    texts = fragments.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rnk", "text"))), lambda x: x["text"]), " ").alias("_found"))
    asked = gold.select("qid").distinct()
    pairs = wanted.join(asked, "qid").join(texts, "qid", "left").select(F.col("qid").alias("id"), "fragment", F.coalesce("_found", F.lit("")).alias("_found"))
    cover = token_recall(pairs, "fragment", "_found").select(F.col("id").alias("qid"), F.col("recall").alias("_c"))
    f1 = f1_at(results, gold).select("qid", "f1")
    gain = ndcg(results, gold.withColumn("rel", F.lit(1.0))).select("qid", "ndcg")
    x = asked.join(f1, "qid", "left").join(gain, "qid", "left").join(cover.groupBy("qid").agg(F.avg("_c").alias("_c")), "qid", "left")
    zero = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    return x.agg(F.count(F.lit(1)).alias("n"), zero("f1").alias("f1_3"), zero("ndcg").alias("ndcg_10"), zero("_c").alias("coverage"))


def duplicate_rate(results: DataFrame, vectors: DataFrame, k: int = 3, threshold: float = 0.93) -> DataFrame:
    """qid, duplicate: whether two of the first k documents are above the threshold. vectors: doc, v."""
    x = results.where(F.col("rnk") <= k).select("qid", "doc").distinct().join(vectors.select("doc", "v"), "doc")
    few = x.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("doc", "v"))).alias("_d"))  # at most k of a query
    pairs = F.flatten(F.transform("_d", lambda a, i: F.transform(F.filter("_d", lambda b, j: j > i), lambda b: dot(a["v"], b["v"]))))
    got = few.select("qid", F.array_max(pairs).alias("_max"))
    return results.select("qid").distinct().join(got, "qid", "left").select("qid", (F.coalesce("_max", F.lit(-1.0)) > threshold).alias("duplicate"))


def percentile_row(values: DataFrame, column: str, share: float) -> DataFrame:
    """The value at place int(share * n) of the sorted values, from 0: by counts of values, not by sorting rows."""
    n = values.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("_n"))
    upto = n.withColumn("_upto", F.sum("_n").over(W.orderBy("value"))).withColumn("_all", F.sum("_n").over(W.partitionBy()))
    return upto.where(F.col("_upto") > F.floor(F.col("_all") * F.lit(share))).agg(F.min("value").alias("value"))
