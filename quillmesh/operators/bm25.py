"""BM25 as tables: postings (row_id, term, tf), lengths and document frequencies; all queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.operators import fusion

# Fixed values.
K1, B, MIN_DF = 1.5, 0.75, 2
TOKEN = r"[\p{L}\p{N}_]+"
BETWEEN = r"[^\p{L}\p{N}_]+"
CANDIDATES = 400


def tokens(text):
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def bags(rows: DataFrame) -> DataFrame:
    """rows (row_id, text) -> row_id, n: tokens, terms (term, tf), of every row. Tokens are sorted and counted in runs, without a shuffle."""

    def runs(t):
        start = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.get(t, i - 1) != F.get(t, i - 2)))
        end = lambda s, k: F.coalesce(F.get(s, k + 1), F.size(t) + 1)
        return F.get(F.transform(F.array(start), lambda s: F.transform(s, lambda x, k: F.struct(F.get(t, x - 1).alias("term"), (end(s, k) - x).cast("long").alias("tf")))), F.lit(0))

    # the tokens are bound to a variable, so that they are found once
    own = F.transform(F.array(F.sort_array(tokens(F.col("text")))), lambda t: F.struct(F.size(t).cast("long").alias("n"), F.when(F.size(t) > 0, runs(t)).alias("terms")))
    return rows.select("row_id", F.get(own, F.lit(0)).alias("_b")).select("row_id", "_b.n", "_b.terms")


def terms_of(bag: DataFrame) -> DataFrame:
    """bags -> row_id, term, tf."""
    return bag.select("row_id", F.explode("terms").alias("_t")).select("row_id", "_t.*")


def counted(rows: DataFrame) -> DataFrame:
    """rows (row_id, text) -> row_id, term, tf."""
    return terms_of(bags(rows))


#: The most distinct terms of queries that are broadcast.
BROADCAST_TERMS = 200_000
#: Writes a table and reads it again, for what a plan needs more than once; a name tells tables apart.
Keep = Callable[[DataFrame, str], DataFrame]


def index(rows: DataFrame, min_df: int = MIN_DF, queries: DataFrame | None = None, keep: Keep = lambda df, _: df) -> tuple[DataFrame, DataFrame]:
    """rows (row_id, text) -> postings (term, row_id, tf, df), lengths (row_id, len: words of the vocabulary, n, avgdl).

    Of given queries (qid, text), only the terms' postings are kept: they meet the rows before any shuffle.
    keep: with it, texts are cut into tokens once and lengths are counted once, or else wherever the plan needs them.
    """
    return index_of(keep(bags(rows), "bags"), min_df, queries, keep)


def index_of(bag: DataFrame, min_df: int = MIN_DF, queries: DataFrame | None = None, keep: Keep = lambda df, _: df) -> tuple[DataFrame, DataFrame]:
    """The index of bags() of rows."""
    tf = terms_of(bag)
    per = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.min("row_id").alias("row_id"), F.min("tf").alias("tf"))
    if min_df == 2:  # a term outside the vocabulary has one row, which its group knows
        rare = per.where("df = 1").groupBy("row_id").agg(F.sum("tf").alias("_rare"))
    else:
        rare = tf.join(per.where(F.col("df") < min_df).select("term"), "term", "left_semi").groupBy("row_id").agg(F.sum("tf").alias("_rare"))
    own = keep(bag.select("row_id", "n").join(rare, "row_id", "left").select("row_id", (F.col("n") - F.coalesce("_rare", F.lit(0))).alias("len")).where("len > 0"), "lengths")
    n = bag.agg(F.count(F.lit(1)).alias("n"))
    total = own.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("total"))
    corpus = n.join(total).select("n", (F.col("total") / F.col("n")).alias("avgdl"))  # one row each
    known = lambda df: df.where(F.col("df") >= min_df).select("term", "df")
    own = own.join(F.broadcast(corpus))
    if queries is None:
        return tf.join(known(per), "term"), own
    asked = queries.select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    few = asked.count() <= BROADCAST_TERMS
    df = known(tf.join(F.broadcast(asked) if few else asked, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    return tf.join(F.broadcast(df) if few else df, "term"), own


def scores(queries: DataFrame, postings: DataFrame, lengths: DataFrame) -> DataFrame:
    """queries (qid, text) -> qid, row_id, score over the distinct terms of each query.

    Scores are rounded to nine places, so that equal texts tie however their terms were added up. Postings get their lengths
    before they meet the queries: what is shuffled doesn't grow with the queries that share a term.
    """
    q = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    hit = postings.join(lengths, "row_id").join(q, "term")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.greatest("avgdl", F.lit(1e-9))))
    return hit.groupBy("qid", "row_id").agg(F.round(F.sum(idf * gain), 9).alias("score"))


def search(queries: DataFrame, postings: DataFrame, lengths: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """qid, row_id, score, rnk: positive scores, the k best of each query."""
    w = W.partitionBy("qid").orderBy(F.col("score").desc(), F.col("row_id"))
    return scores(queries, postings, lengths).where("score > 0").withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)


def hybrid(dense: DataFrame, lexical: DataFrame, weight: float = 1.0, k: int = 60) -> DataFrame:
    """Reciprocal ranks of the k best of both lists; the lexical list has the given weight."""
    lists = dense.where(F.col("rnk") <= k).select("qid", "row_id", "score", "rnk", F.lit("dense").alias("list_id"), F.lit(1.0).alias("weight"))
    return fusion.fuse(lists.unionByName(lexical.where(F.col("rnk") <= k).select("qid", "row_id", "score", "rnk", F.lit("lexical").alias("list_id"), F.lit(float(weight)).alias("weight"))))
