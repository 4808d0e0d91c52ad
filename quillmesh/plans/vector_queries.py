"""Vector search, centroids, similarity joins, fusion and roll-up over the embeddings table.

A vector is a chunk: its document is vec_id mod 50 and its class label mod 3 + 1. Queries are the vectors whose id is
divisible by 50, against all vectors. A second list stands for a second encoder: the first half of the elements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import evaluation, fusion, ranking, vectors
from quillmesh.plans.registry import query, read

K = 20


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v"), (F.col("vec_id") % 50).alias("doc"), (F.col("label") % 3 + 1).alias("class"), "label")


def _queries(rows: DataFrame) -> DataFrame:
    return rows.where("row_id % 50 = 0").select(F.col("row_id").alias("qid"), "v")


def _half(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.slice("v", 1, 32))


def lists(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    rows = _rows(spark, sf_dir)
    q = _queries(rows)
    whole = vectors.top_k(q, rows, k).withColumn("list_id", F.lit("whole"))
    return whole.unionByName(vectors.top_k(_half(q), _half(rows), k).withColumn("list_id", F.lit("half")))


_BASE = "e AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS v, vec_id % 50 AS doc, label % 3 + 1 AS class FROM embeddings), q AS (SELECT row_id AS qid, v FROM e WHERE row_id % 50 = 0)"
_LIST = lambda name, a, b, k=K: (
    f"SELECT '{name}' AS list_id, qid, row_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rnk FROM (SELECT q.qid, e.row_id, list_dot_product({a}, {b}) AS score FROM q, e) QUALIFY rnk <= {k}"
)
_LISTS = f"{_BASE}, l AS ({_LIST('whole', 'q.v', 'e.v')} UNION ALL {_LIST('half', 'q.v[1:32]', 'e.v[1:32]')})"
_RRF = f"{_LISTS}, f AS (SELECT qid, row_id, sum(1.0 / (60 + rnk)) AS score FROM l GROUP BY qid, row_id)"
_SCALED = f"{_LISTS}, m AS (SELECT list_id, qid, row_id, rnk, CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-9 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score FROM l WINDOW w AS (PARTITION BY qid, list_id))"


@query(f"WITH {_BASE} SELECT qid, row_id, round(score, 6) AS score, rnk FROM ({_LIST('whole', 'q.v', 'e.v', 10)})")
def vec_topk_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return vectors.top_k(_queries(rows), rows, 10).select("qid", "row_id", F.round("score", 6).alias("score"), F.col("rnk").cast("long"))


@query("SELECT vec_id AS row_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vec_norm_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("row_id", F.round(vectors.norm(F.col("v")), 6).alias("norm"))


@query("SELECT count(*) AS n, 0::BIGINT AS missing, true AS ok FROM embeddings")
def vec_reconstruct_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return vectors.verify(vectors.build_index(rows), rows).select("n", "missing", "ok")


_CENTROID = lambda key: f"""
    WITH x AS (SELECT {key} AS k, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings), m AS (SELECT k, pos, avg(x) AS x FROM x GROUP BY k, pos)
    SELECT k, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY k)), 6) AS x FROM m"""  # noqa: E731


def _centroid_rows(c: DataFrame, key: str) -> DataFrame:
    return c.select(F.col(key).alias("k"), F.posexplode("v").alias("p", "x")).select("k", (F.col("p") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(_CENTROID("label"))
def class_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centroid_rows(vectors.centroids(_rows(spark, sf_dir), "label"), "label")


@query(_CENTROID("vec_id % 50"))
def doc_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centroid_rows(vectors.centroids(_rows(spark, sf_dir), "doc"), "doc")


@query("""
    WITH x AS (SELECT label AS k, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings), m AS (SELECT k, pos, avg(x) AS x FROM x GROUP BY k, pos),
    u AS (SELECT k, pos, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS x FROM m)
    SELECT l.k AS a, r.k AS b, round(sum(l.x * r.x), 6) AS cosine FROM u l JOIN u r ON l.pos = r.pos GROUP BY l.k, r.k""")
def centroid_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = vectors.centroids(_rows(spark, sf_dir), "label")
    return vectors.similarity(c, c, "label").select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(f"WITH {_BASE}, p AS (SELECT l.row_id AS a, r.row_id AS b, list_dot_product(l.v, r.v) AS c FROM e l JOIN e r ON l.row_id < r.row_id) SELECT a, b, round(c, 6) AS cosine FROM p WHERE c > 0.4")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_pairs(_rows(spark, sf_dir), 0.4).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("""
    WITH o AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT vec_id AS row_id, vec_id % 3 = 0 AS changed, vec_id % 9 = 0 AS suspicious, round(CASE WHEN vec_id % 9 = 0 THEN -list_sum(v) WHEN vec_id % 3 = 0 THEN 2 * list_sum(v) ELSE list_sum(v) END, 5) AS total FROM o""")
def incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third vector is doubled, every ninth turned round; the latter is suspicious."""
    rows = _rows(spark, sf_dir).select("row_id", F.col("v").cast("array<double>").alias("v"))
    by = F.when(F.col("row_id") % 9 == 0, -1.0).otherwise(2.0)
    new = rows.where("row_id % 3 = 0").withColumn("_f", by).select("row_id", F.transform("v", lambda x: x * F.col("_f")).alias("v"))
    return vectors.upsert(rows, new).select("row_id", "changed", "suspicious", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(f"WITH {_RRF} SELECT qid, row_id, round(score, 6) AS score FROM f")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(lists(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {_SCALED} SELECT list_id, qid, row_id, round(score, 6) AS score FROM m")
def minmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.minmax(lists(spark, sf_dir)).select("list_id", "qid", "row_id", F.round("score", 6).alias("score"))


@query(f"WITH {_SCALED} SELECT qid, row_id, round(sum(score), 6) AS score FROM m GROUP BY qid, row_id")
def combsum_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.combsum(lists(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {_SCALED} SELECT qid, row_id, round(sum(score) * count(*), 6) AS score FROM m GROUP BY qid, row_id")
def combmnz_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.combmnz(lists(spark, sf_dir)).withColumn("score", F.round("score", 6))


_PRIOR = """
    x AS (SELECT class, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM e), c AS (SELECT class, pos, avg(x) AS x FROM x GROUP BY class, pos),
    u AS (SELECT class, pos, x / sqrt(sum(x * x) OVER (PARTITION BY class)) AS x FROM c), qx AS (SELECT qid, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM q),
    s AS (SELECT qid, class, sum(u.x * qx.x) AS s FROM qx JOIN u ON u.pos = qx.pos GROUP BY qid, class),
    g AS (SELECT qid, class, exp((s - max(s) OVER (PARTITION BY qid)) / 0.05) AS e FROM s), p AS (SELECT qid, class, 1 + 0.15 * e / sum(e) OVER (PARTITION BY qid) AS factor FROM g)"""


@query(f"WITH {_RRF}, {_PRIOR} SELECT f.qid, f.row_id, round(f.score * p.factor, 6) AS score FROM f JOIN e ON e.row_id = f.row_id JOIN p ON p.qid = f.qid AND p.class = e.class")
def class_prior_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    c = vectors.centroids(rows, "class").withColumn("slug", F.lit("whole"))
    prior = ranking.class_prior(_queries(rows).withColumn("slug", F.lit("whole")), c)
    return ranking.apply_prior(fusion.fuse(lists(spark, sf_dir)), rows, prior).select("qid", "row_id", F.round("score", 6).alias("score"))


_ROLL = lambda tail: f"""WITH {_RRF}, r AS (SELECT f.*, e.doc, row_number() OVER (PARTITION BY f.qid, e.doc ORDER BY f.score DESC, f.row_id) AS k FROM f JOIN e ON e.row_id = f.row_id)
    SELECT qid, doc, round(max(score) + {tail}, 6) AS score, min(row_id) FILTER (WHERE k = 1) AS best_row FROM r GROUP BY qid, doc"""  # noqa: E731


@query(_ROLL("0"))
def doc_rollup_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.roll_up(fusion.fuse(lists(spark, sf_dir)), _rows(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(_ROLL("0.35 * coalesce(sum(score) FILTER (WHERE k BETWEEN 2 AND 3), 0)"))
def doc_rollup_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.roll_up(fusion.fuse(lists(spark, sf_dir)), _rows(spark, sf_dir), 0.35, 2).withColumn("score", F.round("score", 6))


@query(f"""
    WITH {_RRF}, r AS (SELECT f.qid, e.doc, max(f.score) AS score FROM f JOIN e ON e.row_id = f.row_id GROUP BY f.qid, e.doc)
    SELECT qid, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rnk FROM r QUALIFY rnk <= 3""")
def retrieve_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: two exact lists, fused by reciprocal ranks, rolled up, three documents for each query."""
    docs = ranking.roll_up(fusion.fuse(lists(spark, sf_dir)), _rows(spark, sf_dir))
    return ranking.top_documents(docs).select("qid", "doc", F.round("score", 6).alias("score"), F.col("rnk").cast("long"))


@query(f"""
    WITH {_RRF}, o AS (SELECT f.*, e.doc, row_number() OVER (PARTITION BY f.qid ORDER BY f.score DESC, f.row_id) AS rnk FROM f JOIN e ON e.row_id = f.row_id),
    c AS (SELECT *, row_number() OVER (PARTITION BY qid, doc ORDER BY rnk) AS k FROM o)
    SELECT qid, row_id, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY rnk) AS rnk2 FROM c WHERE k <= 1 QUALIFY rnk2 <= 10""")
def diverse_topn_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ranking.diverse_by_cap(fusion.fuse(lists(spark, sf_dir)), _rows(spark, sf_dir), 10, 1)
    return got.select("qid", "row_id", "doc", F.round("score", 6).alias("score"), F.col("rnk").cast("long").alias("rnk2"))


_DOCS = f"""{_RRF}, r AS (SELECT f.qid, e.doc, max(f.score) AS score FROM f JOIN e ON e.row_id = f.row_id GROUP BY f.qid, e.doc),
    t AS (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rnk FROM r),
    dx AS (SELECT doc, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM e), dm AS (SELECT doc, pos, avg(x) AS x FROM dx GROUP BY doc, pos),
    dc AS (SELECT doc, pos, x / sqrt(sum(x * x) OVER (PARTITION BY doc)) AS x FROM dm), sim AS (SELECT a.doc AS a, b.doc AS b, sum(a.x * b.x) AS s FROM dc a JOIN dc b ON a.pos = b.pos GROUP BY a.doc, b.doc)"""


def _by_doc(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _rows(spark, sf_dir)
    return ranking.roll_up(fusion.fuse(lists(spark, sf_dir)), rows), vectors.centroids(rows, "doc")


@query(f"""
    WITH RECURSIVE {_DOCS}, near AS (SELECT y.qid, y.rnk, list(x.rnk) AS bad FROM t x JOIN t y ON x.qid = y.qid AND x.rnk < y.rnk JOIN sim ON sim.a = x.doc AND sim.b = y.doc WHERE s > 0.2 OR (x.doc % 2 <> y.doc % 2 AND s > 0.1) GROUP BY y.qid, y.rnk),
    k AS (SELECT t.qid, t.rnk, coalesce(bad, []) AS bad FROM t LEFT JOIN near ON near.qid = t.qid AND near.rnk = t.rnk),
    step AS (SELECT DISTINCT qid, 0::BIGINT AS n, []::BIGINT[] AS kept FROM k UNION ALL SELECT s.qid, s.n + 1, CASE WHEN len(kept) < 3 AND NOT list_has_any(kept, bad) THEN list_append(kept, rnk) ELSE kept END FROM step s JOIN k ON k.qid = s.qid AND k.rnk = s.n + 1),
    last AS (SELECT qid, kept FROM step QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n DESC) = 1),
    o AS (SELECT t.qid, t.doc, t.score, row_number() OVER (PARTITION BY t.qid ORDER BY NOT list_contains(kept, t.rnk), t.rnk) AS rnk FROM t JOIN last ON last.qid = t.qid)
    SELECT qid, doc, round(score, 6) AS score, rnk::INTEGER AS rnk FROM o WHERE rnk <= 3""")
def dedup_topn_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents without copies; thresholds are low, as no two of these centroids are near."""
    docs, c = _by_doc(spark, sf_dir)
    langs = c.select("doc", F.when(F.col("doc") % 2 == 0, "es").otherwise("pt").alias("lang"))
    return ranking.without_copies(docs, c.withColumn("slug", F.lit("whole")), langs, copy=0.2, translation=0.1).withColumn("score", F.round("score", 6))


@query(f"""
    WITH {_DOCS}, p AS (SELECT l.qid, max(s) AS s FROM t l JOIN t r ON l.qid = r.qid AND l.doc < r.doc AND l.rnk <= 3 AND r.rnk <= 3 JOIN sim ON sim.a = l.doc AND sim.b = r.doc GROUP BY l.qid)
    SELECT DISTINCT t.qid, coalesce(p.s, -1) > 0.15 AS duplicate FROM t LEFT JOIN p ON t.qid = p.qid""")
def dup_rate_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, c = _by_doc(spark, sf_dir)
    return evaluation.duplicate_rate(ranking.top_documents(docs), c, threshold=0.15)
