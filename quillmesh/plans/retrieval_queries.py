"""BM25, hybrid ranking, diversity, expansion and quality measures; queries are the benchmark's texts, all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import bm25, encoders, evaluation, fusion, ranking, vectors
from quillmesh.plans.registry import query, read, release, scratch, written
from quillmesh.sources import sinks

TOKENS = f"regexp_extract_all(lower(text), '{bm25.TOKEN}')"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text", F.col("source").alias("doc"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of all documents, which are cut into tokens once."""
    return written(bm25.bags(_rows(spark, sf_dir)), "bags")


def _found(questions: DataFrame, bag: DataFrame, k: int) -> DataFrame:
    """The lexical list, written: it is short, and plans use it more than once."""
    kept = []
    keep = lambda df, name: kept.append(written(df, name)) or kept[-1]
    out = written(bm25.search(questions, *bm25.index_of(bag, queries=questions, keep=keep), k), "lexical")
    for x in kept:
        release(x)
    return out


def lexical(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    bag = _bags(spark, sf_dir)
    out = _found(_questions(spark, sf_dir), bag, k)
    release(bag)
    return out


def _bm25_sql(questions: str) -> str:
    """Tables of the BM25 program; questions: SQL of (qid, text)."""
    return f"""
    questions AS ({questions}),    tok AS (SELECT doc_id AS row_id, source AS doc, unnest({TOKENS}) AS term FROM documents), tf AS (SELECT row_id, doc, term, count(*) AS tf FROM tok GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), post AS (SELECT tf.*, df FROM tf JOIN df USING (term)),
    len AS (SELECT row_id, sum(tf) AS len FROM post GROUP BY row_id), corpus AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(len) FROM len) / (SELECT count(*) FROM documents)::DOUBLE AS avgdl),
    qt AS (SELECT DISTINCT qid, unnest({TOKENS}) AS term FROM questions),
    bs AS (SELECT qid, row_id, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avgdl))), 9) AS score
      FROM qt JOIN post USING (term) JOIN len USING (row_id), corpus GROUP BY qid, row_id, doc),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rnk FROM bs WHERE score > 0)"""


_BM25 = _bm25_sql("SELECT item_id AS qid, text FROM benchmark")


@query(f"WITH {_BM25} SELECT qid, row_id, round(score, 6) AS score, rnk FROM ranked WHERE rnk <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(spark, sf_dir, 10).select("qid", "row_id", F.round("score", 6).alias("score"), F.col("rnk").cast("long"))


@query(f"WITH {_BM25}, d AS (SELECT qid, doc, max(score) AS score FROM ranked WHERE rnk <= 400 GROUP BY qid, doc) SELECT qid, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rnk FROM d QUALIFY rnk <= 3")
def bm25_doc_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ranking.roll_up(lexical(spark, sf_dir, 400), _rows(spark, sf_dir))
    return ranking.top_documents(docs).select("qid", "doc", F.round("score", 6).alias("score"), F.col("rnk").cast("long"))


def _shared(spark: SparkSession, sf_dir: str, k: int, bag: DataFrame) -> DataFrame:
    """A second list, written: distinct tokens that a document shares with the query."""
    q = _questions(spark, sf_dir).select("qid", F.explode(F.array_distinct(bm25.tokens(F.col("text")))).alias("term"))
    d = bm25.terms_of(bag).select("row_id", "term").join(F.broadcast(q.select("term").distinct()), "term", "left_semi").repartition("row_id")
    n = d.join(F.broadcast(q), "term").groupBy("qid", "row_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return written(vectors.ranked(n, "qid", "row_id").where(F.col("rnk") <= k), "shared")


def both_lists(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The shared and the lexical list, of the same terms."""
    bag = _bags(spark, sf_dir)
    out = _shared(spark, sf_dir, k, bag), _found(_questions(spark, sf_dir), bag, k)
    release(bag)
    return out


_HYBRID = f"""{_BM25}, sh AS (SELECT qid, row_id, count(DISTINCT term)::DOUBLE AS score FROM qt JOIN tf USING (term) GROUP BY qid, row_id),
    sr AS (SELECT qid, row_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, row_id) AS rnk FROM sh),
    h AS (SELECT qid, row_id, sum(w / (60 + rnk)) AS score FROM (SELECT qid, row_id, rnk, 1.0 AS w FROM sr WHERE rnk <= 60 UNION ALL SELECT qid, row_id, rnk, 0.5 AS w FROM ranked WHERE rnk <= 60) GROUP BY qid, row_id)"""


@query(f"WITH {_HYBRID} SELECT qid, row_id, round(score, 6) AS score FROM h")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.hybrid(*both_lists(spark, sf_dir, 60), 0.5).select("qid", "row_id", F.round("score", 6).alias("score"))


_TOC = "CASE WHEN row_id % 3 = 0 THEN text || chr(10) || 'One ..... 1' || chr(10) || 'Two ...... 9' ELSE text END"


@query(f"""
    WITH {_BM25}, t AS (SELECT r.qid, r.row_id, rnk, len(regexp_extract_all(CASE WHEN r.row_id % 3 = 0 THEN d.text || ' One ..... 1 Two ...... 9' ELSE d.text END, '\\.{{4,}}')) >= 2 AS toc FROM ranked r JOIN documents d ON d.doc_id = r.row_id WHERE rnk <= 30)
    SELECT qid, row_id, row_number() OVER (PARTITION BY qid ORDER BY toc, rnk) AS rnk FROM t""".replace("\\\\", "\\"))
def toc_demote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document gets the look of a contents page."""
    rows = _rows(spark, sf_dir)
    rows = rows.withColumn("text", F.when(F.col("row_id") % 3 == 0, F.concat("text", F.lit(" One ..... 1 Two ...... 9"))).otherwise(F.col("text")))
    return ranking.contents_last(lexical(spark, sf_dir, 30), rows).select("qid", "row_id", F.col("rnk").cast("long").alias("rnk"))


_W = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> '')"
_GRAMS = lambda x: f"list_distinct(list_transform(range(1, greatest(len({_W(x)}) - 2, 1) + 1), lambda i: array_to_string(({_W(x)})[i:i + 2], ' ')))"


@query(f"""
    WITH c AS (SELECT conv_id, turn, {_GRAMS("text")} AS g FROM conversations)
    SELECT l.conv_id, l.turn, round(CASE WHEN least(len(l.g), len(r.g)) = 0 THEN 0 ELSE len(list_intersect(l.g, r.g)) / least(len(l.g), len(r.g))::DOUBLE END, 6) AS overlap FROM c l JOIN c r ON l.conv_id = r.conv_id AND r.turn = l.turn + 1""")
def trigram_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", ranking.trigrams(F.col("text")).alias("g"))
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("g").alias("h"))
    return c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", F.round(ranking.overlap(F.col("g"), F.col("h")), 6).alias("overlap"))


@query()
def neighbor_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, grown by its neighbours."""
    rows = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.coalesce("text", F.lit("")).alias("text"))
    got = ranking.expand(rows.select("row_id"), rows)
    return got.select("row_id", T.word_count(F.col("text")).cast("long").alias("n_words"), F.md5("text").alias("digest"))


@query("SELECT source AS doc, arg_max(lang, (n, -first)) AS lang FROM (SELECT source, coalesce(lang, 'und') AS lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL) GROUP BY source".replace("arg_max(lang, (n, -first))", "list(lang ORDER BY n DESC, first)[1]"))
def doc_mode_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.majority_language(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("source").alias("doc"), "lang"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, row_id): documents that hold an item word for word, written."""
    return written(evaluation.holders(_rows(spark, sf_dir), _questions(spark, sf_dir)), "gold")


_GOLD = "gold AS (SELECT item_id AS qid, doc_id AS row_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    gold = _gold(spark, sf_dir)
    hits = lexical(spark, sf_dir, 10).join(gold.withColumn("_g", F.lit(1.0)), ["qid", "row_id"], "left").select("qid", "row_id", "rnk", F.coalesce("_g", F.lit(0.0)).alias("rel"))
    return hits, gold


@query(f"""
    WITH {_BM25}, {_GOLD}, i AS (SELECT qid, least(count(*), 10) AS n FROM gold GROUP BY qid), best AS (SELECT qid, list_sum(list_transform(range(1, n + 1), lambda k: 1 / log2(k + 1))) AS b FROM i),
    own AS (SELECT r.qid, sum(1 / log2(rnk + 1)) AS o FROM ranked r JOIN gold g ON g.qid = r.qid AND g.row_id = r.row_id WHERE rnk <= 10 GROUP BY r.qid)
    SELECT best.qid, round(coalesce(o, 0) / b, 6) AS ndcg FROM best LEFT JOIN own ON own.qid = best.qid""")
def ndcg_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, gold = _judged(spark, sf_dir)
    return evaluation.ndcg(hits, gold.withColumn("rel", F.lit(1.0))).select("qid", F.round("ndcg", 6).alias("ndcg"))


@query(f"""
    WITH {_BM25}, {_GOLD}, n AS (SELECT qid, count(*) AS rel FROM gold GROUP BY qid), got AS (SELECT qid, count(*) AS got FROM ranked WHERE rnk <= 3 GROUP BY qid),
    hit AS (SELECT r.qid, count(*) AS hit FROM ranked r JOIN gold g ON g.qid = r.qid AND g.row_id = r.row_id WHERE rnk <= 3 GROUP BY r.qid),
    x AS (SELECT n.qid, coalesce(hit, 0) / greatest(coalesce(got, 0), 1)::DOUBLE AS p, coalesce(hit, 0) / least(rel, 3)::DOUBLE AS r FROM n LEFT JOIN got ON got.qid = n.qid LEFT JOIN hit ON hit.qid = n.qid)
    SELECT qid, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM x""")
def f1_at_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, gold = _judged(spark, sf_dir)
    got = evaluation.f1_at(hits.withColumnRenamed("row_id", "doc"), gold.withColumnRenamed("row_id", "doc"))
    return got.select("qid", F.round("f1", 6).alias("f1"))


@query(f"""
    WITH {_BM25}, {_GOLD}, k AS (SELECT qid, min(row_id) AS row_id FROM gold GROUP BY qid), a AS (SELECT k.qid, r.rnk FROM k LEFT JOIN ranked r ON r.qid = k.qid AND r.row_id = k.row_id AND r.rnk <= 10)
    SELECT round(avg(CASE WHEN rnk <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(CASE WHEN rnk <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(1.0 / rnk, 0)), 6) AS mrr,
      round(avg(CASE WHEN rnk <= 10 THEN 1 / log2(rnk + 1) ELSE 0 END), 6) AS ndcg_10, count(*) AS n FROM a""")
def mrr_known_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, gold = _judged(spark, sf_dir)
    known = gold.groupBy("qid").agg(F.min("row_id").alias("doc"))
    p = evaluation.probe(hits.withColumnRenamed("row_id", "doc"), known)
    return p.select(*(F.round(c, 6).alias(c) for c in ("recall_3", "recall_10", "mrr", "ndcg_10")), "n")


@query(f"""
    WITH c AS (SELECT conv_id, turn, text FROM conversations), p AS (SELECT l.conv_id * 1000 + l.turn AS id, l.text AS g, r.text AS c FROM c l JOIN c r ON l.conv_id = r.conv_id AND r.turn = l.turn + 1),
    a AS (SELECT id, unnest({_W("g")}) AS w FROM p), b AS (SELECT id, unnest({_W("c")}) AS w FROM p), ga AS (SELECT id, w, count(*) AS n FROM a GROUP BY ALL), gb AS (SELECT id, w, count(*) AS m FROM b GROUP BY ALL)
    SELECT ga.id, round(sum(least(n, coalesce(m, 0))) / sum(n)::DOUBLE, 6) AS recall FROM ga LEFT JOIN gb ON gb.id = ga.id AND gb.w = ga.w GROUP BY ga.id""")
def token_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    p = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("c")), ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("g"), "c")
    return evaluation.token_recall(p, "g", "c").select("id", F.round("recall", 6).alias("recall"))


_ABLATION = lambda name, gain: f"SELECT '{name}' AS method, qid, row_id, {gain} AS score FROM l GROUP BY qid, row_id"


@query(f"""
    WITH {_HYBRID}, {_GOLD}, l0 AS (SELECT qid, row_id, score, rnk, 'a' AS list_id FROM ranked WHERE rnk <= 60 UNION ALL SELECT sh.qid, sh.row_id, sh.score, sr.rnk, 'b' FROM sh JOIN sr ON sh.qid = sr.qid AND sh.row_id = sr.row_id WHERE sr.rnk <= 60),
    l AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-9 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS m FROM l0 WINDOW w AS (PARTITION BY qid, list_id)),
    f AS ({_ABLATION("rrf", "sum(1.0 / (60 + rnk))")} UNION ALL {_ABLATION("combsum", "sum(m)")} UNION ALL {_ABLATION("combmnz", "sum(m) * count(*)")}),
    r AS (SELECT *, row_number() OVER (PARTITION BY method, qid ORDER BY round(score, 9) DESC, row_id) AS rnk FROM f), k AS (SELECT qid, min(row_id) AS row_id FROM gold GROUP BY qid)
    SELECT method, round(avg(CASE WHEN r.rnk <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(coalesce(1.0 / r.rnk, 0)), 6) AS mrr FROM (SELECT DISTINCT method FROM f) JOIN k ON true LEFT JOIN r USING (method, qid, row_id) GROUP BY method""")
def ablation_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fusion on the same lists, judged on the same known items."""
    own, lex = both_lists(spark, sf_dir, 60)
    lists = lex.withColumn("list_id", F.lit("a")).unionByName(own.withColumn("list_id", F.lit("b")))
    known = _gold(spark, sf_dir).groupBy("qid").agg(F.min("row_id").alias("doc"))
    out = None
    for method, fuse in fusion.FUSIONS.items():
        ranked = vectors.ranked(fuse(lists).withColumn("score", F.round("score", 9)), "qid", "row_id")
        p = evaluation.probe(ranked.withColumnRenamed("row_id", "doc"), known).select(F.lit(method).alias("method"), F.round("recall_3", 6).alias("recall_3"), F.round("mrr", 6).alias("mrr"))
        out = p if out is None else out.unionAll(p)
    return out


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result objects of every question from the lexical list; texts are first lines of documents."""
    rows = _rows(spark, sf_dir)
    hits = lexical(spark, sf_dir, 60)
    docs = ranking.top_documents(ranking.roll_up(hits, rows))
    frags = ranking.diverse_by_cap(hits, rows).join(rows.select("row_id", "text"), "row_id").select("qid", F.concat("doc", F.lit("-"), F.col("row_id").cast("string")).alias("chunk_id"), "doc", "text", "rnk")
    return sinks.result_objects(docs, frags)


@query(f"""
    WITH {_BM25}, d AS (SELECT qid, doc, max(score) AS score FROM ranked WHERE rnk <= 60 GROUP BY qid, doc), t AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS r FROM d QUALIFY r <= 3),
    j AS (SELECT qid, '[' || string_agg('{{"rank":' || r || ',"doc_id":"' || doc || '"}}', ',' ORDER BY r) || ']' AS documents FROM t GROUP BY qid),
    c AS (SELECT qid, row_number() OVER (PARTITION BY qid, doc ORDER BY rnk) AS k FROM ranked WHERE rnk <= 60), f AS (SELECT qid, least(count(*), 10)::INTEGER AS n_fragments FROM c WHERE k <= 3 GROUP BY qid)
    SELECT j.qid AS query_id, documents, n_fragments FROM j JOIN f ON f.qid = j.qid""")
def result_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("query_id", F.to_json("documents").alias("documents"), F.size("fragments").alias("n_fragments"))


@query()
def encode_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions against documents in the space of the stand-in encoder, exact."""
    e = encoders.ENCODERS["hash_a"]
    d = encoders.encode(_rows(spark, sf_dir), e, "text").select("row_id", "v")
    q = encoders.encode(_questions(spark, sf_dir), e, "text", is_query=True)
    return vectors.top_k(q, d, 10).withColumn("score", F.round("score", 6))


@query(f"""
    WITH n AS (SELECT source, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM documents), r AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS k, count(*) OVER () AS n FROM n) SELECT w AS p90 FROM r WHERE k = floor(0.9 * n)""")
def percentile_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "documents").select(T.word_count(F.col("text")).cast("long").alias("w"))
    return evaluation.percentile_row(n, "w", 0.9).select(F.col("value").alias("p90"))


@query("SELECT k, CASE WHEN k BETWEEN 1 AND 16 THEN 1 WHEN k BETWEEN 17 AND 32 THEN 2 WHEN k BETWEEN 33 AND 50 THEN 3 ELSE 0 END AS class FROM (SELECT item_id AS k FROM benchmark)")
def query_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k"), evaluation.class_of_query(F.col("item_id")).alias("class"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS question FROM conversations")
def forward_fill_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.sources.records import forward_fill

    c = read(spark, sf_dir, "conversations")
    return forward_fill(c, "conv_id", "turn", "text", F.col("role") == "user", "question").select("conv_id", "turn", "question")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of streaming.ingest.activity."""
    from quillmesh.streaming.ingest import activity

    return activity(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))



@query()
def search_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question through chunks, three encoders, the entity graph, fusion, prior, copies, diversity and expansion.

    The tables of the index are written by search.build() in a folder of their own, which also keeps the plan short.
    """
    from pyspark.sql import functions as f

    from quillmesh.config import Settings
    from quillmesh.plans import graph_queries, search

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", (f.col("doc_id") % 3 + 1).alias("class"))
    settings = Settings().at(scratch(spark, "index"))
    search.build(docs, settings, f.broadcast(graph_queries._gaz(spark)))
    r = search.Retriever(spark, settings)
    found, frags = r.search(_questions(spark, sf_dir))
    return sinks.result_objects(found, frags).select("query_id", F.to_json("documents").alias("documents"), F.size("fragments").alias("n_fragments"))


_PROBE = """    d AS (SELECT qid, doc, max(score) AS score FROM ranked WHERE rnk <= 60 GROUP BY qid, doc), t AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS r FROM d QUALIFY r <= 10),
    a AS (SELECT k.qid, t.r FROM known k LEFT JOIN t ON t.qid = k.qid AND t.doc = k.doc)
    SELECT round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr,
      round(avg(CASE WHEN r <= 10 THEN 1 / log2(r + 1) ELSE 0 END), 6) AS ndcg_10, count(*) AS n FROM a"""
_KNOWN = f"SELECT doc_id AS qid, source AS doc, array_to_string(({_W('text').replace('lower(text)', 'text')})[1:45], ' ') AS text FROM documents WHERE len({_W('text')}) >= 60 ORDER BY md5(doc_id::VARCHAR) LIMIT 200"
_TITLED = "SELECT source AS qid, source AS doc, substr(string_split(arg_min(text, doc_id), chr(10))[1], 1, 120) AS text FROM documents GROUP BY source HAVING length(substr(string_split(arg_min(text, doc_id), chr(10))[1], 1, 120)) >= 15 ORDER BY md5(source) LIMIT 200"


@query(f"WITH known AS ({_KNOWN}), {_bm25_sql('SELECT qid, text FROM known')}, {_PROBE}")
def known_item_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of documents as queries; how well the lexical list finds their documents again."""
    rows = _rows(spark, sf_dir)
    known = written(evaluation.known_items(rows, 200), "known")
    bag = _bags(spark, sf_dir)
    hits = _found(known.select("qid", "text"), bag, 60)
    release(bag)
    docs = ranking.top_documents(ranking.roll_up(hits, rows), 10)
    return evaluation.probe(docs.select("qid", "doc", "rnk"), known.select("qid", "doc")).select(*(F.round(c, 6).alias(c) for c in ("recall_3", "recall_10", "mrr", "ndcg_10")), "n")


@query(f"WITH known AS ({_TITLED}), {_bm25_sql('SELECT qid, text FROM known')}, {_PROBE}")
def title_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of sources as queries."""
    rows = _rows(spark, sf_dir)
    titles = rows.groupBy("doc").agg(F.substring(F.get(F.split(F.min_by("text", "row_id"), "\n"), F.lit(0)), 1, 120).alias("title"))
    known = written(evaluation.title_queries(titles, 200), "known")
    bag = _bags(spark, sf_dir)
    hits = _found(known.select("qid", "text"), bag, 60)
    release(bag)
    docs = ranking.top_documents(ranking.roll_up(hits, rows), 10)
    return evaluation.probe(docs.select("qid", "doc", "rnk"), known.select("qid", "doc")).select(*(F.round(c, 6).alias(c) for c in ("recall_3", "recall_10", "mrr", "ndcg_10")), "n")
