"""Validation rules with planted violations, comparisons of results, and diagnostics of whole systems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.operators import bm25, chunking, evaluation, graph, ranking, validation, vectors
from quillmesh.plans import graph_queries, retrieval_queries
from quillmesh.plans.registry import query, read, written

# Results made from orders: a query is a customer, its documents are the first three orders, its fragments line items.
# Planted: every 7th customer has a wrong rank, every 11th lacks its third document, every 5th a text of 260 words.
_O = "SELECT o_custkey AS q, o_orderkey AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders"
_D = f"d AS (SELECT q, d, r AS p, CASE WHEN q % 7 = 0 AND r = 2 THEN 9 ELSE r END AS rank FROM ({_O}) WHERE r <= CASE WHEN q % 11 = 0 THEN 2 ELSE 3 END)"
_F = """f AS (SELECT q, l_orderkey AS d, k AS p, k AS rank, CASE WHEN q % 5 = 0 AND k = 1 THEN 260 WHEN l_linenumber = 2 THEN 3 ELSE 20 END AS n FROM (SELECT o_custkey AS q, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE k <= 10)"""


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of one order may share a number; their places tell their fragments apart."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("d"))
    d = o.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("d"))).where(F.col("r") <= F.when(F.col("q") % 11 == 0, 2).otherwise(3))
    rank = F.when((F.col("q") % 7 == 0) & (F.col("r") == 2), 9).otherwise(F.col("r"))
    d = d.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", rank.alias("rank"), F.col("d").cast("string").alias("doc_id")))).alias("_d"))
    l = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("d"), "l_linenumber").join(o, "d")
    f = l.withColumn("k", F.row_number().over(W.partitionBy("q").orderBy("d", "l_linenumber"))).where("k <= 10")
    n = F.when((F.col("q") % 5 == 0) & (F.col("k") == 1), 260).when(F.col("l_linenumber") == 2, 3).otherwise(20)
    f = f.groupBy("q").agg(F.sort_array(F.collect_list(F.struct(F.col("k").alias("rank"), F.concat("d", F.lit("-"), "l_linenumber", F.lit("-"), "k").alias("chunk_id"), F.col("d").cast("string").alias("doc_id"), F.trim(F.repeat(F.lit("w "), n)).alias("text")))).alias("fragments"))
    docs = F.transform("_d", lambda x: F.struct(x["rank"].alias("rank"), x["doc_id"].alias("doc_id")))
    return d.join(f, "q").select(F.col("q").alias("query_id"), docs.alias("documents"), "fragments")


@query(f"""
    WITH {_D}, {_F}, nd AS (SELECT q, count(*) AS n FROM d GROUP BY q), nf AS (SELECT q, count(*) AS n, count(DISTINCT d) AS docs FROM f GROUP BY q)
    SELECT 'line_count' AS rule, 'error' AS severity, NULL::BIGINT AS qid, NULL AS item, count(*)::VARCHAR AS detail FROM nf UNION ALL
    SELECT 'document_count', 'error', nd.q, NULL, nd.n::VARCHAR FROM nd JOIN nf ON nf.q = nd.q WHERE nd.n <> 3 UNION ALL SELECT 'fragment_count', 'error', q, NULL, n::VARCHAR FROM nf WHERE n <> 10 UNION ALL
    SELECT 'document_rank', 'error', q, p::VARCHAR, rank::VARCHAR FROM d WHERE rank <> p AND q IN (SELECT q FROM nf) UNION ALL SELECT 'fragment_too_long', 'error', q, p::VARCHAR, n::VARCHAR FROM f WHERE n > 250 UNION ALL
    SELECT 'fragment_short', 'warning', q, p::VARCHAR, n::VARCHAR FROM f WHERE n < 10 UNION ALL SELECT 'one_document', 'warning', q, NULL, n::VARCHAR FROM nf WHERE docs = 1""")
def validate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule over results with planted violations."""
    return validation.result_violations(_planted(spark, sf_dir), -1)


@query(f"""
    WITH {_D}, {_F}, a AS (SELECT q, string_agg(d::VARCHAR, ',' ORDER BY p) AS d FROM d GROUP BY q), g AS (SELECT q, string_agg(p::VARCHAR, ',' ORDER BY p) AS f, count(*) AS n FROM f GROUP BY q)
    SELECT a.q AS query_id, a.q % 4 = 0 OR a.q % 6 = 1 AS documents_differ, n > 1 AND a.q % 3 = 0 OR a.q % 6 = 1 AS fragments_differ FROM a JOIN g ON g.q = a.q WHERE a.q % 4 = 0 OR a.q % 6 = 1 OR n > 1 AND a.q % 3 = 0""")
def result_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against results without every sixth query, with a document exchanged in every fourth and fragments reversed in every third."""
    left = _planted(spark, sf_dir)
    q = F.col("query_id")
    docs = F.when(q % 4 == 0, F.transform("documents", lambda d: F.struct(d["rank"].alias("rank"), F.concat(d["doc_id"], F.lit("x")).alias("doc_id")))).otherwise(F.col("documents"))
    right = left.where(q % 6 != 1).select("query_id", docs.alias("documents"), F.when(q % 3 == 0, F.reverse("fragments")).otherwise(F.col("fragments")).alias("fragments"))
    return validation.differences(left, right)


@query("""
    WITH m AS (SELECT doc_id AS row_id, CASE WHEN doc_id % 50 = 7 THEN NULL ELSE text END AS texto, CASE WHEN doc_id % 100 = 9 THEN 'c0' ELSE 'c' || doc_id END AS chunk_id FROM documents WHERE doc_id % 40 <> 3), v AS (SELECT doc_id AS row_id FROM documents WHERE doc_id % 60 <> 11)
    SELECT 'missing_field' AS rule, unnest(['fuente', 'formato', 'fenomeno', 'posicion', 'num_tokens']) AS detail UNION ALL SELECT 'null_field', 'texto: ' || count(*) FROM m WHERE texto IS NULL HAVING count(*) > 0 UNION ALL
    SELECT 'repeated_chunk', chunk_id FROM m GROUP BY chunk_id HAVING count(*) > 1 UNION ALL SELECT 'vector_without_row', row_id::VARCHAR FROM v WHERE row_id NOT IN (SELECT row_id FROM m) UNION ALL SELECT 'row_without_vector', row_id::VARCHAR FROM m WHERE row_id NOT IN (SELECT row_id FROM v)""")
def validate_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk table with missing fields, nulls, repeated ids, and rows that have no vector or the other way round."""
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    m = d.where(i % 40 != 3).select(i.alias("row_id"), F.when(i % 50 != 7, F.col("text")).alias("texto"), F.when(i % 100 == 9, "c0").otherwise(F.concat(F.lit("c"), i.cast("string"))).alias("chunk_id"), i.alias("doc_id"))
    return validation.metadata_violations(m, d.where(i % 60 != 11).select(i.alias("row_id")))


@query("SELECT count(*) AS n, round(avg(CASE WHEN regexp_matches(trim(text), '[.!?…»\"'')\\]][\\d\\s]*$') THEN 1.0 ELSE 0.0 END), 6) AS complete FROM documents".replace("\\\\", "\\"))
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return validation.completeness(d).select("n", F.round("complete", 6).alias("complete"))


@query(f"WITH {graph_queries._EDGES} SELECT count(*) AS n, 1.0::DOUBLE AS with_evidence FROM edges")
def evidence_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.evidence_ratio(graph_queries._graph(spark, sf_dir)[2])


_NORM = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"


@query(f"""
    WITH s AS (SELECT vec_id, {_NORM} AS v FROM embeddings) SELECT count(*) AS n, count(*) FILTER (vec_id % 25 = 3) AS missing, round(max(CASE WHEN vec_id % 25 <> 3 AND vec_id % 10 = 1 THEN abs(0.5 * v[1]) ELSE 0 END), 5) AS max_diff, false AS ok FROM s""")
def vec_verify_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that lacks every 25th vector and has a wrong first element in every tenth."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v"))
    i = vectors.build_index(e).where("row_id % 25 <> 3")
    wrong = F.transform("v", lambda x, k: F.when((k == 0) & (F.col("row_id") % 10 == 1), x * 0.5).otherwise(x))
    got = vectors.verify(i.select("row_id", wrong.alias("v")), e)
    return got.select("n", "missing", F.round("max_diff", 5).cast("double").alias("max_diff"), "ok")


@query("""
    WITH l AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), x AS (SELECT doc_id, trim(line, ' ' || chr(9) || chr(13)) AS b FROM l),
    y AS (SELECT doc_id, b, len(list_filter(regexp_split_to_array(b, '\\s+'), lambda w: w <> '')) AS n FROM x WHERE b <> '')
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (length(b) <= 90 AND n <= 14 AND NOT regexp_matches(b, '(?i)^(fuente|source|fonte|figura|figure|tabla|table|gr[áa]fico|chart|nota|note|cuadro|mapa|map|foto|imagen|anexo|elaboraci[óo]n)\\b[\\s:.\\d]')
      AND regexp_matches(b, '^(?:\\d+(?:\\.\\d+)*\\.?\\s+)?[A-ZÁÉÍÓÚÑÜ0-9][^.!?]{3,90}$') AND (regexp_matches(b, '^\\d+(?:\\.\\d+)*\\.?\\s+\\S') OR (n >= 3 AND (upper(b) = b AND lower(b) <> b OR (upper(b[1]) = b[1] AND lower(b[1]) <> b[1]))))) AS n_headings
    FROM y GROUP BY doc_id""".replace("\\\\", "\\"))
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading predicate of the chunker on every distinct line of every document."""

    @F.pandas_udf("boolean")
    def heading(lines):
        return lines.map(chunking.is_heading)

    x = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("b")).select("doc_id", F.trim(F.col("b"), F.lit(" \t\r")).alias("b")).where("b <> ''")
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(heading("b")).alias("n_headings"))


_FACTS = "typed AS (SELECT DISTINCT l_orderkey AS row_id, p_brand AS s, 'made_as' AS r, p_type AS o FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size % 3 = 0)"


@query(f"""
    WITH {graph_queries._EDGES}, {_FACTS}, own AS (SELECT t.* FROM typed t JOIN ents a ON a.row_id = t.row_id AND a.canonical = t.s JOIN ents b ON b.row_id = t.row_id AND b.canonical = t.o),
    facts AS (SELECT row_id, s, r, o FROM own UNION ALL SELECT co.row_id, co.s, '{graph.CO_OCCURS}', co.o FROM co LEFT JOIN own ON own.row_id = co.row_id AND least(own.s, own.o) = co.s AND greatest(own.s, own.o) = co.o WHERE own.row_id IS NULL)
    SELECT s, r, o, count(*) AS weight, count(DISTINCT row_id % 97) AS n_docs FROM facts GROUP BY s, r, o""")
def typed_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a relation finder join the graph; their pairs don't co-occur in the same row."""
    e = graph_queries._with_docs(written(graph_queries._entities(spark, sf_dir), "entities"))
    p = read(spark, sf_dir, "part").where("p_size % 3 = 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("s"), F.lit("made_as").alias("r"), F.col("p_type").alias("o"))
    facts = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), "l_partkey").join(p.hint("merge"), "l_partkey").select("row_id", "s", "r", "o").distinct()
    return graph.triples(graph.facts_of(e, facts), keep=written).select("s", "r", "o", "weight", "n_docs")


@query(f"WITH {graph_queries._EDGES}, x AS (SELECT unnest(evidence) AS row_id, s, o FROM edges) SELECT DISTINCT unnest([s, o]) AS canonical, row_id FROM x")
def index_of_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.index_from_edges(graph_queries._graph(spark, sf_dir)[2]).select("canonical", "row_id")


@query(f"WITH {graph_queries._EDGES}, top AS (SELECT min(s) AS n FROM edges) SELECT other, direction, '{graph.CO_OCCURS}' AS r, weight, n_docs FROM (SELECT o AS other, 'out' AS direction, weight, n_docs FROM edges, top WHERE s = n UNION ALL SELECT s, 'in', weight, n_docs FROM edges, top WHERE o = n)")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an exploration lists of the first node."""
    edge = graph_queries._graph(spark, sf_dir)[2]
    return graph.neighbours_of(edge, edge.agg(F.min("s")).first()[0])


@query(f"WITH {graph_queries._EDGES}, q AS (SELECT canonical AS qid, CASE WHEN length(canonical) % 2 = 0 THEN upper(canonical) ELSE canonical END AS said FROM ents GROUP BY canonical) SELECT qid, a.canonical FROM q JOIN alive a ON lower(a.canonical) = lower(said)")
def query_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities named exactly or in other letters; those that aren't nodes have no seed."""
    e = graph_queries._entities(spark, sf_dir)
    said = F.when(F.length("canonical") % 2 == 0, F.upper("canonical")).otherwise(F.col("canonical"))
    return graph.seeds(e.select(F.col("canonical").alias("qid"), said.alias("canonical")).distinct(), graph.nodes(e))


@query(f"""
    WITH {retrieval_queries._BM25}, t AS (SELECT qid, row_id, rnk, row_id % 3 + 1 AS class, qid % 3 + 1 AS want FROM ranked WHERE rnk <= 3)
    SELECT round(avg(CASE WHEN class = want THEN 1.0 ELSE 0.0 END) FILTER (rnk = 1), 6) AS first, round(avg(CASE WHEN class = want THEN 1.0 ELSE 0.0 END), 6) AS "all" FROM t""")
def coherence_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval_queries.lexical(spark, sf_dir, 3).select("qid", F.col("row_id").alias("doc"), "rnk")
    want = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), (F.col("item_id") % 3 + 1).alias("class"))
    kinds = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 3 + 1).alias("class"))
    return evaluation.coherence(hits, want, kinds).select(F.round("first", 6).alias("first"), F.round("all", 6).alias("all"))


_SYSTEMS = f"""{retrieval_queries._HYBRID}, {retrieval_queries._GOLD}, k AS (SELECT qid, min(row_id) AS row_id FROM gold GROUP BY qid), hr AS (SELECT qid, row_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, row_id) AS rnk FROM h),
    s AS (SELECT 'bm25' AS system, qid, row_id, rnk FROM ranked WHERE rnk <= 60 UNION ALL SELECT 'hybrid', qid, row_id, rnk FROM hr UNION ALL SELECT 'shared', qid, row_id, rnk FROM sr WHERE rnk <= 60)"""


@query(f"""
    WITH {_SYSTEMS}, a AS (SELECT system, k.qid, s.rnk FROM (SELECT unnest(['bm25', 'hybrid', 'shared']) AS system) JOIN k ON true LEFT JOIN s USING (system, qid, row_id))
    SELECT system, round(avg(CASE WHEN rnk <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(CASE WHEN rnk <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10, round(avg(coalesce(1.0 / rnk, 0)), 6) AS mrr, round(avg(CASE WHEN rnk <= 10 THEN 1 / log2(rnk + 1) ELSE 0 END), 6) AS ndcg_10, count(*) AS n FROM a GROUP BY system""")
def diagnose_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three systems on the same known items, in one table."""
    own, lex = retrieval_queries.both_lists(spark, sf_dir, 60)
    hybrid = vectors.ranked(bm25.hybrid(own, lex, 0.5).withColumn("score", F.round("score", 9)), "qid", "row_id")
    known = retrieval_queries._gold(spark, sf_dir).groupBy("qid").agg(F.min("row_id").alias("doc"))
    found = {"bm25": lex, "hybrid": hybrid, "shared": own}
    got = evaluation.diagnose({k: x.withColumnRenamed("row_id", "doc") for k, x in found.items()}, known)
    return got.select("system", *(F.round(c, 6).alias(c) for c in ("recall_3", "recall_10", "mrr", "ndcg_10")), "n")


_WORDS = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> '')"


@query(f"""
    WITH {retrieval_queries._BM25}, {retrieval_queries._GOLD}, i AS (SELECT qid, least(count(*), 10) AS n, count(*) AS rel FROM gold GROUP BY qid), best AS (SELECT qid, list_sum(list_transform(range(1, n + 1), lambda k: 1 / log2(k + 1))) AS b FROM i),
    r10 AS (SELECT * FROM ranked WHERE rnk <= 10), own AS (SELECT r.qid, sum(1 / log2(rnk + 1)) AS o FROM r10 r JOIN gold g ON g.qid = r.qid AND g.row_id = r.row_id GROUP BY r.qid),
    got AS (SELECT qid, count(*) AS got FROM ranked WHERE rnk <= 3 GROUP BY qid), hit AS (SELECT r.qid, count(*) AS hit FROM ranked r JOIN gold g ON g.qid = r.qid AND g.row_id = r.row_id WHERE rnk <= 3 GROUP BY r.qid),
    ft AS (SELECT r.qid, string_agg(d.text, ' ' ORDER BY rnk) AS t FROM r10 r JOIN documents d ON d.doc_id = r.row_id GROUP BY r.qid), b AS (SELECT item_id AS qid, text AS q FROM benchmark),
    gw AS (SELECT qid, w, count(*) AS n FROM (SELECT qid, unnest({_WORDS("q")}) AS w FROM b) GROUP BY ALL), fw AS (SELECT qid, w, count(*) AS m FROM (SELECT qid, unnest({_WORDS("t")}) AS w FROM ft) GROUP BY ALL),
    cov AS (SELECT gw.qid, sum(least(n, coalesce(m, 0))) / sum(n)::DOUBLE AS c FROM gw LEFT JOIN fw ON fw.qid = gw.qid AND fw.w = gw.w GROUP BY gw.qid),
    x AS (SELECT i.qid, coalesce(o, 0) / b AS ndcg, coalesce(hit, 0) / greatest(coalesce(got, 0), 1)::DOUBLE AS p, coalesce(hit, 0) / least(rel, 3)::DOUBLE AS r, coalesce(c, 0) AS c FROM i JOIN best ON best.qid = i.qid LEFT JOIN own ON own.qid = i.qid LEFT JOIN got ON got.qid = i.qid LEFT JOIN hit ON hit.qid = i.qid LEFT JOIN cov ON cov.qid = i.qid)
    SELECT count(*) AS n, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1_3, round(avg(ndcg), 6) AS ndcg_10, round(avg(c), 6) AS coverage FROM x""".replace("\\\\", "\\"))
def gold_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, ranking and fragment coverage of the lexical system against the gold questions, in one row."""
    hits, gold = retrieval_queries._judged(spark, sf_dir)
    texts = hits.join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text"), "row_id")
    wanted = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("fragment"))
    got = evaluation.against_gold(hits.withColumnRenamed("row_id", "doc"), texts, gold.withColumnRenamed("row_id", "doc"), wanted)
    return got.select("n", *(F.round(c, 6).alias(c) for c in ("f1_3", "ndcg_10", "coverage")))


@query(f"""
    WITH RECURSIVE {retrieval_queries._BM25}, cw AS (SELECT r.qid, r.row_id, r.rnk, r.doc, r.score, {_WORDS("d.text")} AS w FROM ranked r JOIN documents d ON d.doc_id = r.row_id WHERE rnk <= 60),
    c AS (SELECT *, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(list_zip(w[:len(w) - 2], w[2:len(w) - 1], w[3:]), lambda x: x[1] || ' ' || x[2] || ' ' || x[3]) ELSE [array_to_string(w, ' ')] END) AS g FROM cw),
    gu AS (SELECT qid, rnk, len(g) AS n, unnest(g) AS gram FROM c), both_have AS (SELECT a.qid, a.rnk AS first, b.rnk, min(a.n) AS n, min(b.n) AS m, count(*) AS c FROM gu a JOIN gu b ON a.qid = b.qid AND a.gram = b.gram AND a.rnk < b.rnk GROUP BY a.qid, a.rnk, b.rnk),
    near AS (SELECT qid, rnk, list(first) AS bad FROM both_have WHERE c / least(n, m)::DOUBLE > {ranking.MAX_OVERLAP} GROUP BY qid, rnk),
    k AS (SELECT c.qid, c.rnk, c.doc, coalesce(bad, []) AS bad FROM c LEFT JOIN near ON near.qid = c.qid AND near.rnk = c.rnk),
    step AS (SELECT DISTINCT qid, 0::BIGINT AS n, []::VARCHAR[] AS docs, []::BIGINT[] AS kept FROM k UNION ALL
      SELECT qid, n + 1, CASE WHEN ok THEN list_append(docs, doc) ELSE docs END, CASE WHEN ok THEN list_append(kept, rnk) ELSE kept END
      FROM (SELECT s.*, k.doc, k.rnk, len(kept) < {ranking.N_FRAGMENTS} AND len(list_filter(docs, lambda d: d = k.doc)) < {ranking.MAX_PER_DOC} AND NOT list_has_any(kept, bad) AS ok FROM step s JOIN k ON k.qid = s.qid AND k.rnk = s.n + 1)),
    last AS (SELECT qid, kept FROM step QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n DESC) = 1),
    o AS (SELECT c.qid, c.row_id, c.doc, c.score, row_number() OVER (PARTITION BY c.qid ORDER BY NOT list_contains(kept, c.rnk), c.rnk) AS rnk FROM c JOIN last ON last.qid = c.qid)
    SELECT qid, row_id, doc, round(score, 6) AS score, rnk::INTEGER AS rnk FROM o WHERE rnk <= {ranking.N_FRAGMENTS}""".replace("\\\\", "\\"))
def diverse_topn_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fragment goes if it shares too many trigrams with one that is kept, or its document has enough."""
    return ranking.diverse(retrieval_queries.lexical(spark, sf_dir, 60), retrieval_queries._rows(spark, sf_dir)).withColumn("score", F.round("score", 6))


_TAG = r"regexp_replace(regexp_replace(lower(trim(name)), '\.(pdf|json|csv|xlsx|txt|png|jpe?g|pbf)$', ''), '[^a-z0-9]', '', 'g')"


@query(rf"""
    WITH n AS (SELECT DISTINCT 'Report_' || (page_id % 40) || '.PDF' AS name FROM pages UNION SELECT 'nothing like it.csv'), d AS (SELECT page_id AS doc, 'the report ' || (page_id % 60) || ' v' || (page_id % 7) || '.pdf' AS name FROM pages),
    a AS (SELECT name, {_TAG} AS k FROM n), b AS (SELECT doc, {_TAG} AS k FROM d) SELECT a.name, min(doc) AS doc FROM a JOIN b ON contains(b.k, a.k) OR contains(a.k, b.k) GROUP BY a.name""")
def fuzzy_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that stand inside longer file names."""
    i = F.col("page_id")
    p = read(spark, sf_dir, "pages")
    names = p.select(F.concat(F.lit("Report_"), (i % 40).cast("string"), F.lit(".PDF")).alias("name")).distinct().union(spark.createDataFrame([("nothing like it.csv",)], "name string"))
    docs = p.select(i.alias("doc"), F.concat(F.lit("the report "), (i % 60).cast("string"), F.lit(" v"), (i % 7).cast("string"), F.lit(".pdf")).alias("file"))
    return evaluation.match_files(names, docs)


@query(f"""
    WITH {retrieval_queries._HYBRID}, {retrieval_queries._GOLD}, k AS (SELECT qid, min(row_id) AS row_id FROM gold GROUP BY qid), w(w) AS (VALUES (0.0::DOUBLE), (0.5), (1.0), (1.5)), depth(k0) AS (VALUES (10), (60)),
    f AS (SELECT w, k0, qid, row_id, round(sum(g), 9) AS score FROM (SELECT w, k0, qid, row_id, 1.0::DOUBLE / (k0 + rnk) AS g FROM sr, w, depth WHERE rnk <= 60 UNION ALL SELECT w, k0, qid, row_id, w / (k0 + rnk) FROM ranked, w, depth WHERE rnk <= 60) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY w, k0, qid ORDER BY score DESC, row_id) AS rnk FROM f)
    SELECT w AS weight, k0, round(avg(CASE WHEN r.rnk <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(coalesce(1.0 / r.rnk, 0)), 6) AS mrr FROM w JOIN depth ON true JOIN k ON true LEFT JOIN r USING (w, k0, qid, row_id) GROUP BY w, k0""")
def ablation_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the lexical list and depths of reciprocal ranks, all combinations on the same lists."""
    lists = [x.select("qid", "row_id", "rnk") for x in retrieval_queries.both_lists(spark, sf_dir, 60)]
    known = retrieval_queries._gold(spark, sf_dir).groupBy("qid").agg(F.min("row_id").alias("doc"))
    grid = spark.createDataFrame([(w, k) for w in (0.0, 0.5, 1.0, 1.5) for k in (10, 60)], "weight double, k0 int")
    return evaluation.sweep(lists[0], lists[1], grid, known).select("weight", "k0", F.round("recall_3", 6).alias("recall_3"), F.round("mrr", 6).alias("mrr"))


@query("""
    WITH c AS (SELECT conv_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n, trim(text) AS t, turn % 7 = 0 AS forced FROM conversations WHERE conv_id % 9 <> 4)
    SELECT count(*) AS n_chunks, round(avg(n), 6) AS mean_words, median(n)::DOUBLE AS median_words, min(n)::INTEGER AS min_words, max(n)::INTEGER AS max_words, count(*) FILTER (n > 240) AS over_240, count(*) FILTER (n > 250) AS over_250, count(*) FILTER (forced) AS forced,
      round(avg(CASE WHEN regexp_matches(t, '[.!?…»"\\'')\\]][\\d\\s]*$') THEN 1.0 ELSE 0.0 END), 6) AS closes_sentence, round(avg(CASE WHEN regexp_matches(t, '^[a-záéíóúüñ]') THEN 0.0 ELSE 1.0 END), 6) AS opens_sentence,
      (SELECT count(DISTINCT conv_id) FROM conversations WHERE conv_id % 9 = 4) AS docs_without FROM c""".replace("\\\\", "\\").replace("\\'')", "'')"))
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns stand for chunks; some conversations have none."""
    c = read(spark, sf_dir, "conversations")
    chunks = chunking.with_words(c.where("conv_id % 9 <> 4").select(F.col("conv_id").cast("string").alias("doc_id"), "text", (F.col("turn") % 7 == 0).alias("forced")))
    return chunking.statistics(chunks, c.select(F.col("conv_id").alias("doc_id")).distinct())
