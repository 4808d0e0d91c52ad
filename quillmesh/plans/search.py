"""Search from texts to documents and fragments: one lazy plan over all queries.

build() writes the tables that a search reads (chunks, vectors, centroids, graph); search() reads them. Every table is
Parquet under the root of the settings, so stages can be rerun one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.config import Settings
from quillmesh.functions import languages
from quillmesh.operators import chunking, encoders, fusion, graph, names, ranking, vectors


def rows_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> chunks with row_id (of document and position), doc, pos, text, class, lang.

    row_id is a hash of the chunk's id: it needs no global numbering and stays when other documents come.
    """
    c = chunking.chunk(docs)
    more = docs.select(F.col("doc_id").cast("string").alias("doc_id"), *(x for x in ("class", "lang") if x in docs.columns))
    c = c.join(more, "doc_id")
    lang = F.col("lang") if "lang" in docs.columns else languages.detect(F.col("text"))
    kind = F.col("class") if "class" in docs.columns else F.lit(1)
    return c.select(F.xxhash64("chunk_id").alias("row_id"), F.col("doc_id").alias("doc"), "pos", "chunk_id", "text", "embed_text", kind.alias("class"), lang.alias("lang"))


def build(docs: DataFrame, settings: Settings, gaz: DataFrame | None = None, recogniser: names.Recogniser = names.rule_names, finder: names.RelationFinder | None = None) -> None:
    """The index of docs. recogniser and finder stand for models of entities and of relations between them."""
    spark = docs.sparkSession
    write = lambda df, name: df.write.mode("overwrite").parquet(settings.path(name))
    write(rows_of(docs), "rows")
    rows = spark.read.parquet(settings.path("rows"))
    for slug in settings.encoders:
        write(encoders.encode(rows.select("row_id", "embed_text"), encoders.ENCODERS[slug], "embed_text").select("row_id", "v"), f"vectors/slug={slug}")
    v = spark.read.parquet(settings.path("vectors")).join(rows.select("row_id", "doc", "class"), "row_id")
    for key in ("class", "doc"):
        parts = [vectors.centroids(v.where(F.col("slug") == s), key).withColumn("slug", F.lit(s)) for s in settings.encoders]
        write(reduce(DataFrame.unionByName, parts), f"{key}_centroids")
    if gaz is not None:
        found = graph.entities(graph.gazetteer_hits(rows, gaz), names.recognise(rows, recogniser))
        write(gaz, "gazetteer")
        write(found, "entities")
        found = spark.read.parquet(settings.path("entities"))
        typed = names.relate(rows, found, finder) if finder else None
        alive = graph.nodes(found)
        write(alive, "nodes")
        alive = spark.read.parquet(settings.path("nodes"))
        placed = found.join(rows.select("row_id", "doc"), "row_id")
        keep = lambda df, name: write(df, name) or spark.read.parquet(settings.path(name))
        write(graph.edges(graph.triples(graph.facts_of(placed, typed), keep=keep), alive), "edges")
        write(graph.entity_index(found, alive), "entity_index")


def misaligned(rows: DataFrame, vectors: DataFrame, slugs: tuple[str, ...]) -> DataFrame:
    """slug, n_rows, n_vectors, rowless, bare for encoders whose vectors aren't those of the rows, one for one.

    rowless: vectors without a row; bare: rows without a vector. No encoder is listed if all are whole.
    """
    every = rows.select("row_id", F.explode(F.array(*map(F.lit, slugs))).alias("slug"), F.lit(1).alias("_r"))
    own = vectors.groupBy("slug", "row_id").agg(F.count(F.lit(1)).alias("_v"))
    both = every.join(own, ["slug", "row_id"], "full").groupBy("slug")
    got = both.agg(F.count("_r").alias("n_rows"), F.coalesce(F.sum("_v"), F.lit(0)).alias("n_vectors"), F.count_if(F.col("_r").isNull()).alias("rowless"), F.count_if(F.col("_v").isNull()).alias("bare"))
    return got.where((F.col("n_rows") != F.col("n_vectors")) | (F.col("rowless") > 0) | (F.col("bare") > 0))


class Retriever:
    """Reads what build() has written. check: compare rows and vectors first, and raise if they don't belong together."""

    def __init__(self, spark: SparkSession, settings: Settings, use_graph: bool = True, check: bool = False):
        self.settings = settings
        self.table = lambda name: spark.read.parquet(settings.path(name))
        self.rows, self.vectors = self.table("rows"), self.table("vectors")
        self.use_graph = use_graph
        if check and (wrong := misaligned(self.rows, self.vectors, settings.encoders).collect()):
            raise ValueError(f"rows and vectors don't belong together: {[r.asDict() for r in wrong]}")

    def lists(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Ranked lists of all encoders and the graph; query vectors by encoder."""
        s, parts, own = self.settings, [], []
        for slug in s.encoders:
            q = encoders.encode(queries.select("qid", "text"), encoders.ENCODERS[slug], "text", is_query=True).select("qid", "v")
            own.append(q.withColumn("slug", F.lit(slug)))
            found = vectors.top_k(q, self.vectors.where(F.col("slug") == slug), s.top_k)
            parts.append(found.select("qid", "row_id", "score", "rnk", F.lit(slug).alias("list_id"), F.lit(1.0).alias("weight")))
        if self.use_graph:
            hits = graph.gazetteer_hits(queries.select(F.col("qid").alias("row_id"), "text"), self.table("gazetteer")).select(F.col("row_id").alias("qid"), "canonical")
            got = graph.search(graph.seeds(hits, self.table("nodes")), self.table("edges"), self.table("entity_index"), s.graph_rows)
            parts.append(got.select("qid", "row_id", "score", "rnk", F.lit("graph").alias("list_id"), F.lit(s.graph_weight).alias("weight")))
        return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, own)

    def search(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """queries (qid, text) -> documents (qid, doc, score, rnk), fragments (qid, row_id, chunk_id, doc, text, score, rnk)."""
        s = self.settings
        lists, q = self.lists(queries)
        fused = fusion.fuse(lists, s.fusion, **({"k0": s.rrf_k0} if s.fusion == "rrf" else {}))
        if s.class_boost > 0:
            prior = ranking.class_prior(q, self.table("class_centroids"), s.class_boost)
            fused = ranking.apply_prior(fused, self.rows, prior)
        docs = ranking.roll_up(fused, self.rows, s.tail_weight, s.tail_n)
        docs = ranking.without_copies(docs, self.table("doc_centroids"), ranking.majority_language(self.rows), s.n_documents, s.copy_cosine, s.translation_cosine)
        frags = ranking.diverse(ranking.contents_last(fused, self.rows), self.rows, s.n_fragments, s.per_doc)
        ids = self.rows.select("row_id", "chunk_id")
        if s.expand_words:
            grown = ranking.expand(frags.select("row_id").distinct(), self.rows, s.expand_words)
        else:
            grown = self.rows.select("row_id", "text")
        return docs, frags.join(ids, "row_id").join(grown, "row_id").select("qid", "row_id", "chunk_id", "doc", "text", "score", "rnk")
