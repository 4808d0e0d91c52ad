"""Entity graph: dictionary and rule recognition, co-occurrence edges, pruning, retrieval and exploration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions.text import comparison_key
from quillmesh.operators.names import TABLE_NOISE

# Sizes and weights.
MAX_NGRAM, MAX_ENTITIES, MAX_EVIDENCE, MAX_ROWS = 6, 12, 8, 400
MIN_FREQUENCY, MIN_WEIGHT = 3, 2
SEED_WEIGHT, NEIGHBOUR_WEIGHT, MAX_NEIGHBOURS, TOP_ROWS = 1.0, 0.35, 12, 200
CO_OCCURS = "co_ocurre_con"
def is_table_noise(name: Column) -> Column:
    return name.rlike(TABLE_NOISE)


def gazetteer(curated: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(canonical, type, alias, prio) rows -> key, canonical, type. Curated entries come first by prio; places (name, type, prio) never overwrite."""
    own = curated.select(comparison_key("alias").alias("key"), "canonical", "type", F.struct(F.lit(0), F.col("prio").cast("long")).alias("_p")).where(F.length("key") >= 3)
    if places is not None:
        more = places.select(comparison_key("name").alias("key"), F.col("name").alias("canonical"), "type", F.struct(F.lit(1), F.col("prio").cast("long")).alias("_p")).where(F.length("key") >= 4)
        own = own.union(more)
    return own.groupBy("key").agg(F.min_by(F.struct("canonical", "type"), "_p").alias("_e")).select("key", "_e.canonical", "_e.type")


def places_of_alerts(alerts: DataFrame, field: str = "municipios") -> DataFrame:
    """'A, B (Dept); C (Dept)' -> name, type, prio; departments win over municipalities of one name."""
    block = F.explode(F.split(F.col(field), ";"))
    x = alerts.select(block.alias("_b")).select(F.trim("_b").alias("_b")).where("_b <> ''")
    dept = F.trim(F.regexp_extract("_b", r"\(([^)]+)\)\s*$", 1))
    town = F.explode(F.split(F.regexp_replace("_b", r"\s*\([^)]+\)\s*$", ""), ","))
    towns = x.select(town.alias("name")).select(F.trim("name").alias("name")).where(F.length("name") >= 4).select("name", F.lit("MUNICIPIO").alias("type"), F.lit(1).alias("prio"))
    depts = x.select(dept.alias("name")).where("name <> ''").select("name", F.lit("DEPARTAMENTO").alias("type"), F.lit(0).alias("prio"))
    return depts.union(towns).groupBy("name").agg(F.min_by("type", "prio").alias("type")).withColumn("prio", F.lit(0))


def places_of_columns(table: DataFrame, columns: dict[str, str], country: str | None = None) -> DataFrame:
    """Names in the given columns (column -> type, first type wins); the country column overwrites."""
    spec = [(c, t, i + 1) for i, (c, t) in enumerate(columns.items())] + ([(country, "PAIS", 0)] if country else [])
    parts = F.explode(F.array(*(F.struct(F.trim(F.col(c)).alias("name"), F.lit(t).alias("type"), F.lit(i).alias("prio")) for c, t, i in spec)))
    x = table.select(parts.alias("_x")).select("_x.*").where((F.length("name") >= 4) | ((F.col("prio") == 0) & (F.length("name") > 0)))
    return x.groupBy("name").agg(F.min_by("type", "prio").alias("type")).withColumn("prio", F.lit(1))


def gazetteer_hits(rows: DataFrame, gaz: DataFrame, text: str = "text", max_ngram: int = MAX_NGRAM, most_starts: int = 20_000) -> DataFrame:
    """rows (row_id, text) -> row_id, canonical, type: aliases in the text, the longest at each start, inner starts too.

    A place of a text takes along the words that an alias can have, not the text. While the first words of aliases are few
    (their number is counted), other places never leave the scan; more of them are told apart by the join.
    """
    g = gaz.withColumn("_gw", F.split("key", " ")).where(F.size("_gw") <= max_ngram).select("key", "canonical", "type", F.get("_gw", F.lit(0)).alias("_first"), F.size("_gw").alias("_n"))
    starts = [r["_first"] for r in g.select("_first").distinct().limit(most_starts + 1).collect()]
    x = rows.select("row_id", F.split(comparison_key(text), " ").alias("_w"))
    # keys are made of a-z, 0-9 and blanks, so nothing needs to be escaped
    test = f"_w[i] IN ({', '.join(repr(w) for w in sorted(starts))})" if starts else "false"
    at = F.expr(f"filter(sequence(0, size(_w) - 1), i -> {test})") if len(starts) <= most_starts else F.expr("sequence(0, size(_w) - 1)")
    x = x.withColumn("_at", at).select("row_id", F.explode(F.transform("_at", lambda i: F.struct(i.alias("p"), F.slice("_w", i + 1, max_ngram).alias("w")))).alias("_s"))
    x = x.select("row_id", F.col("_s.p").alias("_p"), F.col("_s.w").alias("_w"), F.get("_s.w", F.lit(0)).alias("_first"))
    found = x.join(g, "_first").where(F.array_join(F.expr("slice(_w, 1, _n)"), " ") == F.col("key"))
    longest = found.groupBy("row_id", "_p").agg(F.max_by(F.struct("canonical", "type"), "_n").alias("_e"))
    return longest.select("row_id", "_e.canonical", "_e.type").groupBy("row_id", "canonical").agg(F.max("type").alias("type"))


def entities(gaz_hits: DataFrame, others: DataFrame | None = None, most: int = MAX_ENTITIES) -> DataFrame:
    """row_id, canonical, type: at most `most` of a row, dictionary entities first, then by name."""
    x = gaz_hits.select("row_id", "canonical", "type", F.lit(0).alias("_o"))
    if others is not None:
        x = x.union(others.select("row_id", "canonical", "type", F.lit(1).alias("_o")))
    x = x.groupBy("row_id", "canonical").agg(F.min_by("type", "_o").alias("type"), F.min("_o").alias("_o"))
    w = W.partitionBy("row_id").orderBy("_o", "canonical")
    return x.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select("row_id", "canonical", "type")


def nodes(ents: DataFrame, min_frequency: int = MIN_FREQUENCY) -> DataFrame:
    """canonical, type (of the first row that has it), frequency."""
    n = ents.groupBy("canonical").agg(F.min_by("type", F.struct("row_id", "type")).alias("type"), F.count(F.lit(1)).alias("frequency"))
    return n.where(F.col("frequency") >= min_frequency)


#: Entities, with their rows' pairs, that one task gets.
ENTITIES_IN_A_TASK = 200_000
#: The most triples that are broadcast with what is known of them.
BROADCAST_TRIPLES = 100_000


def co_occurrences(ents: DataFrame, typed: DataFrame | None = None) -> DataFrame:
    """row_id, s, r, o for every two entities of a row, s before o. A row has few entities, so pairs are made within it.

    typed (row_id, s, r, o): facts of a relation finder; a pair that has one in its row, in either direction, doesn't
    co-occur there as well. ents with a doc, which depends on row_id, give facts with a doc. Rows are then dealt out by doc,
    to as many tasks as their counted entities need, so that a task meets the pairs of few docs again and again.
    """
    own = ["row_id", *(c for c in ("doc",) if c in ents.columns)]
    names = ents.groupBy(*own).agg(F.sort_array(F.collect_set("canonical")).alias("_n"))
    if own[1:]:
        names = names.repartitionByRange(max(1, -(-ents.count() // ENTITIES_IN_A_TASK)), "doc", "row_id")
    pairs = F.flatten(F.transform("_n", lambda a, i: F.transform(F.filter("_n", lambda b, j: j > i), lambda b: F.struct(a.alias("s"), b.alias("o")))))
    out = names.select(*own, F.explode(pairs).alias("_p")).select("row_id", "_p.s", F.lit(CO_OCCURS).alias("r"), "_p.o", *own[1:])
    if typed is None:
        return out
    said = typed.select("row_id", F.least("s", "o").alias("s"), F.greatest("s", "o").alias("o")).distinct()
    return out.join(said, ["row_id", "s", "o"], "left_anti").select("row_id", "s", "r", "o", *own[1:])


def facts_of(ents: DataFrame, typed: DataFrame | None = None) -> DataFrame:
    """All facts of the rows: typed ones whose ends are both entities of the row, and co-occurrences of the other pairs.

    ents with a doc give facts with a doc.
    """
    if typed is None:
        return co_occurrences(ents)
    e = ents.select("row_id", "canonical").distinct()
    own = typed.select("row_id", "s", "r", "o").join(e.withColumnRenamed("canonical", "s"), ["row_id", "s"], "left_semi").join(e.withColumnRenamed("canonical", "o"), ["row_id", "o"], "left_semi")
    own = own.select("row_id", "s", "r", "o").distinct()
    other = co_occurrences(ents, own)
    return (own.join(ents.select("row_id", "doc").distinct(), "row_id") if "doc" in ents.columns else own).unionByName(other)


def triples(facts: DataFrame, rows: DataFrame | None = None, most: int = MAX_EVIDENCE, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """facts (row_id, s, r, o) with rows (row_id, doc) -> s, r, o, weight, n_docs, evidence (first rows). Facts that have a doc need no rows.

    Facts are counted and compared, not sorted: the first row of each of a triple's docs is found on the way, and facts
    after the `most`-th of those can't be evidence. What is left is ranked; only a triple of fewer docs is ranked whole.
    keep writes a table and reads it again, so that the counts are made once.
    """
    x = facts if rows is None else facts.join(rows.select("row_id", "doc"), "row_id")
    key = ["s", "r", "o"]
    in_doc = keep(x.groupBy(*key, "doc").agg(F.count(F.lit(1)).alias("_n"), F.min("row_id").alias("_first")), "triples")
    n = in_doc.groupBy(*key).agg(F.sum("_n").alias("weight"), F.count("doc").alias("n_docs"))
    w = W.partitionBy(*key)
    reach = in_doc.withColumn("_k", F.row_number().over(w.orderBy("_first"))).where(F.col("_k") == most).select(*key, F.col("_first").alias("_last"))
    few = reach.limit(BROADCAST_TRIPLES + 1).count() <= BROADCAST_TRIPLES
    near = x.select(*key, "row_id").join(F.broadcast(reach) if few else reach, key, "left").where(F.col("_last").isNull() | (F.col("row_id") <= F.col("_last")))
    first = near.select(*key, "row_id", F.row_number().over(w.orderBy("row_id")).alias("_k")).where(F.col("_k") <= most).groupBy(*key).agg(F.sort_array(F.collect_list("row_id")).alias("evidence"))
    return n.join(first, key)


def edges(trips: DataFrame, alive: DataFrame, min_weight: int = MIN_WEIGHT) -> DataFrame:
    """One edge for each ordered pair of living nodes: the heaviest relation, ties by name; the others are listed."""
    a = alive.select("canonical")
    x = trips.join(a.withColumnRenamed("canonical", "s"), "s", "left_semi").join(a.withColumnRenamed("canonical", "o"), "o", "left_semi")
    x = x.where((F.col("r") != CO_OCCURS) | (F.col("weight") >= min_weight))
    w = W.partitionBy("s", "o").orderBy(F.col("weight").desc(), F.col("r"))
    x = x.withColumn("_k", F.row_number().over(w)).withColumn("_all", F.collect_list("r").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return x.where("_k = 1").select("s", "o", "r", "weight", "n_docs", "evidence", F.array_join(F.slice("_all", 2, 1000), ";").alias("other_relations"))


def entity_index(ents: DataFrame, alive: DataFrame, most: int = MAX_ROWS) -> DataFrame:
    """canonical, row_id: the first rows of each living entity."""
    x = ents.select("canonical", "row_id").distinct().join(alive.select("canonical"), "canonical", "left_semi")
    return x.withColumn("_k", F.row_number().over(W.partitionBy("canonical").orderBy("row_id"))).where(F.col("_k") <= most).select("canonical", "row_id")


def index_from_edges(edge: DataFrame) -> DataFrame:
    """canonical, row_id from the evidence of edges, where no index was kept."""
    x = edge.select("s", "o", F.explode("evidence").alias("row_id"))
    return x.select(F.explode(F.array("s", "o")).alias("canonical"), "row_id").distinct()


def seeds(query_hits: DataFrame, node: DataFrame) -> DataFrame:
    """query_hits (qid, canonical) -> qid, canonical of nodes: the exact name, else one equal without case."""
    exact = query_hits.select("qid", "canonical").join(node.select("canonical"), "canonical", "left_semi").select("qid", "canonical")
    rest = query_hits.select("qid", "canonical").join(node.select("canonical"), "canonical", "left_anti").select("qid", F.lower("canonical").alias("_l"))
    loose = node.select(F.lower("canonical").alias("_l"), "canonical").groupBy("_l").agg(F.max("canonical").alias("canonical"))
    return exact.union(rest.join(loose, "_l").select("qid", "canonical")).distinct()


def both_ways(edge: DataFrame) -> DataFrame:
    return edge.select(F.col("s").alias("node"), F.col("o").alias("other"), "weight").unionAll(edge.select(F.col("o").alias("node"), F.col("s").alias("other"), "weight"))


def search(seed: DataFrame, edge: DataFrame, index: DataFrame, k: int = TOP_ROWS, neighbours: int = MAX_NEIGHBOURS) -> DataFrame:
    """seeds (qid, canonical) -> qid, row_id, score, rnk: rows of the seeds and of their heaviest neighbours.

    A neighbour on both an in- and an out-edge takes two of the places.
    """
    near = both_ways(edge).join(seed.select("canonical").distinct().withColumnRenamed("canonical", "node"), "node", "left_semi")
    near = near.withColumn("_k", F.row_number().over(W.partitionBy("node").orderBy(F.col("weight").desc(), F.col("other")))).where(F.col("_k") <= neighbours)
    far = seed.join(near, seed["canonical"] == near["node"]).select("qid", F.col("other").alias("canonical"), F.lit(NEIGHBOUR_WEIGHT).alias("w"))
    weight = seed.select("qid", "canonical", F.lit(SEED_WEIGHT).alias("w")).union(far).groupBy("qid", "canonical").agg(F.max("w").alias("w"))
    score = weight.join(index, "canonical").groupBy("qid", "row_id").agg(F.sum("w").alias("score"))
    order = W.partitionBy("qid").orderBy(F.col("score").desc(), F.col("row_id"))
    return score.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)


def neighbours_of(edge: DataFrame, node: str) -> DataFrame:
    """other, direction, r, weight, n_docs of a node's edges, heaviest first: what an exploration lists."""
    out = edge.where(F.col("s") == node).select(F.col("o").alias("other"), F.lit("out").alias("direction"), "r", "weight", "n_docs")
    both = out.unionAll(edge.where(F.col("o") == node).select(F.col("s").alias("other"), F.lit("in").alias("direction"), "r", "weight", "n_docs"))
    return both.orderBy(F.col("weight").desc(), "other", "direction")


def degrees(edge: DataFrame) -> DataFrame:
    return both_ways(edge).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def neighbourhood(edge: DataFrame, start: str, hops: int, most: int | None = None) -> DataFrame:
    """node, hop: nodes within so many undirected steps; of more than `most`, those best tied to the start, then by degree."""
    both = both_ways(edge)
    seen = both.sparkSession.createDataFrame([(start, 0)], "node string, hop int")
    for hop in range(1, hops + 1):
        step = both.join(seen.where(F.col("hop") == hop - 1).select("node"), "node", "left_semi").select(F.col("other").alias("node"), F.lit(hop).alias("hop"))
        seen = seen.unionAll(step).groupBy("node").agg(F.min("hop").alias("hop"))
    if most is None:
        return seen
    tie = both.where(F.col("node") == start).groupBy(F.col("other").alias("node")).agg(F.max("weight").alias("_w"))
    x = seen.join(tie, "node", "left").join(degrees(edge), "node", "left")
    return x.orderBy((F.col("node") == start).desc(), F.coalesce("_w", F.lit(0)).desc(), F.coalesce("degree", F.lit(0)).desc(), "node").limit(most).select("node", "hop")


def heaviest_edges(edge: DataFrame, k: int) -> DataFrame:
    """Edges that are among the k heaviest of at least one end."""
    ends = edge.select("s", "o", "weight", F.explode(F.array("s", "o")).alias("node"))
    w = W.partitionBy("node").orderBy(F.col("weight").desc(), "s", "o")
    return ends.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).select("s", "o", "weight").distinct()


def relation_counts(edge: DataFrame, most: int = 15) -> DataFrame:
    return edge.groupBy("r").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "r").limit(most)
