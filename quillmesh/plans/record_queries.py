"""Row texts, packing, JSON, tile joins and inventories over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.plans.registry import query, read
from quillmesh.sources import files, records

_PART = "'name: ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' | brand: ' || p_brand ELSE '' END || ' | size: ' || p_size"


def _part_text() -> F.Column:
    brand = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("")
    return T.pairs_text(["name", "brand", "", "size"], [F.col("p_name"), brand, F.col("p_type"), F.col("p_size")])


@query(f"SELECT p_partkey, {_PART} AS text FROM part")
def row_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells without a value and columns without a name are left out."""
    return read(spark, sf_dir, "part").select("p_partkey", _part_text().alias("text"))


@query(f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) SELECT p_brand, (r - 1) // 8 AS block, string_agg({_PART}, chr(10) ORDER BY r) AS text FROM n WHERE r <= 2400 GROUP BY p_brand, (r - 1) // 8")
def pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = read(spark, sf_dir, "part").withColumn("r", F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey"))).where(F.col("r") <= files.ROWS_PER_BLOCK * files.MAX_BLOCKS)
    block = F.floor((F.col("r") - 1) / files.ROWS_PER_BLOCK).alias("block")
    return n.groupBy("p_brand", block).agg(F.sort_array(F.collect_list(F.struct("r", _part_text().alias("t")))).alias("b")).select("p_brand", "block", F.array_join(F.transform("b", lambda x: x["t"]), "\n").alias("text"))


@query("""
    WITH k AS (SELECT event_id, props, unnest(json_keys(props::JSON)) AS k FROM events)
    SELECT event_id, string_agg(k || ': ' || json_extract_string(props::JSON, '$.' || k), chr(10) ORDER BY k) AS text FROM k WHERE json_extract_string(props::JSON, '$.' || k) IS NOT NULL GROUP BY event_id""")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat objects: keys and values as lines; nested ones are for sources.files.flatten."""
    m = F.array_sort(F.map_entries(F.from_json("props", "map<string,string>")))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(F.filter(m, lambda e: e["value"].isNotNull()), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n").alias("text"))


_TILE = """
    l AS (SELECT l_orderkey * 10 + l_linenumber AS n, l_orderkey % 5 AS z, l_partkey % 7 AS x, l_suppkey % 11 AS y, l_partkey % 50 AS code, l_returnflag AS flag, l_quantity::BIGINT AS q FROM lineitem),
    m AS (SELECT *, 'Territorio: place ' || code || ', CO. población: ' || q || CASE WHEN flag = 'R' THEN '. presencia de grupos armados: Los Lobos' ELSE '' END || '.' AS t FROM l),
    f AS (SELECT *, row_number() OVER (PARTITION BY z, x, y, code ORDER BY n, t) AS k FROM m),
    p AS (SELECT z, x, y FROM range(5) a(z), range(8) b(x), range(11) c(y))"""


@query(f"""
    WITH {_TILE}, t AS (SELECT z, x, y, count(*) AS n, string_agg(t, chr(10) ORDER BY n, t) AS t FROM f WHERE k = 1 GROUP BY z, x, y)
    SELECT 'tiles/' || p.z || '/' || p.x || '/AMAZONUW_' || p.y || '.pbf' AS path, coalesce(n, 0) AS n_places,
      'Mapa de presencia de grupos armados y economías ilícitas en la cuenca amazónica (Amazon Underworld), tile de zoom ' || p.z || ', columna ' || p.x || ', fila ' || p.y || '. ' || coalesce(n, 0) || ' territorios registrados.' || coalesce(chr(10) || chr(10) || t, '') AS text
    FROM p LEFT JOIN t ON p.z = t.z AND p.x = t.x AND p.y = t.y""")
def tile_join_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stand for the tile table: many rows for each tile, one for each place stays."""
    l = read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), (F.col("l_orderkey") % 5).alias("tile_zoom"), (F.col("l_partkey") % 7).alias("tile_x"), (F.col("l_suppkey") % 11).alias("tile_y"),
        (F.col("l_partkey") % 50).alias("b_ADM2_PCODE"), F.concat(F.lit("place "), (F.col("l_partkey") % 50).cast("string")).alias("b_ADM2_ES"), F.lit("CO").alias("au_country"),
        F.col("l_quantity").cast("long").alias("au_population"), F.when(F.col("l_returnflag") == "R", "si").alias("grupo_Los_Lobos"),
    )
    p = spark.range(5 * 8 * 11).select(F.format_string("tiles/%d/%d/AMAZONUW_%d.pbf", F.floor(F.col("id") / 88), F.floor(F.col("id") / 11) % 8, F.col("id") % 11).alias("path"))
    return records.tiles(p, l).select("path", F.col("n_places").cast("long").alias("n_places"), "text")


@query("""
    WITH i AS (SELECT page_id + 1 AS n, CASE WHEN page_id % 10 = 3 THEN '' ELSE 'F' || (page_id % 3 + 1) || '-' || page_id END AS id, CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.csv' WHEN 2 THEN '.JSON' ELSE '.odd' END AS ext, page_id % 3 + 1 AS class FROM pages)
    SELECT id AS doc_id, 'DOC-' || lpad(n::VARCHAR, 4, '0') AS sequential_id, 'file' || n || ext AS source, class::INTEGER AS class, CASE ext WHEN '.pdf' THEN 'pdf' WHEN '.csv' THEN 'csv' WHEN '.JSON' THEN 'json' ELSE 'web' END AS format FROM i WHERE id <> ''""")
def inventory_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inventory(spark, sf_dir).select("doc_id", "sequential_id", "source", "class", "format")


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    ext = F.when(i % 4 == 0, ".pdf").when(i % 4 == 1, ".csv").when(i % 4 == 2, ".JSON").otherwise(".odd")
    rows = read(spark, sf_dir, "pages").select(
        (i + 1).alias("n"), F.when(i % 10 == 3, " ").otherwise(F.concat(F.lit("F"), (i % 3 + 1).cast("string"), F.lit("-"), i.cast("string"))).alias("doc_id"), F.concat(F.lit("file"), (i + 1).cast("string"), ext).alias("name"),
        F.lit("").alias("folder"), F.lit("obs").alias("observatory"), F.concat(F.lit("F"), (i % 3 + 1).cast("string")).alias("phenomenon"), F.lit("WEB").alias("kind"),
    )
    return records.inventory(rows, files.FORMATS)


@query("""
    WITH i AS (SELECT page_id % 3 + 1 AS class, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'csv' WHEN 2 THEN 'json' ELSE 'web' END AS format FROM pages WHERE page_id % 10 <> 3)
    SELECT 'total' AS measure, '' AS key, count(*) AS n FROM i UNION ALL SELECT 'repeated_ids', '', 0 UNION ALL SELECT 'format', format, count(*) FROM i GROUP BY format UNION ALL SELECT 'class', class::VARCHAR, count(*) FROM i GROUP BY class""")
def inventory_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.audit(_inventory(spark, sf_dir))


@query("SELECT 'q' || lpad(item_id::VARCHAR, 3, '0') AS query_id, trim(text) AS text FROM benchmark")
def queries_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as JSON lines under names that vary."""
    b = read(spark, sf_dir, "benchmark")
    qid = F.concat(F.lit("q"), F.lpad(F.col("item_id").cast("string"), 3, "0"))
    line = F.when(F.col("item_id") % 2 == 0, F.to_json(F.struct(qid.alias("Query_ID"), F.col("text").alias("texto")))).otherwise(F.to_json(F.struct(qid.alias("qid"), F.col("text").alias("Question"))))
    return records.queries_from_text(b.select(F.col("item_id").alias("n"), line.alias("value"))).select("query_id", "text")


@query("""
    WITH w AS (SELECT item_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), ' ') AS t FROM benchmark) SELECT 'q' || lpad(item_id::VARCHAR, 3, '0') AS query_id, t AS text FROM w""".replace("\\\\", "\\"))
def query_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions pasted together with marks, then taken apart again.

    A mark has three digits, so each block of 1000 ids is a text of its own.
    """
    b = read(spark, sf_dir, "benchmark").withColumn("block", F.floor(F.col("item_id") / 1000))
    pasted = b.groupBy("block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "text"))), lambda r: F.concat(F.lit(" Q"), F.lpad((r["item_id"] % 1000).cast("string"), 3, "0"), F.lit(" \n"), r["text"])), "").alias("value"))
    item = F.col("block") * 1000 + F.substring("query_id", 2, 3).cast("long")
    return records.queries_from_marks(pasted, "block").select(F.concat(F.lit("q"), F.lpad(item.cast("string"), 3, "0")).alias("query_id"), "text")
