"""Files of every format, page layouts, gold sheets and sinks. The files are made from the tables' rows, in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.plans.registry import query, read, scratch
from quillmesh.sources import files, records, sinks

_LINE = "p_partkey || ';' || p_name || ';' || (CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END) || ';' || p_size"
_ROW = "'p_partkey: ' || p_partkey || ' | p_name: ' || p_name || CASE WHEN p_size % 5 = 0 THEN '' ELSE ' | p_type: ' || p_type END || ' | p_size: ' || p_size"


@query(f"""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS c FROM part),
    b AS (SELECT p_brand, c, (r - 1) // 8 AS k, 'Columnas: p_partkey, p_name, p_type, p_size' || chr(10) || string_agg({_ROW}, chr(10) ORDER BY r) AS t FROM n WHERE r <= 2400 GROUP BY p_brand, c, (r - 1) // 8)
    SELECT p_brand AS title, c::VARCHAR AS n_rows, count(*) AS n_blocks, string_agg(t, chr(10) || chr(10) ORDER BY k) AS text FROM b GROUP BY p_brand, c""")
def csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file with semicolons for each brand: sniffed, packed eight rows a block, cleaned."""
    line = F.concat_ws(";", F.col("p_partkey").cast("string"), "p_name", F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_type")), F.col("p_size").cast("string"))
    per = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("rows"))
    own = per.select(F.concat(F.lit("in/"), "p_brand", F.lit(".csv")).alias("path"), F.encode(F.concat(F.lit("p_partkey;p_name;p_type;p_size\n"), "rows"), "utf-8").alias("content"))
    return files.extracted(own).select("title", F.col("extra")["n_filas"].alias("n_rows"), F.size("blocks").cast("long").alias("n_blocks"), "text")


@query("""
    WITH r AS (SELECT r_name, 'Hoja: nations. Columnas: key, name' || chr(10) || string_agg('key: ' || n_nationkey || ' | name: ' || n_name, chr(10) ORDER BY n_nationkey) AS t, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name)
    SELECT r_name AS title, n::BIGINT + 1 AS n_rows, t || chr(10) || chr(10) || 'Hoja: about. Columnas: what' || chr(10) || 'what: ' || r_name AS text FROM r""")
def xlsx_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook of two named sheets for each region, with shared and inline strings."""
    import io
    import zipfile

    space = files.SHEET_NS[1:-1]

    @F.pandas_udf("binary")
    def book(name, keys, names):
        import pandas as pd

        out = []
        for r, ks, ns in zip(name, keys, names, strict=True):
            strings = ["key", "name", *ns]
            cell = lambda i: f'<c t="s"><v>{i}</v></c>'
            first = f"<row>{cell(0)}{cell(1)}</row>" + "".join(f"<row><c><v>{k}</v></c>{cell(i + 2)}</row>" for i, k in enumerate(ks))
            sheet = lambda rows: f'<worksheet xmlns="{space}"><sheetData>{rows}</sheetData></worksheet>'  # noqa: E731, B023
            inline = lambda t: f'<c t="inlineStr"><is><t>{t}</t></is></c>'
            with zipfile.ZipFile(data := io.BytesIO(), "w") as z:
                z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{space}">' + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
                z.writestr("xl/workbook.xml", f'<workbook xmlns="{space}"><sheets><sheet name="nations"/><sheet name="about"/></sheets></workbook>')
                z.writestr("xl/worksheets/sheet1.xml", sheet(first))
                z.writestr("xl/worksheets/sheet2.xml", sheet(f"<row>{inline('what')}</row><row>{inline(r)}</row>"))
            out.append(data.getvalue())
        return pd.Series(out)

    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    own = n.select(F.concat("r_name", F.lit(".xlsx")).alias("path"), book("r_name", F.col("n.n_nationkey"), F.col("n.n_name")).alias("content"))
    return files.extracted(own).select("title", F.col("extra")["n_filas"].cast("long").alias("n_rows"), "text")


@query("""
    SELECT page_id, CASE page_id % 5 WHEN 4 THEN '' ELSE 'Page ' || page_id END AS title, CASE page_id % 3 WHEN 0 THEN url ELSE '' END AS url,
      CASE page_id % 5 WHEN 0 THEN '## Part ' || page_id || chr(10) || chr(10) || 'one ' || page_id || chr(10) || 'two' || chr(10) || chr(10) || 'x' || chr(10) || 'y'
        WHEN 1 THEN 'In short, ' || page_id || chr(10) || chr(10) || 'Palabras clave: k' || page_id || chr(10) || 'debris'
        WHEN 2 THEN 'Before all' || chr(10) || chr(10) || 'A body of well over forty characters for page ' || page_id || '.'
        WHEN 3 THEN 'Alerta Temprana A-' || page_id || chr(10) || 'Municipios y departamentos en riesgo: Calamar (Guaviare)' || chr(10) || 'zone: north' || chr(10) || chr(10) || 'p1' || chr(10) || 'p2'
        ELSE 'a: ' || page_id || chr(10) || 'b: c: 1' || chr(10) || 'd: 2.5' || chr(10) || 'True' END AS text FROM pages""".replace("'Page ' || page_id END AS title", "CASE page_id % 5 WHEN 3 THEN 'Alerta Temprana A-' || page_id || ' - Calamar (Guaviare)' ELSE 'Page ' || page_id END END AS title"))
def json_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects of five shapes: sections, abstract, article, alert, and any nested object. Cleaning makes a dash a hyphen."""
    i = F.col("page_id")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    title = F.concat(F.lit('"title": "Page '), i.cast("string"), F.lit('", '), F.when(i % 3 == 0, F.concat(F.lit('"url": '), q(F.col("url")), F.lit(", "))).otherwise(F.lit("")))
    n = i.cast("string")
    shape = (
        F.when(i % 5 == 0, F.concat(title, F.lit('"sections": [{"heading": "Part '), n, F.lit('", "paragraphs": ["one '), n, F.lit('", "two"]}], "lists": [["x", "y"]]')))
        .when(i % 5 == 1, F.concat(title, F.lit('"abstract": "In short, '), n, F.lit('", "keywords": ["k'), n, F.lit('", "debris"]')))
        .when(i % 5 == 2, F.concat(title, F.lit('"excerpt": "Before all", "body_paragraphs": ["unused"], "body_text": "A body of well over forty characters for page '), n, F.lit('."')))
        .when(i % 5 == 3, F.concat(title, F.lit('"alerta_meta": {"codigo": "A-'), n, F.lit('", "municipios": "Calamar (Guaviare)"}, "fields": {"zone": "north"}, "body_paragraphs": ["p1", "p2"]')))
        .otherwise(F.concat(F.when(i % 3 == 0, F.concat(F.lit('"url": '), q(F.col("url")), F.lit(", "))).otherwise(F.lit("")), F.lit('"a": '), n, F.lit(', "b": {"c": 1}, "d": [2.5, null, true, ""], "images": ["z"]')))
    )
    own = read(spark, sf_dir, "pages").select(F.concat(n, F.lit(".json")).alias("path"), F.encode(F.concat(F.lit("{"), shape, F.lit("}")), "utf-8").alias("content"))
    got = files.extracted(own)
    text = F.when(F.col("title") == "", F.regexp_replace("text", r"^url: [^\n]*\n", "")).otherwise(F.col("text"))
    return got.select(F.regexp_extract("path", r"(\d+)\.json", 1).cast("long").alias("page_id"), "title", "url", text.alias("text"))


@query("""
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'image' WHEN 2 THEN 'pbf' ELSE 'json' END AS format, CASE page_id % 4 WHEN 3 THEN '' ELSE 'f' || page_id END AS title,
      CASE page_id % 4 WHEN 0 THEN 'line one' || chr(10) || 'line ' || page_id WHEN 1 THEN 'Imagen del corpus: f' || page_id ELSE '' END AS text, page_id % 4 >= 2 AS failed FROM pages""")
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, images without OCR, a format without a parser and broken JSON: errors are data."""
    i = F.col("page_id")
    ext = F.when(i % 4 == 0, ".TXT").when(i % 4 == 1, ".png").when(i % 4 == 2, ".pbf").otherwise(".json")
    own = read(spark, sf_dir, "pages").select(F.concat(F.lit("a/f"), i.cast("string"), ext).alias("path"), F.encode(F.concat(F.lit("line  one \nline "), i.cast("string")), "utf-8").alias("content"))
    got = files.extracted(own)
    return got.select(F.regexp_extract("path", r"f(\d+)\.", 1).cast("long").alias("page_id"), "format", "title", "text", (F.col("error") != "").alias("failed"))


_BLOCKS = "SELECT l_suppkey AS page, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS k, 'b' || l_orderkey || '-' || l_linenumber AS t FROM lineitem"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of blocks: even ones have two columns under a wide heading, odd ones have one."""
    from pyspark.sql import Window as W

    l = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.concat(F.lit("b"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("text"), F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")).alias("k"))
    two, wide = F.col("page") % 2 == 0, F.col("k") == 1
    left = F.col("k") % 2 == 0
    x0 = F.when(two & ~wide & ~left, 320.0).otherwise(30.0)
    x1 = F.when(two & ~wide & left, 280.0).otherwise(570.0)
    y0 = F.col("k") * 12.0
    return l.select("page", F.lit(600.0).alias("width"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + 10).alias("y1"), "text")


@query(f"SELECT page, 300.0::DOUBLE AS cut FROM ({_BLOCKS}) WHERE page % 2 = 0 GROUP BY page HAVING count(*) >= 6")
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap between 280 and 320 of 600: bins 47 to 52 of 100 are free, their middle is 300."""
    return records.columns_of(_blocks(spark, sf_dir)).select("page", F.col("cut").cast("double").alias("cut"))


@query(f"""
    WITH b AS ({_BLOCKS}), n AS (SELECT page, count(*) AS n FROM b GROUP BY page)
    SELECT page, string_agg(t, chr(10) || chr(10) ORDER BY CASE WHEN page % 2 = 0 AND n >= 6 AND k > 1 THEN 1 + k % 2 ELSE 0 END, k) AS text FROM b JOIN n USING (page) GROUP BY page""")
def page_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading, left column, right column; pages of one column from top to bottom."""
    return records.page_texts(_blocks(spark, sf_dir)).select("page", "text")


_HEAD = r"^\s*(?:\d+(?:\.\d+)*\.?\s+)?[A-ZÁÉÍÓÚÑÜ][^\n]{2,90}$"


@query(rf"""
    WITH l AS (SELECT conv_id AS doc, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM conversations WHERE turn <= 3),
    h AS (SELECT doc, turn, p, trim(line) AS line FROM l WHERE length(trim(line)) BETWEEN 12 AND 160 AND regexp_matches(trim(line), '{_HEAD}'))
    SELECT doc, line AS title FROM h QUALIFY row_number() OVER (PARTITION BY doc ORDER BY turn, p) = 1""")
def title_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    return records.guess_title(c)


@query("""
    WITH c AS (SELECT conv_id, turn, conv_id * 100 + turn AS n, CASE WHEN turn % 3 = 0 THEN 'Question ' || conv_id || '/' || turn END AS q FROM conversations),
    f AS (SELECT *, last_value(q IGNORE NULLS) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS question FROM c)
    SELECT question, count(*) AS n_fragments, string_agg('fragment ' || n, '|' ORDER BY n) AS fragments, string_agg(CASE WHEN turn % 2 = 0 THEN 'f' || n || '.pdf' END, '|' ORDER BY n) AS files FROM f WHERE question IS NOT NULL GROUP BY question""".replace("string_agg(CASE WHEN turn % 2 = 0 THEN 'f' || n || '.pdf' END, '|' ORDER BY n)", "coalesce(string_agg(CASE WHEN turn % 2 = 0 THEN 'f' || n || '.pdf' END, '|' ORDER BY n), '')"))
def gold_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet whose rows have one cell more than its header, as numbered rows do; blank questions continue."""
    n = F.col("conv_id") * 100 + F.col("turn")
    question = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Question "), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))).otherwise(F.lit(" "))
    document = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("chunk 7\n f"), n.cast("string"), F.lit(".pdf "))).otherwise(F.lit("none"))
    rows = read(spark, sf_dir, "conversations").select(n.alias("n"), F.array(n.cast("string"), question, F.lit("note"), F.concat(F.lit("fragment "), n.cast("string")), document).alias("cells"))
    header = spark.createDataFrame([(-1, ["Pregunta ", "Nota", "fragmento", "DOCUMENTO"])], "n long, cells array<string>")
    got = records.gold(records.gold_rows(header.unionByName(rows)))
    return got.select("question", F.size("fragments").cast("long").alias("n_fragments"), F.array_join("fragments", "|").alias("fragments"), F.array_join("files", "|").alias("files"))


@query("SELECT doc_id, lang, source, coalesce(text, '') AS text, len(coalesce(text, ''))::BIGINT AS size FROM documents")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, read again with their types."""
    path = scratch(spark, "jsonl")
    sinks.write_jsonl(read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text")), path)
    got = records.read_jsonl(spark, path, "doc_id long, lang string, source string, text string")
    return got.withColumn("size", F.length("text").cast("long"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a table partitioned by status; the partition column comes back with its type."""
    path = scratch(spark, "table")
    sinks.write_table(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, ["o_orderstatus"])
    return spark.read.schema("o_orderkey long, o_totalprice double, o_orderstatus string").parquet(path).select("o_orderkey", "o_orderstatus", "o_totalprice")
