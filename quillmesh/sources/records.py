"""Tables read from files with loose shapes: inventory, queries, gold questions, tiles, page blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions.text import strip

# Names under which a query's id and text may stand, in order of preference; tile groups and paths.
ID_KEYS = ("query_id", "queryid", "id", "qid", "consulta_id", "pregunta_id")
TEXT_KEYS = ("query", "texto", "text", "consulta", "pregunta", "question", "enunciado")
QUERY_MARK = r"(?i)\bq0*(\d{1,3})\b"
TILE_PATH = r"tiles/(\d+)/(\d+)/[A-Z]*_?(\d+)\.pbf$"
FILE_NAMES = r"(?i)\.(pdf|json|csv|xlsx|txt|png|jpe?g|pbf)$"
TILE_GROUPS = {
    "grupo_EMC": "Estado Mayor Central (EMC, disidencias FARC)", "grupo_EMBF": "Estado Mayor de los Bloques y Frentes (EMBF)",
    "grupo_ELN": "Ejército de Liberación Nacional (ELN)", "grupo_CDF_AGC": "Clan del Golfo / Autodefensas Gaitanistas de Colombia (AGC)",
    "grupo_Seg_Marquetalia": "Segunda Marquetalia", "grupo_Los_Lobos": "Los Lobos", "grupo_Los_Choneros": "Los Choneros",
    "grupo_CV": "Comando Vermelho", "grupo_PCC": "Primeiro Comando da Capital (PCC)", "grupo_Others": "Otros grupos armados",
}


def inventory(rows: DataFrame, formats: dict[str, str]) -> DataFrame:
    """rows (n: row number from 1, and the seven columns below) -> documents; blank ids are left out but counted."""
    ext = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    known = F.create_map(*(F.lit(x) for kv in formats.items() for x in kv))
    x = rows.select(
        F.trim("doc_id").alias("doc_id"), F.concat(F.lit("DOC-"), F.lpad(F.col("n").cast("string"), 4, "0")).alias("sequential_id"), F.col("name").alias("source"), "folder", "observatory",
        F.regexp_extract("phenomenon", r"(\d+)", 1).cast("int").alias("class"), F.coalesce(known[ext], F.lower("kind")).alias("format"),
    )
    return x.where(F.coalesce("doc_id", F.lit("")) != "")


def audit(docs: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """measure, key, n: totals, repeated ids, missing files, and counts for each format and class."""
    total = docs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("measure"), F.lit("").alias("key"), "n")
    twice = docs.groupBy("doc_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated_ids"), F.lit(""), "n")
    out = total.union(twice)
    for c in ("format", "class"):
        out = out.union(docs.groupBy(c).count().select(F.lit(c), F.col(c).cast("string"), "count"))
    if present is not None:
        out = out.union(docs.join(present, "source", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing_files"), F.lit(""), "n"))
    return out


def queries_from_text(lines: DataFrame) -> DataFrame:
    """lines (n, value: one JSON object, or one element of an array) -> n, query_id, text. Bad lines are left out.

    Keys are compared without case, in order of preference; a missing id is q and the number of the object; a
    missing text is the first string of over 20 characters.
    """
    m = F.from_json("value", "map<string,string>")
    x = lines.select("n", m.alias("_m")).where("_m is not null")
    x = x.withColumn("_k", F.row_number().over(W.orderBy("n")))  # a query file is small
    low = F.map_from_entries(F.transform(F.map_entries("_m"), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    pick = lambda keys: F.coalesce(*(F.nullif(F.trim(F.try_element_at(F.col("_l"), F.lit(k))), F.lit("")) for k in keys))
    long_one = F.get(F.filter(F.map_values("_m"), lambda v: F.length(v) > 20), F.lit(0))
    x = x.withColumn("_l", low)
    return x.select("n", F.coalesce(pick(ID_KEYS), F.concat(F.lit("q"), F.lpad(F.col("_k").cast("string"), 3, "0"))).alias("query_id"), F.coalesce(pick(TEXT_KEYS), F.trim(long_one), F.lit("")).alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """A file of JSON lines or of one JSON array."""
    raw = spark.read.text(path, wholetext=True)
    is_array = F.ltrim("value").startswith("[")
    objects = F.when(is_array, F.from_json("value", "array<string>")).otherwise(F.split("value", "\n"))
    return queries_from_text(raw.select(F.posexplode(objects).alias("n", "value")).where(F.trim("value") != ""))


def queries_from_marks(text: DataFrame, *by: str) -> DataFrame:
    """text (value) with marks q001, q002 ... -> query_id, text: what follows a mark; of a repeated mark, the first.

    by: columns that tell texts apart, each of which has marks of its own; they are returned, too.
    """
    x = text.select(*by, F.regexp_replace("value", QUERY_MARK, "\x01$1\x02").alias("v")).select(*by, F.posexplode(F.split("v", "\x01")).alias("p", "part")).where(F.col("part").contains("\x02"))
    body = strip(F.regexp_replace(F.element_at(F.split("part", "\x02"), 2), r"\s+", " "))
    x = x.select(*by, "p", F.concat(F.lit("q"), F.lpad(F.regexp_extract("part", r"^(\d+)", 1), 3, "0")).alias("query_id"), body.alias("text")).where("text <> ''")
    return x.groupBy(*by, "query_id").agg(F.min_by("text", "p").alias("text"))


def gold_rows(sheet: DataFrame) -> DataFrame:
    """A sheet (n: row number, cells) -> n, question, fragment, document, by the names in its first row.

    Rows may have more cells than the header, which then lacks names on the left; without the three names, no rows.
    """
    head = sheet.groupBy().agg(F.min_by("cells", "n").alias("_h"), F.min("n").alias("_first"))
    wide = sheet.join(F.broadcast(head)).where(F.col("n") > F.col("_first")).agg(F.max(F.size("cells")).alias("_wide"))
    head = head.join(wide).select("_first", F.transform("_h", lambda c: F.upper(F.trim(c))).alias("_h"), F.greatest(F.lit(0), F.coalesce("_wide", F.lit(0)) - F.size("_h")).alias("_shift"))
    at = lambda name: F.array_position("_h", name).cast("int")
    x = sheet.join(F.broadcast(head.where((at("PREGUNTA") > 0) & (at("FRAGMENTO") > 0) & (at("DOCUMENTO") > 0)))).where(F.col("n") > F.col("_first"))
    cell = lambda name: strip(F.coalesce(F.get("cells", at(name) + F.col("_shift") - 1), F.lit("")))
    return x.select("n", cell("PREGUNTA").alias("question"), cell("FRAGMENTO").alias("fragment"), cell("DOCUMENTO").alias("document"))


def gold(rows: DataFrame) -> DataFrame:
    """rows (n, question, fragment, document) -> question, fragments, files; a blank question continues the one above.

    A document cell may have several lines, of which those that are file names count. A gold file is small.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    names = F.filter(F.transform(F.split(F.coalesce("document", F.lit("")), "\n"), lambda d: F.trim(d)), lambda d: d.rlike(FILE_NAMES))
    x = rows.select("n", F.last(blank("question"), ignorenulls=True).over(W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)).alias("question"), blank("fragment").alias("f"), names.alias("d"))
    g = x.where("question is not null").groupBy("question").agg(F.sort_array(F.collect_list(F.when(F.col("f").isNotNull(), F.struct("n", "f")))).alias("f"), F.sort_array(F.collect_list(F.struct("n", "d"))).alias("d"))
    return g.where(F.size("f") > 0).select("question", F.transform("f", lambda x: x["f"]).alias("fragments"), F.array_distinct(F.flatten(F.transform("d", lambda x: x["d"]))).alias("files"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents or chunks from JSON lines; lines that aren't objects are left out, missing keys are null."""
    raw = spark.read.text(path)
    return raw.select(F.from_json("value", schema).alias("_r"), F.col("value")).where(F.trim("value").startswith("{") & F.col("_r").isNotNull()).select("_r.*")


def tile_text(columns: list[str]) -> Column:
    """A row of the tile table as a sentence; columns that the table lacks count as empty."""
    col = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in columns else F.lit("")
    first = lambda *cs: F.coalesce(*(F.nullif(col(c), F.lit("")) for c in cs), F.lit(""))
    where = F.array_join(F.filter(F.array(first("b_ADM2_ES", "au_level2", "b_ADM2_PT"), first("b_ADM1_ES", "au_level1", "b_ADM1_PT"), col("au_country")), lambda x: F.trim(x) != ""), ", ")
    yes = lambda c: F.upper(F.trim(col(c))) == "SI"
    groups = F.array_join(F.filter(F.array(*(F.when(yes(c), F.lit(n)) for c, n in TILE_GROUPS.items())), lambda x: x.isNotNull()), "; ")
    some = lambda value, text: F.when(F.trim(value) != "", text)
    detail = F.trim(first("grupos_detalle_ES", "grupos_detalle_EN", "grupos_detalle_PT"))
    parts = F.array(
        F.concat(F.lit("Territorio: "), where), some(col("au_area_km2"), F.concat(F.lit("área: "), col("au_area_km2"), F.lit(" km2"))), some(col("au_population"), F.concat(F.lit("población: "), col("au_population"))),
        some(groups, F.concat(F.lit("presencia de grupos armados: "), groups)), some(detail, F.concat(F.lit("detalle: "), detail)),
        F.when(yes("au_invest_with_presence"), F.lit("investigación periodística confirma presencia de economías ilícitas")),
    )
    return F.when(where != "", F.concat(F.array_join(F.filter(parts, lambda p: p.isNotNull()), ". "), F.lit(".")))


def tiles(paths: DataFrame, table: DataFrame) -> DataFrame:
    """paths (path) and the tile table (n, tile_zoom, tile_x, tile_y, ...) -> path, z, x, y, title, text, n_places.

    A left join on the three keys in the path; of rows with one place code the first by n stays.
    """
    part = lambda k: F.regexp_extract("path", TILE_PATH, k)
    p = paths.select("path", part(1).alias("z"), part(2).alias("x"), part(3).alias("y")).where("z <> ''")
    has = [c for c in ("b_ADM2_PCODE", "au_ID_concatenated", "fid") if c in table.columns]
    code = F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in has), F.lit("")) if has else F.lit("")
    t = table.select("n", *(F.col(c).cast("string").alias(a) for c, a in (("tile_zoom", "z"), ("tile_x", "x"), ("tile_y", "y"))), code.alias("_code"), tile_text(table.columns).alias("_line"))
    t = t.groupBy("z", "x", "y", "_code").agg(F.min(F.struct("n", "_line")).alias("_r")).groupBy("z", "x", "y").agg(F.sort_array(F.collect_list("_r")).alias("_rows"))
    lines = F.filter(F.transform("_rows", lambda r: r["_line"]), lambda x: x.isNotNull())
    j = p.join(t, ["z", "x", "y"], "left").withColumn("_l", F.coalesce(lines, F.array().cast("array<string>")))
    head = F.format_string("Mapa de presencia de grupos armados y economías ilícitas en la cuenca amazónica (Amazon Underworld), tile de zoom %s, columna %s, fila %s. %d territorios registrados.", "z", "x", "y", F.size("_l"))
    text = F.when(F.size("_l") == 0, head).otherwise(F.concat(head, F.lit("\n\n"), F.array_join("_l", "\n")))
    return j.select("path", "z", "x", "y", F.format_string("Amazon Underworld — mapa z%s/x%s/y%s", "z", "x", "y").alias("title"), text.alias("text"), F.size("_l").alias("n_places"))


# Fixed values of the page layout test.
MIN_BODIES, MIN_HEIGHT, NARROW, MIN_NARROW, BINS, FROM_BIN, TO_BIN, MIN_GAP, MIN_SIDE = 6, 8, 0.62, 4, 100, 20, 80, 4, 0.25


def columns_of(blocks: DataFrame) -> DataFrame:
    """blocks (page, width, x0, y0, x1, y1, text) -> page, cut: the middle of the gap of two-column pages."""
    b = blocks.where((F.trim("text") != "") & (F.col("y1") - F.col("y0") > MIN_HEIGHT))
    n = b.groupBy("page", "width").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("x1") - F.col("x0") < F.col("width") * NARROW).alias("_narrow"))
    fit = n.where((F.col("_n") >= MIN_BODIES) & (F.col("_narrow") >= F.greatest(F.lit(float(MIN_NARROW)), F.col("_n") * 0.5)))
    narrow = b.where(F.col("x1") - F.col("x0") < F.col("width") * NARROW).join(fit.select("page"), "page", "left_semi")
    at = lambda x: F.floor(F.col(x) / F.col("width") * BINS).cast("int")
    full = narrow.select("page", F.explode(F.sequence(F.greatest(F.lit(0), at("x0")), F.greatest(F.least(F.lit(BINS - 1), at("x1")), F.greatest(F.lit(0), at("x0"))))).alias("bin")).distinct()
    all_bins = fit.select("page", "width", F.explode(F.sequence(F.lit(FROM_BIN), F.lit(TO_BIN - 1))).alias("bin"))
    free = all_bins.join(full, ["page", "bin"], "left_anti")
    island = free.withColumn("_g", F.col("bin") - F.row_number().over(W.partitionBy("page").orderBy("bin")))
    gap = island.groupBy("page", "width", "_g").agg(F.min("bin").alias("_from"), F.count(F.lit(1)).alias("_len"))
    gap = gap.withColumn("_k", F.row_number().over(W.partitionBy("page").orderBy(F.col("_len").desc(), "_from"))).where((F.col("_k") == 1) & (F.col("_len") >= MIN_GAP))
    gap = gap.select("page", ((F.col("_from") + F.col("_len") / 2) / BINS * F.col("width")).alias("cut"))
    side = narrow.join(gap, "page").groupBy("page", "cut").agg(F.count_if((F.col("x0") + F.col("x1")) / 2 < F.col("cut")).alias("_left"), F.count(F.lit(1)).alias("_all"))
    return side.where(F.least("_left", F.col("_all") - F.col("_left")) >= F.col("_all") * MIN_SIDE).select("page", "cut")


def page_texts(blocks: DataFrame) -> DataFrame:
    """page, text in reading order: by band, column, y and x; a block over the full width opens a new band."""
    b = blocks.where(F.trim("text") != "").join(columns_of(blocks), "page", "left").withColumn("_y", F.round("y0", 1)).withColumn("_x", F.round("x0", 1))
    wide = F.coalesce((F.col("x0") < F.col("cut")) & (F.col("cut") < F.col("x1")) & (F.col("x1") - F.col("x0") > F.col("width") * NARROW), F.lit(False)).cast("int")
    order = W.partitionBy("page").orderBy("_y", "_x", "text")
    b = b.withColumn("_wide", wide).withColumn("_band", F.sum("_wide").over(order.rowsBetween(W.unboundedPreceding, -1)))
    band = 2 * F.coalesce("_band", F.lit(0)) + F.col("_wide")
    column = F.when((F.col("_wide") == 1) | F.col("cut").isNull(), 0).when((F.col("x0") + F.col("x1")) / 2 < F.col("cut"), 1).otherwise(2)
    whole = F.sort_array(F.collect_list(F.struct(band.alias("b"), column.alias("c"), F.col("_y"), F.col("_x"), F.trim("text").alias("t"))))
    return b.groupBy("page").agg(whole.alias("_w")).select("page", F.array_join(F.transform("_w", lambda r: r["t"]), "\n\n").alias("text"))


def guess_title(pages: DataFrame) -> DataFrame:
    """pages (doc, page, text) -> doc, title: the first line of the first three pages that looks like a heading."""
    x = pages.where("page <= 3").select("doc", "page", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("line", F.trim("line"))
    x = x.where(F.length("line").between(12, 160) & F.col("line").rlike(r"^\s*(?:\d+(?:\.\d+)*\.?\s+)?[A-ZÁÉÍÓÚÑÜ][^\n]{2,90}$"))
    return x.groupBy("doc").agg(F.min_by("line", F.struct("page", "p")).alias("title"))


def needs_ocr(pages: DataFrame, least: int = 60) -> Column:
    """Pages with too little text, which an OCR plug-in may read; its text counts only if it has as much."""
    return F.length(F.trim("text")) < least


def forward_fill(rows: DataFrame, group: str, order: str, value: str, where: Column, out: str) -> DataFrame:
    """rows with the last value for which `where` holds, up to and including the row itself."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(F.when(where, F.col(value)), ignorenulls=True).over(w))
