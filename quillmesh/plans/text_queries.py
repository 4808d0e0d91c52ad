"""Cleaning, languages, titles, pages, sentences and chunks over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import languages, titles
from quillmesh.functions import text as T
from quillmesh.operators import chunking, pages
from quillmesh.plans.registry import query, read

_REPLACED = "nfc_normalize(coalesce(text, ''))"
for _a, _b in T.REPLACEMENTS.items():
    _REPLACED = f"replace({_REPLACED}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"
#: Blanks as RE2 writes them, with and without the line break.
_S, _SN, _W = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]", r"[\t\x{0b}-\x{0d}\x{1c}-\x{1f}\x{85}\p{Z}]", r"[\p{L}\p{N}_]"


def _re(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


_STRIPPED = rf"^{_S}+|{_S}+$"
_CLEAN = _re(_REPLACED, r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}]", "")
_CLEAN = _re(_CLEAN, rf"({_W})[-‐‑]{_S}*\n{_S}*({_W})", r"\1\2")
_CLEAN = f"replace({_re(_CLEAN, rf'({_W})' + r'\x{ad}' + rf'{_S}*({_W})', r'\1\2')}, chr(173), '')"
_CLEAN = _re(_re(_re(_CLEAN, f"{_SN}+", " "), r"[ \t]+\n", chr(10)), r"\n{3,}", chr(10) * 2)
_CLEAN = _re(_CLEAN, _STRIPPED, "")


@query(f"SELECT doc_id, md5({_CLEAN}) AS cleaned, length({_CLEAN}) AS n_chars FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.clean(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", c.alias("c")).select("doc_id", F.md5("c").alias("cleaned"), F.length("c").cast("long").alias("n_chars"))


_SOFT = "replace(text, ' th', chr(173) || ' th')"
_MENDED = f"replace({_re(_SOFT, rf'({_W})' + r'\x{ad}' + rf'{_S}*({_W})', r'\1\2')}, chr(173), '')"


@query(f"SELECT doc_id, {_SOFT} <> {_MENDED} AS changed, length({_MENDED}) AS n_chars FROM documents")
def soft_hyphen_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with soft hyphens put in before ' th'."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(" th"), F.lit("­ th")).alias("t"))
    return d.withColumn("m", T.repair_soft_hyphens(F.col("t"))).select("doc_id", (F.col("t") != F.col("m")).alias("changed"), F.length("m").cast("long").alias("n_chars"))


def _language_sql() -> str:
    sample = f"lower(substr(text, 1, {languages.SAMPLE}))"
    parts = []
    for lang in languages.ORDER:
        words = ", ".join(f"'{w}'" for w in languages.STOPWORDS[lang])
        score = f"len(list_filter(w, lambda x: x IN ({words}))) / greatest(len(w), 1)::DOUBLE"
        if lang in languages.MARKS:
            score += f" + len(regexp_extract_all(s, '{languages.MARKS[lang]}')) / greatest(length(s), 1)::DOUBLE * {languages.MARK_WEIGHT}"
        parts.append(f"{score} AS {lang}")
    return f"""
    WITH a AS (SELECT doc_id, {sample} AS s, regexp_extract_all({sample}, '{languages.WORD}') AS w FROM documents),
    b AS (SELECT doc_id, len(w) AS n, {", ".join(parts)} FROM a)
    SELECT doc_id, CASE WHEN n < {languages.LEAST_WORDS} OR greatest(es, en, pt) <= {languages.LEAST_SCORE} THEN 'und'
      WHEN es = greatest(es, en, pt) THEN 'es' WHEN en = greatest(es, en, pt) THEN 'en' ELSE 'pt' END AS lang FROM b"""


@query(_language_sql())
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", languages.detect(F.col("text")).alias("lang"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a document and its documents are the pages."""
    return read(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")


_BOILER = rf"""
    own AS (SELECT source AS doc, doc_id AS page, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_STRIPPED}', '', 'g')), lambda x: x <> '') AS l FROM documents),
    ends AS (SELECT DISTINCT doc, page, unnest(list_concat(l[1:3], list_reverse(l)[1:3])) AS line FROM own),
    size AS (SELECT source AS doc, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1),
    boiler AS (SELECT e.doc, line, count(DISTINCT page) AS n_pages FROM ends e JOIN size s ON e.doc = s.doc WHERE pages >= 4 AND length(line) < 200
      GROUP BY e.doc, line, pages HAVING count(DISTINCT page) >= greatest(3, floor(pages * 0.02)))"""


@query(f"WITH {_BOILER} SELECT doc, line, n_pages FROM boiler")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.boilerplate(_pages(spark, sf_dir), min_ratio=0.02)


@query(rf"""
    WITH {_BOILER}, gone AS (SELECT doc, list(line) AS g FROM boiler GROUP BY doc)
    SELECT d.source AS doc, d.doc_id AS page, md5(array_to_string(list_filter(string_split(d.text, chr(10)),
      lambda x: NOT list_contains(coalesce(g, []::VARCHAR[]), regexp_replace(x, '{_STRIPPED}', '', 'g'))
      AND NOT regexp_matches(x, '(?i)^\s*(?:p[áa]g(?:ina)?\.?\s*)?[-–—|]?\s*\d{{1,4}}\s*[-–—|]?\s*$')), chr(10))) AS kept
    FROM documents d LEFT JOIN gone ON d.source = gone.doc""")
def drop_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.drop_repeated_lines(_pages(spark, sf_dir), min_ratio=0.02).select("doc", "page", F.md5("text").alias("kept"))


@query(r"""
    WITH n AS (SELECT doc_id, chr(10) || doc_id % 7 || chr(10) || text || chr(10) || 'Pág. ' || doc_id % 90 || ' |' AS t FROM documents)
    SELECT doc_id, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '(?i)^\s*(?:p[áa]g(?:ina)?\.?\s*)?[-–—|]?\s*\d{1,4}\s*[-–—|]?\s*$'))) AS n_removed FROM n""")
def page_number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with page numbers put in above and below."""
    t = F.concat(F.lit("\n"), (F.col("doc_id") % 7).cast("string"), F.lit("\n"), F.col("text"), F.lit("\nPág. "), (F.col("doc_id") % 90).cast("string"), F.lit(" |"))
    d = read(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", (F.size(T.lines(F.col("t"))) - F.size(T.lines(T.without_page_numbers(F.col("t"))))).cast("long").alias("n_removed"))


_TRIM = lambda x: f"regexp_replace({x}, '{_STRIPPED}', '', 'g')"
_FILE_SQL = lambda t: " OR ".join(f"regexp_matches({t}, '{p}')" for p in (titles.FILE_EXTENSION, titles.PRODUCTION_PREFIX, titles.ONE_LONG_WORD))
_BAD_SQL = lambda t: (
    f"(length({t}) < 8 OR {_FILE_SQL(t)} OR " + " OR ".join(f"regexp_matches({t}, '{p}')" for p in (titles.CREDIT, titles.CODE_ONLY, titles.ADDRESS, titles.LETTER_HEADER, titles.LAYOUT_LABEL))
    + rf" OR len(regexp_extract_all({t}, '\d')) > length({t}) * 0.4 OR NOT regexp_matches({t}, '{titles.THREE_LETTERS}'))"
)


@query(f"""
    WITH n AS (SELECT doc_id, {_TRIM("unnest(string_split(text, chr(10)))")} AS t FROM documents)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {_BAD_SQL("t")}) AS n_bad FROM n GROUP BY doc_id""")
def title_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document, how many lines could not be a title."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(T.lines(F.col("text"))).alias("t"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(titles.is_bad(F.col("t"))).alias("n_bad"))


def _title_sql() -> str:
    # every fourth document has a title of each kind: none, a file name, junk, a good one
    given = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'AD_2016_ING_Cap_' || doc_id || '_Region.indd' WHEN 2 THEN 'PO Box ' || doc_id ELSE 'Microsoft Word - Annual review number ' || doc_id END"
    clean = rf"regexp_replace(regexp_replace(title, '{titles.PRODUCTION_PREFIX}', ''), '{titles.FILE_EXTENSION}', '')"
    clean = rf"substr(trim(regexp_replace(regexp_replace({clean}, '^[ •·\-–—_\t]+|[ •·\-–—_\t]+$', '', 'g'), '\s+', ' ', 'g')), 1, 240)"
    human = lambda x: rf"substr(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)\.[a-z0-9]{{1,5}}$', ''), '^[A-Z]{{2,12}}_', ''), '[-_]+', ' ', 'g')), '\s+', ' ', 'g'), 1, 180)"
    line = "lambda x: regexp_matches(x, '" + titles.CANDIDATE.replace("'", "''") + f"') AND NOT regexp_matches(x, '{titles.ENDS_SENTENCE}') AND NOT {_BAD_SQL('x')} AND len(regexp_extract_all(x, ' ')) >= 2"
    return f"""
    WITH a AS (SELECT doc_id, {given} AS title, 'OBS_report-' || doc_id || '.pdf' AS file, text FROM documents),
    b AS (SELECT *, {clean} AS c, substr(list_filter(list_transform(string_split(text, chr(10))[1:40], lambda x: {_TRIM("x")}), {line})[1], 1, 200) AS body FROM a),
    d AS (SELECT *, {human("CASE WHEN c <> '' THEN c ELSE title END")} AS h FROM b)
    SELECT doc_id, CASE WHEN c <> '' AND NOT {_BAD_SQL("c")} THEN c WHEN title <> '' AND ({_FILE_SQL("title")}) AND length(h) >= 8 AND regexp_matches(h, '{titles.THREE_LETTERS}') THEN h
      WHEN coalesce(body, '') <> '' THEN body ELSE {human("file")} END AS title,
      CASE WHEN c <> '' AND NOT {_BAD_SQL("c")} THEN 'metadata' WHEN title <> '' AND ({_FILE_SQL("title")}) AND length(h) >= 8 AND regexp_matches(h, '{titles.THREE_LETTERS}') THEN 'maqueta'
      WHEN coalesce(body, '') <> '' THEN 'texto' ELSE 'archivo' END AS origin FROM d"""


@query(_title_sql())
def title_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 4
    given = F.when(kind == 0, "").when(kind == 1, F.concat(F.lit("AD_2016_ING_Cap_"), i, F.lit("_Region.indd"))).when(kind == 2, F.concat(F.lit("PO Box "), i)).otherwise(F.concat(F.lit("Microsoft Word - Annual review number "), i))
    got = titles.resolve(given, F.col("text"), F.concat(F.lit("OBS_report-"), i, F.lit(".pdf")), F.lit("pdf"))
    return read(spark, sf_dir, "documents").select("doc_id", got.alias("t")).select("doc_id", "t.title", "t.origin")


_NOISE_SQL = rf"""(len(own) = 0 OR len(list_filter(own, lambda x: regexp_matches(x, '{T.LEADER_LINE}'))) >= greatest(2, len(own) * 0.4)
      OR regexp_matches(replace(t, chr(10), ' '), '{T.NUMBERS_ONLY}') OR (length(t) > 80 AND len(regexp_extract_all(t, '\d')) > length(t) * 0.35))"""


@query(rf"""
    WITH a AS (SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), ['Contents ..... ' || doc_id || chr(10) || 'More ....... 12', repeat(doc_id || ' 12.5, ', 20)])) AS t FROM documents),
    b AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: {_TRIM("x")}), lambda x: x <> '') AS own FROM a)
    SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (WHERE {_NOISE_SQL}) AS n_noise FROM b GROUP BY doc_id""")
def noise_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks, with a contents list and a run of figures put in."""
    i = F.col("doc_id").cast("string")
    more = F.array(F.concat(F.lit("Contents ..... "), i, F.lit("\nMore ....... 12")), F.repeat(F.concat(i, F.lit(" 12.5, ")), F.lit(20)))
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.concat(T.lines(F.col("text")), more)).alias("t"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(T.is_noise(F.col("t"))).alias("n_noise"))


_COUNT_SQL = f"len(list_filter(regexp_split_to_array(text, '{_S}+'), lambda x: x <> ''))"


@query(f"SELECT doc_id, {_COUNT_SQL} AS n_words FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words"))


@query(f"""
    WITH n AS (SELECT source, lang, {_COUNT_SQL} AS w FROM documents)
    SELECT source, lang, count(*) AS n_docs, round(avg(w), 6) AS mean_words, median(w)::DOUBLE AS median_words, min(w) AS min_words, max(w) AS max_words,
      count(*) FILTER (WHERE w > 240) AS over_240 FROM n GROUP BY source, lang""")
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("source", "lang", T.word_count(F.col("text")).cast("long").alias("w"))
    return d.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("w"), 6).alias("mean_words"), F.median("w").alias("median_words"), F.min("w").alias("min_words"), F.max("w").alias("max_words"), F.count_if(F.col("w") > 240).alias("over_240")
    )


_SENTENCES_SQL = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_TRIM('x')}), lambda x: x <> '')"


@query(f"SELECT doc_id, len({_SENTENCES_SQL}) AS n_sentences, md5(array_to_string({_SENTENCES_SQL}, '|')) AS digest FROM documents")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.sentences(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


def _chunk_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", "source")


@query()
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(_chunk_input(spark, sf_dir)).select("doc_id", "chunk_id", "pos", "section", "n_words", "forced", F.md5("text").alias("digest"))


@query("SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Title ' || doc_id || '. ' || source ELSE source END AS text FROM documents")
def chunk_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text is gone still have one chunk."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("text"), "source", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Title "), F.col("doc_id").cast("string"))).alias("title"))
    return chunking.chunk(d).select("doc_id", "text")


@query()
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _chunk_input(spark, sf_dir)
    return chunking.statistics(chunking.chunk(d), d)


@query(f"""
    WITH a AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_S}+'), lambda x: x <> '') AS w, text FROM documents),
    b AS (SELECT doc_id, w, text, array_to_string(w[1:60], ' ') AS cut FROM a),
    c AS (SELECT *, regexp_extract(cut || ' ', '(?s)^(.*[.!?…]["''»)\\]]*)\\s', 1) AS e FROM b)
    SELECT doc_id, md5(CASE WHEN len(w) <= 60 THEN text ELSE {_TRIM("CASE WHEN length(e) + 1 > length(cut) * 0.5 THEN e ELSE cut END")} END) AS digest FROM c""".replace("\\\\", "\\"))
def truncate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.truncate_words(F.col("text"), 60)).alias("digest"))
