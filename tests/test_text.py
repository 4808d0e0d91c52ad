"""Cleaning, languages and titles on literal texts."""

from pyspark.sql import functions as F

from quillmesh.functions import languages, text, titles


def one(spark, column, **values):
    kinds = {str: "string", int: "long", bool: "boolean"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_clean_repairs_words_and_blanks(spark):
    dirty = "  ﬁnal con­tent align­ ment two- and three-dimen-\nsional\x07 a b​  c \n\n\n\n“end”…  "
    assert one(spark, text.clean(F.col("t")), t=dirty) == 'final content alignment two- and three-dimensional a b c\n\n"end"...'
    assert one(spark, text.clean(F.col("t")), t="é") == "é"
    assert one(spark, text.clean(F.col("t")), t=None) == ""


def test_clean_is_idempotent(spark):
    t = "A  b\n\n\n\nc­ d – e"
    once = one(spark, text.clean(F.col("t")), t=t)
    assert one(spark, text.clean(F.col("t")), t=once) == once


def test_languages(spark):
    en = "the cat and the dog are in the house with a man that is not at home but they have been there for a day"
    pt = "não há mais o que fazer com a situação dos que não são como os outros e também não estão aqui para ver"
    es = "el niño que no es de la casa y los otros que están en el año más largo con una mañana para todo el pueblo"
    for lang, t in (("en", en), ("pt", pt), ("es", es), ("und", "too short"), ("und", "xx " * 40)):
        assert one(spark, languages.detect(F.col("t")), t=t) == lang
    assert one(spark, languages.detect(F.col("t")), t=None) == "und"


def test_bad_titles(spark):
    for t in ("short", "Photo by someone here", "report_final.indd", "ABC-123.45", "12 Main Street", "Bogotá, D. C. 2020", "Contents:", "12345678 9 a", "------ -- ---", "averyveryverylongfilename"):
        assert one(spark, titles.is_bad(F.col("t")), t=t), t
    assert not one(spark, titles.is_bad(F.col("t")), t="A study of orbital debris")


def test_title_resolution(spark):
    def resolve(title, body, file="OBS_annual-report_2020.pdf", kind="pdf"):
        r = one(spark, titles.resolve(F.col("t"), F.col("b"), F.col("f"), F.col("k")), t=title, b=body, f=file, k=kind)
        return r["title"], r["origin"]

    assert resolve("Microsoft Word - A study of debris.docx", "") == ("A study of debris", "metadata")
    assert resolve("AD_2016_ING_Cap_22_Nicaragua.indd", "") == ("2016 ING Cap 22 Nicaragua", "maqueta")
    assert resolve("", "short\nThe state of the orbit in our time\nmore") == ("The state of the orbit in our time", "texto")
    assert resolve("", "nothing here.") == ("annual report 2020", "archivo")
    assert resolve("data-set.csv", "", kind="csv") == ("data set", "archivo")


def test_noise_and_contents(spark):
    assert one(spark, text.is_noise(F.col("t")), t="One ...... 1\nTwo ..... 2")
    assert one(spark, text.is_noise(F.col("t")), t="12, 13 - 4%\n(5)")
    assert one(spark, text.is_noise(F.col("t")), t=" \n ")
    assert not one(spark, text.is_noise(F.col("t")), t="A sentence with 3 words.")
    assert one(spark, text.is_contents_page(F.col("t")), t="a .... 1 b ..... 2")


def test_truncation_ends_at_a_sentence(spark):
    t = "One two three. Four five six seven. Eight nine ten"
    assert one(spark, text.truncate_words(F.col("t"), 8), t=t) == "One two three. Four five six seven."
    assert one(spark, text.truncate_words(F.col("t"), 100), t=t) == t
    assert one(spark, text.truncate_words(F.col("t"), 2), t=t) == "One two"


def test_page_numbers_and_boilerplate(spark):
    from quillmesh.operators import pages

    rows = [("d", p, f"HEAD\nbody {p}\nmore {p}\n\npágina {p}") for p in range(1, 6)] + [("short", 1, "HEAD\n12\nx")]
    got = {(r["doc"], r["page"]): r["text"] for r in pages.drop_repeated_lines(spark.createDataFrame(rows, "doc string, page int, text string")).collect()}
    assert got["d", 1] == "body 1\nmore 1\n" and got["short", 1] == "HEAD\nx"
