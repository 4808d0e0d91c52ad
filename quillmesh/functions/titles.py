"""Document titles: which are junk, how they are cleaned, and where a better one comes from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.text import strip

# Patterns of titles that are of no use, and of lines that can be a title.
PRODUCTION_PREFIX = r"(?i)^(microsoft word\s*[-–]\s*|adobe indesign\s*[-–]\s*|untitled\s*[-–]?\s*|print\s*[-–]\s*|final\s*[-–]\s*|copy of\s+)"
FILE_EXTENSION = r"(?i)\.(indd|docx?|pdf|pptx?|qxd|ai|eps|pages|pub|xlsx?)\s*$"
CODE_ONLY = r"^[A-Z]{2,}[-_ ]?[\dA-Z\-_.]{2,}$"
ADDRESS = r"(?i)\b(strasse|straße|street|avenue|calle|carrera|apartado|p\.?o\.? box)\b"
LETTER_HEADER = r"(?i)^(bogot[áa]|lima|quito|caracas|madrid|washington)\s*[,.]?\s*d?\.?\s*c?\.?\s*[,.]?\s*\d*$"
LAYOUT_LABEL = r"(?i)^(cover photo|foto de portada|photo credit|cr[ée]ditos?|portada|contents?|índice|table of contents)\s*[:.]?\s*$"
CREDIT = r"(?i)^(photo|foto|image|imagen|illustration|ilustraci[óo]n|cover)\s+(by|de|por|credit)\b"
ONE_LONG_WORD = r"^[^\s]{12,}$"
CANDIDATE = r"^[\"'«¿¡(\[]?[A-ZÁÉÍÓÚÑÜ0-9][^\n]{14,150}$"
ENDS_SENTENCE = r"[.;:]\s*$"
THREE_LETTERS = r"\p{L}{3,}"


def looks_like_file(title: Column) -> Column:
    t = strip(F.coalesce(title, F.lit("")))
    return t.rlike(FILE_EXTENSION) | t.rlike(PRODUCTION_PREFIX) | t.rlike(ONE_LONG_WORD)


def is_bad(title: Column) -> Column:
    t = strip(F.coalesce(title, F.lit("")))
    bad = F.length(t) < 8
    for pattern in (CREDIT, CODE_ONLY, ADDRESS, LETTER_HEADER, LAYOUT_LABEL):
        bad = bad | t.rlike(pattern)
    return bad | looks_like_file(t) | (F.regexp_count(t, F.lit(r"\d")) > F.length(t) * 0.4) | ~t.rlike(THREE_LETTERS)


def cleaned(title: Column) -> Column:
    t = strip(F.coalesce(title, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, PRODUCTION_PREFIX, ""), FILE_EXTENSION, "")
    t = F.regexp_replace(t, r"^[ •·\-–—_\t]+|[ •·\-–—_\t]+$", "")
    return F.substring(strip(F.regexp_replace(t, r"\s+", " ")), 1, 240)


def humanised(file_name: Column) -> Column:
    t = F.regexp_replace(file_name, r"(?i)\.[a-z0-9]{1,5}$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"^[A-Z]{2,12}_", ""), r"[-_]+", " ")
    return F.substring(F.regexp_replace(F.trim(t), r"\s+", " "), 1, 180)


def from_body(text: Column, most_lines: int = 40) -> Column:
    """The first line of the body that can be a title, or ''."""
    own = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, most_lines), strip)
    fit = F.filter(own, lambda x: x.rlike(CANDIDATE) & ~x.rlike(ENDS_SENTENCE) & ~is_bad(x) & (F.regexp_count(x, F.lit(" ")) >= 2))
    return F.coalesce(F.substring(F.get(fit, F.lit(0)), 1, 200), F.lit(""))


def resolve(title: Column, text: Column, file_name: Column, file_format: Column) -> Column:
    """struct(title, origin); origin is metadata, maqueta, texto or archivo."""
    clean, body = cleaned(title), from_body(text)
    human = humanised(F.when(clean != "", clean).otherwise(title))
    pick = lambda t, origin: F.struct(t.alias("title"), F.lit(origin).alias("origin"))
    return (
        F.when(file_format.isin("csv", "xlsx"), pick(humanised(F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(file_name)), "archivo"))
        .when((clean != "") & ~is_bad(clean), pick(clean, "metadata"))
        .when((F.coalesce(title, F.lit("")) != "") & looks_like_file(title) & (F.length(human) >= 8) & human.rlike(THREE_LETTERS), pick(human, "maqueta"))
        .when(body != "", pick(body, "texto"))
        .otherwise(pick(humanised(file_name), "archivo"))
    )
