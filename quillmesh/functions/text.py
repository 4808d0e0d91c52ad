"""Text functions as Column expressions. Only Unicode normalisation, for which Spark has no built-in, is an Arrow UDF."""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that are replaced, then patterns, in the order in which they apply.
REPLACEMENTS = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl",
    "‘": "'", "’": "'", "“": '"', "”": '"',
    "–": "-", "—": "-", "…": "...", " ": " ",
    "​": "", "‌": "", "‍": "", "﻿": "",
}
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
W = r"[\p{L}\p{N}_]"
S = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
S_NOT_NEWLINE = r"[\t\x{0b}-\x{0d}\x{1c}-\x{1f}\x{85}\p{Z}]"
PAGE_NUMBER = r"(?i)^\s*(?:p[áa]g(?:ina)?\.?\s*)?[-–—|]?\s*\d{1,4}\s*[-–—|]?\s*$"
LEADER_RUN = r"\.{4,}"
LEADER_LINE = r"\.{4,}\s*\d+\s*$"
NUMBERS_ONLY = r"^[\d\s.,;:%/()\-–—+|]*$"
SENTENCE_END = r"([.!?])\s+"
#: Stands for a cut: a control character that cleaning removes from texts.
CUT = "\x01"


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def _ascii(t: str) -> str:
    return unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()


@functools.cache
def _decompositions() -> tuple[str, str]:
    """Characters beyond ASCII whose NFKD has ASCII characters, and what stands for each: one character, or CUT for several.

    Of several characters without a letter or digit, all of which become blanks, one blank is as good.
    """
    found = {CUT: " "}
    for i in range(0x80, sys.maxunicode + 1):
        if unicodedata.decomposition(c := chr(i)) and (plain := _ascii(c)):
            found[c] = plain if len(plain) == 1 else CUT if any(map(str.isalnum, plain)) else " "
    return "".join(found), "".join(found.values())


@F.arrow_udf(StringType())
def _key(texts: pa.Array) -> pa.Array:
    """comparison_key of any text. Of a batch, only a few texts at a time are Python objects."""
    key = lambda t: " ".join("".join(c if c.isdigit() or "a" <= c <= "z" else " " for c in _ascii(t)).split())
    few = (texts.slice(at, 64).to_pylist() for at in range(0, len(texts), 64))
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([None if t is None else key(t) for t in part], pa.string()) for part in few)])


def comparison_key(text: Column | str) -> Column:
    """NFKD to ASCII, lower case, all but a-z, 0-9 and blank to a blank, ends trimmed; inner blanks are collapsed.

    Characters that decompose to one of ASCII are translated. Only texts with others (ligatures, fractions) go to Python.
    """
    t = F.col(text) if isinstance(text, str) else text
    beyond = t.rlike(r"[^\x00-\x7f]")
    one = F.when(beyond, F.translate(t, *_decompositions())).otherwise(t)
    odd = beyond & one.contains(CUT)
    plain = F.trim(F.regexp_replace(F.lower(F.regexp_replace(one, r"[^\x00-\x7f]+", "")), "[^a-z0-9]+", " "))
    return F.when(odd, _key(F.when(odd, t))).otherwise(plain)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{S}+|{S}+$", "")


def replace_characters(text: Column) -> Column:
    """One-to-one replacements by a single translate; those that change the length one by one."""
    single = {k: v for k, v in REPLACEMENTS.items() if len(v) == 1}
    gone = "".join(k for k, v in REPLACEMENTS.items() if not v)
    out = F.translate(text, "".join(single) + gone, "".join(single.values()))
    for k, v in REPLACEMENTS.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def repair_soft_hyphens(text: Column) -> Column:
    """A soft hyphen always marks a broken word: join across it, then drop the loose ones."""
    joined = F.regexp_replace(text, rf"({W})\xad{S}*({W})", "$1$2")
    return F.replace(joined, F.lit("­"), F.lit(""))


def clean(text: Column) -> Column:
    """NFC, replacements, control characters, broken words, blanks, at most one empty line. Null gives ''."""
    t = replace_characters(nfc(F.coalesce(text, F.lit(""))))
    t = F.regexp_replace(t, CONTROL, "")
    t = F.regexp_replace(t, rf"({W})[-‐‑]{S}*\n{S}*({W})", "$1$2")
    t = repair_soft_hyphens(t)
    t = F.regexp_replace(t, rf"{S_NOT_NEWLINE}+", " ")
    t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(t)


def words(text: Column) -> Column:
    """Words between blanks."""
    return F.filter(F.split(text, rf"{S}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def without_page_numbers(page: Column) -> Column:
    return F.array_join(F.filter(lines(page), lambda x: ~x.rlike(PAGE_NUMBER)), "\n")


def is_contents_page(text: Column) -> Column:
    """At least two runs of dot leaders."""
    return F.regexp_count(text, F.lit(LEADER_RUN)) >= 2


def is_noise(block: Column) -> Column:
    """Tables of contents, blocks of numbers, and long blocks that are mostly digits."""
    own = F.filter(F.transform(lines(block), strip), lambda x: x != "")
    leaders = F.size(F.filter(own, lambda x: x.rlike(LEADER_LINE)))
    digits = F.regexp_count(block, F.lit(r"\d"))
    return (
        (F.size(own) == 0)
        | (leaders >= F.greatest(F.lit(2.0), F.size(own) * 0.4))
        | F.replace(block, F.lit("\n"), F.lit(" ")).rlike(NUMBERS_ONLY)
        | ((F.length(block) > 80) & (digits > F.length(block) * 0.35))
    )


def sentences(text: Column) -> Column:
    """Split after . ! or ? and blanks; empty ones go."""
    marked = F.regexp_replace(text, SENTENCE_END, "$1" + CUT)
    return F.filter(F.transform(F.split(marked, CUT), strip), lambda s: s != "")


def truncate_words(text: Column, most: int) -> Column:
    """At most this many words; the cut moves back to the last sentence end if that keeps over half of it."""
    w = words(text)
    cut = F.array_join(F.slice(w, 1, most), " ")
    ended = F.regexp_extract(F.concat(cut, F.lit(" ")), r"(?s)^(.*[.!?…][\"'»)\]]*)\s", 1)
    whole = F.when(F.length(ended) + 1 > F.length(cut) * 0.5, ended).otherwise(cut)
    return F.when(F.size(w) <= most, text).otherwise(strip(whole))


def pairs_text(names: list[str], row: list[Column]) -> Column:
    """'name: value | name: value' of the columns that have a value."""
    parts = F.array(*(F.when((strip(v.cast("string")) != "") & F.lit(bool(n)), F.concat(F.lit(n.strip() + ": "), strip(v.cast("string")))) for n, v in zip(names, row, strict=False)))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), " | ")
