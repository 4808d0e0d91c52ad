"""Chunks of a document: sections, sentences, greedy packing with one sentence of overlap.

Packing depends on what was packed before, so a document is folded in Python, in Arrow batches; documents are
independent and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import word_count

# Sizes, then the patterns of headings, noise and sentence borders.
TARGET, MOST, LEAST, TRIVIAL = 190, 240, 40, 8
MD_HEADING = re.compile(r"^#{1,6}\s+(.+)$")
PLAIN_HEADING = re.compile(r"^(?:\d+(?:\.\d+)*\.?\s+)?[A-ZÁÉÍÓÚÑÜ0-9][^.!?]{3,90}$")
NUMBERED_HEADING = re.compile(r"^\d+(?:\.\d+)*\.?\s+\S")
LABEL = re.compile(r"^(fuente|source|fonte|figura|figure|tabla|table|gr[áa]fico|chart|nota|note|cuadro|mapa|map|foto|imagen|anexo|elaboraci[óo]n)\b[\s:.\d]", re.I)
LEADER = re.compile(r"\.{4,}\s*\d+\s*$")
NUMBERS = re.compile(r"^[\d\s.,;:%/()\-–—+|]*$")
CLOSED = re.compile(r"[.!?…»\"')\]][\d\s]*$")
LINE_CLOSED = re.compile(r"[.!?:;…»\"')\]]$")
LIST_ITEM = re.compile(r"^([-•·*]|\(?\d{1,3}[.)]|[a-z]\))\s+")
LOWER_START = re.compile(r"^[a-záéíóúüñ]")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
CLAUSE = re.compile(r"(?<=[;:])\s+|\s+\|\s+|\n")
COMMA = re.compile(r"(?<=,)\s+")

SCHEMA = "doc_id string, chunk_id string, pos int, section string, text string, embed_text string, n_words int, forced boolean"


def is_heading(block: str) -> bool:
    n = len(block.split())
    if len(block) > 90 or n > 14 or LABEL.match(block) or not PLAIN_HEADING.match(block):
        return False
    return bool(NUMBERED_HEADING.match(block)) or (n >= 3 and (block.isupper() or block[0].isupper()))


def is_noise(block: str) -> bool:
    lines = [x for x in map(str.strip, block.split("\n")) if x]
    leaders = sum(bool(LEADER.search(x)) for x in lines)
    dense = len(block) > 80 and sum(map(str.isdigit, block)) > 0.35 * len(block)
    return not lines or leaders >= max(2, 0.4 * len(lines)) or bool(NUMBERS.match(block.replace("\n", " "))) or dense


def blocks(text: str, headings: bool = True) -> list[tuple[str, str]]:
    """(section, block); a block that continues the one before it is appended to it."""
    out: list[tuple[str, str]] = []
    section = ""
    for block in filter(None, map(str.strip, text.split("\n\n"))):
        if "\n" not in block:
            marked = MD_HEADING.match(block)
            if marked or (headings and is_heading(block)):
                section = marked[1].strip() if marked else block
                continue
        if is_noise(block):
            continue
        if out and out[-1][0] == section and not CLOSED.search(out[-1][1]) and (LOWER_START.match(block) or len(out[-1][1].split()) >= 15):
            out[-1] = (section, f"{out[-1][1]} {block}")
        else:
            out.append((section, block))
    return out


def unwrap(block: str) -> str:
    """Line breaks become blanks, but for those between a closed sentence and a list item."""
    lines = [x for x in map(str.strip, block.split("\n")) if x]
    out = "".join(lines[:1])
    for line in lines[1:]:
        out += ("\n" if LINE_CLOSED.search(out) and LIST_ITEM.match(line) else " ") + line
    return out


def split_sentences(text: str) -> list[str]:
    return [s for s in map(str.strip, SENTENCE.split(unwrap(text))) if s]


def split_long(sentence: str, most: int = MOST) -> list[str]:
    """Clauses, else parts at commas, else runs of words, packed up to `most` words."""
    size = lambda x: len(x.split())
    parts = []
    for clause in filter(None, map(str.strip, CLAUSE.split(sentence))):
        for part in [clause] if size(clause) <= most else filter(None, map(str.strip, COMMA.split(clause))):
            w = part.split()
            parts += [part] if len(w) <= most else [" ".join(w[i : i + most]) for i in range(0, len(w), most)]
    out: list[str] = []
    for part in parts:
        if out and size(out[-1]) + size(part) <= most and size(part) < most:
            out[-1] += " " + part
        else:
            out.append(part)
    return out


class Packer:
    """Fills chunks sentence by sentence; a buffer of carried sentences alone is never emitted."""

    def __init__(self, target: int, most: int):
        self.target, self.most = target, most
        self.out: list[tuple[str, str, bool]] = []
        self.buffer: list[tuple[str, int, bool]] = []
        self.fresh = False

    def emit(self, section: str, carry: bool) -> None:
        if self.buffer and self.fresh:
            self.out.append((section, " ".join(s for s, _, _ in self.buffer), any(f for _, _, f in self.buffer)))
        self.buffer = [(s, n, False) for s, n, _ in self.buffer[-1:]] if carry else []
        self.fresh = False

    def add(self, section: str, sentence: str, forced: bool) -> None:
        n = len(sentence.split())
        if self.buffer and sum(k for _, k, _ in self.buffer) + n > self.most:
            self.emit(section, True)
            if sum(k for _, k, _ in self.buffer) + n > self.most:
                self.buffer = []
        self.buffer.append((sentence, n, forced))
        self.fresh = True
        if sum(k for _, k, _ in self.buffer) >= self.target:
            self.emit(section, True)


def chunk_text(text: str, pre_blocks: list[str] | None = None, fallback: str = "", segment: Callable[[str], list[str]] = split_sentences, target: int = TARGET, most: int = MOST, least: int = LEAST) -> list[tuple[str, str, bool]]:
    """(section, text, cut below a sentence) of each chunk, in order."""
    if pre_blocks:
        parts = [("", b) for b in pre_blocks if b and b.strip()]
    else:
        parts = blocks(text)
        sections = {s for s, _ in parts if s}
        if parts and len(sections) > max(8, 0.12 * len(parts)):
            parts = blocks(text, headings=False)
    pack, at = Packer(target, most), None
    for section, block in parts:
        if section != at:
            pack.emit(at or "", False)
            at = section
        for sentence in segment(block):
            whole = len(sentence.split()) <= most
            for piece in [sentence] if whole else split_long(sentence, most):
                pack.add(section, piece, not whole)
    pack.emit(at or "", False)
    merged: list[tuple[str, str, bool]] = []
    for section, chunk, forced in pack.out:
        n = len(chunk.split())
        if merged and n < least and len(merged[-1][1].split()) + n <= most:
            s, before, f = merged[-1]
            merged[-1] = (s, f"{before} {chunk}", f or forced)
        else:
            merged.append((section, chunk, forced))
    merged = [m for m in merged if len(m[1].split()) >= TRIVIAL] or [("", fallback, False)]
    seen: set[str] = set()
    return [m for m in merged if not (m[1][:400] in seen or seen.add(m[1][:400]))]


def chunk(docs: DataFrame, segment: Callable[[str], list[str]] = split_sentences, target: int = TARGET, most: int = MOST, least: int = LEAST) -> DataFrame:
    """docs (doc_id, text, and optionally title, observatory, source, url, blocks) -> chunks.

    Every document has a chunk: one without usable text gets its title, observatory, source and url.
    """
    has = lambda c, default: F.col(c) if c in docs.columns else default
    x = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        *(F.coalesce(has(c, F.lit("")).cast("string"), F.lit("")).alias(c) for c in ("title", "observatory", "source", "url")), has("blocks", F.lit(None).cast("array<string>")).alias("blocks"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d in batch.itertuples(index=False):
                spare = ". ".join(filter(None, (d.title.strip(), d.observatory, d.source, d.url))) or f"Documento {d.doc_id} del corpus."
                for k, (section, text, forced) in enumerate(chunk_text(d.text, None if d.blocks is None else list(d.blocks), spare, segment, target, most, least)):
                    rows.append((d.doc_id, f"{d.doc_id}-chunk-{k:04d}", k, section, text, " | ".join(filter(None, (d.title.strip(), section, text))), len(text.split()), forced))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return x.mapInPandas(run, SCHEMA)


def statistics(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """One row on the chunks of a corpus; docs: doc_id."""
    n, t = F.col("n_words"), F.trim("text")
    none = docs.select(F.col("doc_id").cast("string").alias("doc_id")).join(chunks, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("docs_without"))
    return chunks.agg(
        F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(n), 6).alias("mean_words"), F.median(n).alias("median_words"), F.min(n).alias("min_words"), F.max(n).alias("max_words"),
        F.count_if(n > 240).alias("over_240"), F.count_if(n > 250).alias("over_250"), F.count_if("forced").alias("forced"),
        F.round(F.avg(t.rlike(CLOSED.pattern).cast("int")), 6).alias("closes_sentence"), F.round(F.avg((~t.rlike(LOWER_START.pattern)).cast("int")), 6).alias("opens_sentence"),
    ).join(none)


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("n_words", word_count(F.col(text)))
