"""Secret scans: exact patterns, and a linear-chain conditional random field that tags tokens as secret
begin, inside or outside from shape, neighbouring words and file features.

Trained in the driver from small labelled tables made by rule with fixed seeds, one of lines with secrets or numbers and
one of plain words, names and paths. Every token of a text is scored and decoded. Spans that the field adds have the kind
'secret' and never overlap a base span; base spans always stay.

Null text: no spans. Empty text: no spans. Extra columns pass through; a column named as the output is replaced.
Repeated rows each get their own result. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from random import Random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm import crf, spans

KINDS = ["assign", "access", "hex", "secret"]
LABELS = ["O", "B-secret", "I-secret"]
MARK = "<SECRET>"


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = ["password", "passwd", "secret", "token"]
ASSIGN = re.compile(f"(?:{'|'.join(map(_either, KEYWORDS))}|{_either('api')}_?{_either('key')})" + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\s\"'`,;(){}<>\[\]]+")
EDGE = ".:!?|*&$%#"
CODE = "{};="


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind; a failing match is dropped and not retried."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


#: c / n * log2(c / n) by n and c, for the lengths that nearly all tokens have.
TERMS = [[0.0, *(c / n * math.log2(c / n) for c in range(1, n + 1))] for n in range(33)]


def _entropy(token: str) -> float:
    n = len(token)
    if n < len(TERMS):
        return -sum(map(TERMS[n].__getitem__, map(token.count, dict.fromkeys(token))))
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def _word_shape(core: str) -> str | None:
    """crf.shape of small letters, capitals or a capital before small letters; None for all else."""
    if not core.isalpha():
        return None
    if core.islower():
        return "x"
    if core[0].isupper() and core[1:].islower():
        return "Xx"
    return "X" if core.isascii() and core.isupper() else None


def features(token: str) -> list[str]:
    core = token.strip(EDGE)
    if shape := _word_shape(core):  # the same as below, for most tokens
        length = min(len(core), 64) // 8
        out = ["b", f"l={length}", f"h={int(2 * _entropy(core))}", f"m={shape}", f"m={shape},l={length}", "r=0", f"s={shape}"]
        return [*out, "w=" + core.lower()] if len(core) < 16 else out
    digits = len(DIGIT.findall(core))
    mixed = "".join(k for k, f in (("d", str.isdigit), ("X", str.isupper), ("x", str.islower)) if any(map(f, core)))
    out = ["b", f"l={min(len(core), 64) // 8}", f"h={int(2 * _entropy(core))}", f"m={mixed}", f"m={mixed},l={min(len(core), 64) // 8}", f"r={10 * digits // max(1, len(core))}"]
    runs = crf.shape(core)
    out.append("s=" + runs if len(runs) < 10 else f"s#{min(len(runs), 40) // 5}")
    head = re.match(r"[A-Za-z]{2,5}[_-]", core)
    if head:
        out.append("p=" + head[0].lower())
    if re.search(r"[@/:]", core):
        out.append("url" if "/" in core else "at" if "@" in core else "colon")
    if not digits and len(core) < 16:
        out.append("w=" + core.lower())
    return out


def file_features(text: str) -> list[str]:
    """Of a whole document: how much of it looks like code, and how long its lines are."""
    lines = text.count("\n") + 1
    return [f"code={min(3, 20 * sum(map(text.count, CODE)) // (len(text) + 1))}", f"line={min(4, len(text) // lines // 40)}"]


def labelled_table(rows: int = 600, seed: int = 11) -> list[tuple[list[str], list[str], list[str]]]:
    """Tokens, labels and file features of short invented lines, each with at most one secret."""
    r = Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "on", "th", "re", "la", "de", "ch", "ou", "ing"]) for _ in range(r.randint(1, 3)))
    num = lambda n: "".join(str(r.randint(0, 9)) for _ in range(n))
    lower, alnum = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda s, n: "".join(r.choice(s) for _ in range(n))
    secret = [
        lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: "xoxb-" + num(11) + "-" + pick(alnum, 24), lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
        lambda: "eyJ" + pick(alnum, 20) + "." + "eyJ" + pick(alnum, 40) + "." + pick(alnum + "-_", 43), lambda: pick(alnum + "/+", 40), lambda: pick("0123456789abcdef", r.choice([32, 40, 64])), lambda: "AIza" + pick(alnum + "-_", 35), lambda: pick(alnum, r.randint(20, 32)) + "=" * r.randint(0, 2),
    ]
    weak = [lambda: word() + num(3), lambda: pick(alnum, r.randint(8, 14)), lambda: pick(alnum[:52], r.randint(10, 16))]
    spelled = lambda: r.choice([word, lambda: word().capitalize(), lambda: word() + word() + word()])()
    plain = [
        lambda: f"{num(1)}.{num(1)}", lambda: "19" + num(2), lambda: f"20{num(2)}-0{num(1)}-1{num(1)}", lambda: num(r.randint(1, 9)), lambda: num(16), lambda: ".".join(num(2) for _ in range(4)), lambda: f"{word()}.{num(2)}@mail{num(1)}.example.com",
        lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: word() + num(2), lambda: f"https://{word()}.com/{word()}/{num(3)}", lambda: f"{word()}_{word()}", lambda: f"{word()}={num(1)}", lambda: f"{num(2)}:{num(2)}", lambda: "_" * r.randint(1, 12), lambda: "=" * r.randint(1, 12),
        lambda: word().upper() + "_" + word().upper(), lambda: "_".join(word() for _ in range(4)), lambda: f"{num(4)} {num(4)} {num(4)} {num(4)}", lambda: f"{pick('0123456789abcdef', 8)}-{pick('0123456789abcdef', 4)}-4{pick('0123456789abcdef', 3)}",
    ]
    cues = ["token", "secret", "password", "key", "bearer", "api_key", "authorization"]
    out = []
    for i in range(rows):
        before, after = [word() for _ in range(r.randint(1, 3))], [word() for _ in range(r.randint(0, 3))]
        doc = r.choice([["code=0", "line=1"], ["code=0", "line=4"], ["code=1", "line=0"], ["code=2", "line=0"]])
        if i % 2:
            strong = r.random() < 0.7
            if not strong or r.random() < 0.5:
                before += [r.choice(cues)] if r.random() < 0.5 else [r.choice(cues), "="]
            if not strong:
                before = [*before[:-1], r.choice(["password", "passphrase", "pwd"])]
            middle = [r.choice(secret if strong else weak)()]
            tags = ["B-secret"]
        elif i % 6 == 0:  # a cue word before plain words
            middle = [r.choice(cues), *(["="] if r.random() < 0.2 else []), spelled(), spelled()]
            tags = ["O"] * len(middle)
        else:
            middle = r.choice(plain)().split(" ")
            tags = ["O"] * len(middle)
        out.append(([*before, *middle, *after], ["O"] * len(before) + tags + ["O"] * len(after), doc))
    return out


def plain_table(rows: int = 400, seed: int = 12) -> list[tuple[list[str], list[str], list[str]]]:
    """As labelled_table, without secrets: words of any case and length, signs, names, paths and addresses of letters."""
    r = Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "on", "th", "re", "la", "de", "ch", "ou", "ing", "é", "schaft"]) for _ in range(r.randint(1, 3)))
    long = lambda: "".join(word() for _ in range(r.randint(1, 5)))
    forms = [
        word, long, lambda: long().capitalize(), lambda: long().upper(), lambda: word().capitalize() + word().capitalize(), lambda: r.choice(["!!", "...", "--", "*", "?", "/", "##"]), lambda: f"{long()}-{long()}",
        lambda: r.choice(["http", "https"]) + f"://www.{word()}.org/" + "/".join(long() for _ in range(r.randint(0, 4))) + r.choice(["", "/", ".html"]), lambda: f"{word()}.{word()}@{word()}.com", lambda: f"{long()}/{long()}.{word()}", lambda: f"{word()}.{word().capitalize()}.{long()}",
    ]
    out = []
    for _ in range(rows):
        tokens = [r.choice(forms)() for _ in range(r.randint(3, 9))]
        out.append((tokens, ["O"] * len(tokens), r.choice([["code=0", "line=1"], ["code=0", "line=4"], ["code=1", "line=0"], ["code=2", "line=0"]])))
    return out


def fit(table: list[tuple[list[str], list[str], list[str]]] | None = None) -> crf.Crf:
    return crf.train([([features(t) for t in tokens], tags, doc) for tokens, tags, doc in table or labelled_table() + plain_table()], LABELS)


def tagged_spans(texts: list[str], tagger: crf.Tagger) -> list[list[tuple[int, int]]]:
    """The random field's spans of each text, without surrounding punctuation."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    docs = [tagger.model.document(file_features(x)) for x in texts]
    for n, found in enumerate(tagger.label(texts, TOKEN, docs)):
        wide: list[tuple[int, int]] = []
        for tag, s, e in found:
            if tag.startswith("B"):
                wide.append((s, e))
            else:
                wide[-1] = (wide[-1][0], e)
        for s, e in wide:
            while e > s and texts[n][e - 1] in EDGE:
                e -= 1
            if e > s:
                out[n].append((s, e))
    return out


def find(docs: DataFrame, text: str = "text", out: str = "spans", model: crf.Crf | None = None) -> DataFrame:
    """docs with the secrets of each text as an array of spans (see spans.SPAN_TYPE)."""
    model = model or fit()

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = crf.Tagger(model, features)
        for batch in batches:
            texts = [x or "" for x in batch]
            rows = []
            for x, more in zip(texts, tagged_spans(texts, tagger), strict=True):
                found = base_spans(x)
                taken = [(s, e) for _, s, e in found]
                rows.append(spans.ordered([(k, s, e, "base") for k, s, e in found] + [("secret", *x, "crf") for x in spans.free(more, taken)], KINDS))
            yield pd.Series(rows, index=batch.index, dtype=object)

    scan.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out, F.pandas_udf(scan, spans.SPAN_TYPE)(F.col(text)))


def redact(docs: DataFrame, text: str = "text", mark: str = MARK, model: crf.Crf | None = None) -> DataFrame:
    """docs with every secret in the text replaced by mark; other texts, and null, stay as they are."""
    model = model or fit()

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = crf.Tagger(model, features)
        for batch in batches:
            texts = [x or "" for x in batch]
            more = tagged_spans(texts, tagger)
            yield pd.Series([None if x is None else spans.cut_out(x, [(s, e) for _, s, e in base_spans(x)] + m, mark) for x, m in zip(batch, more, strict=True)], index=batch.index, dtype=object)

    scan.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(text, F.pandas_udf(scan, "string")(F.col(text)))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of op10: counts and digest of the base spans, and all spans as text."""
    found = find(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(spans.n_base(F.col("spans"), k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(spans.joined(spans.base(F.col("spans"))), 256).alias("base_sha256"),
        spans.joined(F.col("spans")).alias("spans"),
    )
