"""Personal data: exact patterns, and a linear-chain conditional random field over word-shape features.

The base patterns are applied to whole texts by searches that are linear in the text. The random field is
trained in the driver from a small labelled table (`labelled_table`, some hundreds of short rows made by rule
with a fixed seed) and decodes every run of tokens that hold a digit or an '@'; other tokens are fixed to O.
Spans that it adds never overlap a base span, and base spans always stay.

Null text: no spans. Empty text: no spans. Extra columns pass through; a column named as the output is replaced.
Repeated rows each get their own result. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from random import Random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm import crf, spans

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O", *(f"{x}-{k}" for k in KINDS for x in "BI")]

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"\S+")
EDGE = "\"'`.,;:!?()[]{}<>|*&$%#"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _octets(parts: list[str]) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind; a failing match is dropped and not retried."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > last and text[left - 1] in LOCAL:
            left -= 1
        if left < at and (m := DOMAIN.match(text, at)):
            out.append(("email", left, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if _octets(m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def features(token: str) -> list[str]:
    core = token.strip(EDGE)
    digits = "".join(DIGIT.findall(core))
    out = ["b", "s=" + crf.shape(core), f"n={min(len(digits), 20)}", f"l={min(len(core), 40) // 4}"]
    if "@" in core:
        out.append("at+dot" if "." in core.rpartition("@")[2] else "at")
    if 14 <= len(digits) <= 19:
        out.append("luhn" if luhn(digits) else "no-luhn")
    if core.count(".") == 3 and core.replace(".", "").isdigit() and core.isascii():
        out.append("octets" if _octets(core.split(".")) else "no-octets")
    if token[:1] in "+(":
        out.append("p=" + token[0])
    if not digits and len(core) < 12:
        out.append("w=" + core.lower())
    return out


def can_carry(token: str) -> bool:
    return "@" in token or DIGIT.search(token) is not None


def labelled_table(rows: int = 480, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """Tokens and labels of short invented sentences, each with at most one entity."""
    r = Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "on", "th", "re", "la", "de", "ch", "ou", "ing"]) for _ in range(r.randint(1, 3)))
    num = lambda n: "".join(str(r.randint(0, 9)) for _ in range(n))

    def card(good: bool) -> str:
        while luhn(x := str(r.randint(3, 6)) + num(15)) != good:
            pass
        return x

    octet = lambda: str(r.randint(0, 255))
    grouped = lambda x, s: s.join(x[i : i + 4] for i in range(0, 16, 4))
    kinds = {
        "email": lambda: r.choice([f"{word()}@{word()}.com", f"{word()}.{num(2)}@mail{num(1)}.{word()}.org", f"{word()}_{word()}+{num(1)}@{word()}-{word()}.net"]),
        "ip": lambda: ".".join([octet(), octet(), octet(), octet()]),
        "card": lambda: r.choice([card(True), grouped(card(True), "-"), grouped(card(True), " ")]),
        "phone": lambda: r.choice([f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(4)}", f"+{num(2)} {num(2)} {num(8)}"]),
    }
    cues = {"email": ["email", "mail", "contact", "write"], "ip": ["ip", "host", "server", "from"], "card": ["card", "visa", "paid"], "phone": ["call", "phone", "tel", "mobile"]}
    plain = [
        lambda: card(False), lambda: f"{num(1)}.{num(1)}", lambda: f"{num(1)}.{num(1)}.{num(2)}", lambda: "19" + num(2), lambda: f"20{num(2)}-0{num(1)}-1{num(1)}", lambda: num(r.randint(1, 9)),
        lambda: f"{r.randint(256, 999)}.{octet()}.{octet()}.{octet()}", lambda: f"{num(2)}:{num(2)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)), lambda: "@" + word(), lambda: f"{num(2)}%", lambda: f"${num(2)}.{num(2)}", lambda: word() + num(2),
        lambda: f"{num(3)}-{num(3)}", lambda: f"({num(4)})", lambda: f"{num(4)}-{num(4)}", lambda: f"{num(2)} {num(3)}", lambda: grouped(card(False), " "),
    ]
    out = []
    for i in range(rows):
        before, after = [word() for _ in range(r.randint(1, 3))], [word() for _ in range(r.randint(0, 3))]
        if i % 2:
            kind = KINDS[(i // 2) % len(KINDS)]
            if r.random() < 0.5:
                before.append(r.choice(cues[kind]) + r.choice(["", ":"]))
            middle = kinds[kind]().split(" ")
            tags = ["B-" + kind] + ["I-" + kind] * (len(middle) - 1)
        else:
            middle = r.choice(plain)().split(" ")
            tags = ["O"] * len(middle)
        middle[-1] += r.choice(["", "", ".", ",", '"'])
        out.append(([*before, *middle, *after], ["O"] * len(before) + tags + ["O"] * len(after)))
    return out


def fit(table: list[tuple[list[str], list[str]]] | None = None) -> crf.Crf:
    return crf.train([([features(t) for t in tokens], tags, []) for tokens, tags in table or labelled_table()], LABELS)


def tagged_spans(texts: list[str], tagger: crf.Tagger) -> list[list[tuple[str, int, int]]]:
    """The random field's spans of each text, without surrounding punctuation."""
    runs, where, zero = [], [], tagger.model.document([])
    for n, text in enumerate(texts):
        if "@" not in text and not DIGIT.search(text):
            continue
        before, run = None, []
        for m in TOKEN.finditer(text):
            if can_carry(m[0]):
                run.append(m)
                continue
            if run:
                runs.append((before, [x[0] for x in run], m[0], zero))
                where.append((n, run))
                run = []
            before = m[0]
        if run:
            runs.append((before, [x[0] for x in run], None, zero))
            where.append((n, run))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (n, run), tags in zip(where, tagger.decode(runs), strict=True):
        open_at = None
        for i, tag in enumerate([*tags, "O"]):
            if open_at is not None and not tag.startswith("I"):
                s, e = run[open_at].start(), run[i - 1].end()
                while s < e and texts[n][s] in EDGE and texts[n][s] != "(":
                    s += 1
                while e > s and texts[n][e - 1] in EDGE:
                    e -= 1
                if e > s:
                    out[n].append((tags[open_at][2:], s, e))
                open_at = None
            if tag.startswith("B"):
                open_at = i
    return out


def find(docs: DataFrame, text: str = "text", out: str = "spans", model: crf.Crf | None = None) -> DataFrame:
    """docs with the personal data of each text as an array of spans (see spans.SPAN_TYPE)."""
    model = model or fit()

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = crf.Tagger(model, features)
        for batch in batches:
            texts = [x or "" for x in batch]
            rows = []
            for x, more in zip(texts, tagged_spans(texts, tagger), strict=True):
                found = base_spans(x)
                taken = [(s, e) for _, s, e in found]
                rows.append(spans.ordered([(k, s, e, "base") for k, s, e in found] + [(*x, "crf") for x in spans.free(more, taken)], KINDS))
            yield pd.Series(rows, index=batch.index, dtype=object)

    scan.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out, F.pandas_udf(scan, spans.SPAN_TYPE)(F.col(text)))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of op5: counts and digest of the base spans, and all spans as text."""
    found = find(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(spans.n_base(F.col("spans"), k).alias(f"n_{k}") for k in KINDS),
        F.sha2(spans.joined(spans.base(F.col("spans"))), 256).alias("base_sha256"),
        spans.joined(F.col("spans")).alias("spans"),
    )
