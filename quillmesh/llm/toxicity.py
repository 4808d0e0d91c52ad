"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

Fit: labelled rows are drawn by a hash of doc_id, at most `max_rows` of each class (the documented bound of the
sample; everything else covers all rows). A document's features are its distinct hashed n-grams of lower-cased
text. r = log of the ratio of smoothed class frequencies; the `n_features` n-grams whose frequencies differ most
for their rarity keep their r, and logistic regression is fitted on x * r. Scoring reads whole texts in numpy.

Null or empty text: the score of a text without features, from the intercept alone. Labels: several rows of one
doc_id count once with their greatest label; null labels and labels without a document are left out. Without
rows of both classes the score is 0 everywhere. Extra columns pass through, whatever their names; a column named as
the output of score() is replaced. Repeated rows each get the same score. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import private, remainder

ORDERS = (3, 4, 5, 6)
BITS = 20
#: The most labelled rows of each class in a fit.
MAX_ROWS = 3000
N_FEATURES = 10_000
THRESHOLD = 0.7
#: N-grams of each order hashed at a time.
BLOCK = 1 << 18


def codes(text: str) -> np.ndarray:
    """Code points of the text in lower case, between two line breaks."""
    return np.frombuffer(f"\n{text.lower()}\n".encode("utf-32-le", "surrogatepass"), np.uint32)


def hashes(c: np.ndarray) -> np.ndarray:
    """Hash numbers of every n-gram of every order, with repeats."""
    c = c.astype(np.uint64)
    out, h = [], c
    mult, mix = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    for n in range(2, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = h[:-1] * mult + c[n - 1 :]
        if n in ORDERS:
            x = (h ^ (h >> np.uint64(29))) * mix
            out.append((x >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


class Distinct:
    """Distinct hash numbers of one text in linear time: of the writes to a slot, the last one is kept.

    A long text is hashed in blocks that overlap by an n-gram less one character, so it has the n-grams of the whole.
    """

    def __init__(self) -> None:
        self.last = np.zeros(1 << BITS, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        seen, c = [], codes(text)
        for at in range(0, max(1, len(c) - min(ORDERS) + 1), BLOCK):
            h = hashes(c[at : at + BLOCK + max(ORDERS) - 1])
            order = np.arange(len(h), dtype=np.int32)
            self.last[h] = order
            seen.append(h[self.last[h] == order])
        return seen[0] if len(seen) == 1 else np.unique(np.concatenate(seen))


@dataclass
class Model:
    weights: np.ndarray  # of each hash number, 0 for those not selected
    intercept: float


def fit_rows(texts: list[str], labels: list[int], n_features: int = N_FEATURES, steps: int = 150, l2: float = 1e-3) -> Model:
    y = np.array(labels, float)
    size = 1 << BITS
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(size, np.float32), -50.0)
    distinct = Distinct()
    df = [np.zeros(size, np.float32), np.zeros(size, np.float32)]
    for text, label in zip(texts, labels, strict=True):
        df[label][distinct(text)] += 1
    n = [float((y == k).sum()) for k in (0, 1)]
    p, q = (df[1] + 1) / (n[1] + 2), (df[0] + 1) / (n[0] + 2)
    r = np.log(p / q)
    z = np.abs(p - q) / np.sqrt(p * (1 - p) / n[1] + q * (1 - q) / n[0])
    z[df[0] + df[1] < 3] = 0
    chosen = np.argsort(-z, kind="stable")[:n_features]
    chosen = chosen[z[chosen] > 2]
    slot = np.full(size, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    cols, rows = [], []
    for i, text in enumerate(texts):
        s = slot[distinct(text)]
        s = s[s >= 0]
        cols.append(s)
        rows.append(np.full(len(s), i, np.int32))
    cols, rows, rc = np.concatenate(cols), np.concatenate(rows), r[chosen].astype(np.float64)
    w, b = np.zeros(len(chosen)), float(np.log(n[1] / n[0]))
    weight = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        u = w * rc
        f = np.bincount(rows, u[cols], len(y)) + b
        res = (1 / (1 + np.exp(-np.clip(f, -40, 40))) - y) * weight
        g = np.bincount(cols, res[rows], len(w)) * rc + l2 * w
        g = np.append(g, res.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(size, np.float32)
    weights[chosen] = w * rc
    return Model(weights, b)


def sample(docs: DataFrame, labels: DataFrame, label: str, keep, max_rows: int) -> list:
    """At most max_rows rows of each class, first by a hash of doc_id: (text, label). keep: condition on doc_id.

    The labels are drawn before their texts are read; an id that has no document is not replaced. Of several rows with
    one doc_id the least text counts, so repeats don't enlarge the sample.
    """
    y = labels.where(F.col(label).isin(0, 1) & keep).groupBy("doc_id").agg(F.max(label).alias("y"))
    ids = [r for k in (0, 1) for r in y.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()]
    if not ids:
        return []
    few = docs.sparkSession.createDataFrame([(r["doc_id"], int(r["y"])) for r in ids], "_id long, _y int")
    drawn = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_id"))
    rows = drawn.groupBy("doc_id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"), F.min("_y").alias("_y")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [(r["text"], r["_y"]) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep=None, max_rows: int = MAX_ROWS) -> Model:
    rows = sample(docs, labels, label, F.lit(True) if keep is None else keep, max_rows)
    return fit_rows([t for t, _ in rows], [y for _, y in rows])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of label 1, from 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, intercept = held.value
        distinct = Distinct()
        for batch in batches:
            f = np.array([weights[distinct(x or "")].sum(dtype=np.float64) for x in batch]) + intercept
            yield pd.Series(1 / (1 + np.exp(-np.clip(f, -700, 700))), index=batch.index)

    scan.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out, F.pandas_udf(scan, "double")(F.col(text)))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """docs without those that score at the threshold or above; their columns stay as they are."""
    model = fit(docs, labels, keep=remainder("doc_id", 3) != 1, max_rows=max_rows)
    own = private(docs)
    return score(docs, model, out=own).where(F.col(own) < threshold).drop(own)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of op6; labels are learnt from rows whose crc32(doc_id) mod 3 is not 1."""
    model = fit(docs, labels, keep=remainder("doc_id", 3) != 1)
    held = docs.select("doc_id", "text", (remainder("doc_id", 3) == 1).alias("held_out"))
    return score(held, model).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
