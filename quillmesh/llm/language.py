"""Language ID: segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over
all its segmentations into pieces, by the forward algorithm; a text's is the product over its words. The piece
probabilities are fitted by expectation maximisation on at most `max_rows` documents of each language (drawn by a
hash of doc_id: the documented bound of the sample). Texts are scored whole: the distinct words of a batch are
scored together, by length, in numpy.

Null text, or one without a letter: 'und' with score 0. Training rows with null lang or null text are left out; with
no training rows every text is 'und'. Ties go to the first language by code point. Extra columns pass through, whatever
their names; columns named as the outputs are replaced. Repeated rows each get the same result. An empty table stays empty.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.llm.common import private, remainder

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"
WORD = re.compile(r"[^\W\d_]+")
#: The most documents of each language in a fit.
MAX_ROWS = 300
UNKNOWN = 1e-8
#: Distinct words scored in one call.
WORDS = 40_000
MULT = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """All pieces that can be part of a word: of letters in lower case, with or without the start mark, of any length."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if p.removeprefix(START).isalpha() and p == p.lower()}
    return sorted(pieces | {START})


def _hash(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(codes.shape[:-1], np.uint64)
    for k in range(codes.shape[-1]):
        h = (h ^ codes[..., k]) * MULT
        h ^= h >> np.uint64(32)
    return h


class Pieces:
    """Numbers of pieces by hash of their characters."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        h = np.array([_hash(np.array([[ord(c) for c in p]], np.uint64))[0] for p in pieces], np.uint64)
        order = np.argsort(h)
        self.keys, self.ids, self.lengths = h[order], order, sorted({len(p) for p in pieces})

    def find(self, words: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """words: (n, t) characters -> for each (start, length) the number of each word's piece there, self.n for none."""
        out, t = {}, words.shape[1]
        for start in range(t):
            h = np.zeros(len(words), np.uint64)
            for length in range(1, min(self.lengths[-1], t - start) + 1):
                h = (h ^ words[:, start + length - 1]) * MULT
                h ^= h >> np.uint64(32)
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                if length == 1 or hit.any():
                    out[start, length] = np.where(hit, self.ids[at], self.n)
        return out


def by_length(words: list[str], most: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of words, their characters), words of one length together."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        step = max(1, min(most, 4_000_000 // max(1, int(size[part[0]])))) if len(part) else 1
        for at in range(0, len(part), step):
            p = part[at : at + step]
            yield p, np.frombuffer("".join(words[i] for i in p).encode("utf-32-le"), np.uint32).reshape(len(p), -1).astype(np.uint64)


@dataclass
class Model:
    pieces: list[str]
    langs: list[str]
    probs: np.ndarray  # (pieces + 1, languages); the last row is of a character without a piece
    prior: np.ndarray


def forward(found: dict[tuple[int, int], np.ndarray], probs: np.ndarray, t: int) -> np.ndarray:
    """Log of the sum over segmentations, for each word and language; scaled, so words may have any length."""
    none = len(probs) - 1
    n = len(next(iter(found.values())))
    longest = max(k for _, k in found)
    alpha, scale = [np.ones((n, probs.shape[1]))], np.zeros(n)
    for j in range(1, t + 1):
        a = np.zeros((n, probs.shape[1]))
        for length in range(1, min(longest, j) + 1):
            ids = found.get((j - length, length))
            if ids is not None:
                p = probs[ids]
                if length > 1:
                    p = p * (ids != none)[:, None]
                a += alpha[-length] * p
        alpha = [*alpha[-longest:], a]
        if j % 16 == 0 or j == t:
            m = np.maximum(a.max(1), 1e-300)
            scale += np.log(m)
            alpha = [x / m[:, None] for x in alpha]
    return np.log(np.maximum(alpha[-1], 1e-300)) + scale[:, None]


def fit_counts(words: dict[str, Counter], docs: dict[str, int], pieces: list[str], rounds: int = 3) -> Model:
    """words: of each language, its words with their counts."""
    langs = sorted(words)
    chars = {c for cs in words.values() for w in cs for c in w}
    pieces = sorted({*pieces, *chars})
    index, none = Pieces(pieces), len(pieces)
    probs = np.zeros((none + 1, len(langs)))
    for g, lang in enumerate(langs):
        texts = [START + w for w in words[lang]]
        weight = np.array(list(words[lang].values()), float)
        groups = [(weight[at], index.find(codes), codes.shape[1]) for at, codes in by_length(texts)]
        count = np.zeros(none + 1)
        for w, found, _ in groups:  # at first each piece counts as often as it occurs
            for ids in found.values():
                count += np.bincount(ids, w, none + 1)
        for _ in range(rounds):
            count[none] = 0
            p = count / max(count.sum(), 1)
            p[none] = UNKNOWN
            count = np.zeros(none + 1)
            for w, found, t in groups:
                n = len(w)
                longest = max(k for _, k in found)
                q = {k: np.where((ids != none) | (k[1] == 1), p[ids], 0) for k, ids in found.items()}
                fore, back, norm = [np.ones(n)], {t: np.ones(n)}, []
                for j in range(1, t + 1):
                    a = sum(fore[j - length] / (np.prod(norm[j - length :], axis=0) if j - length < len(norm) else 1.0) * q[j - length, length] for length in range(1, min(longest, j) + 1) if (j - length, length) in q)
                    m = np.maximum(a, 1e-300)
                    fore.append(a / m)
                    norm.append(m)
                for i in range(t - 1, -1, -1):
                    b = np.zeros(n)
                    for length in range(1, min(longest, t - i) + 1):
                        if (i, length) in q:
                            over = np.prod(norm[i : i + length], axis=0)
                            share = q[i, length] / over * back[i + length]
                            b += share
                            count += np.bincount(found[i, length], w * fore[i] * share, none + 1)
                    back[i] = b
        probs[:, g] = count
    probs = np.nan_to_num(probs)
    total = np.maximum(probs.sum(0), 1)
    shared = (probs.sum(1, keepdims=True) + 0.01) / (total.sum() + 0.01 * len(probs))
    probs = (probs + 2.0 * len(langs) * 100 * shared) / (total + 2.0 * len(langs) * 100)
    probs[none] = UNKNOWN
    n_docs = np.array([docs[x] for x in langs], float)
    return Model(pieces, langs, probs, np.log((n_docs + 1) / (n_docs.sum() + len(langs))))


def fit(docs: DataFrame, keep: Column, max_rows: int = MAX_ROWS, path: str = VOCABULARY) -> Model | None:
    """Fit on rows where keep holds and lang and text aren't null."""
    rows = docs.select("doc_id", "lang", "text").where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n_docs = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n_docs:
        return None
    # a share of each language that surely holds enough rows, so that no task ranks a whole language
    share = F.lit(False)
    for lang, n in n_docs.items():
        share = share | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, 3 * max_rows / n))))
    drawn = rows.where(share).select("doc_id", "lang", F.row_number().over(W.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id")).alias("_r")).where(F.col("_r") <= max_rows)
    ids = [(r["doc_id"], r["lang"]) for r in drawn.select("doc_id", "lang").collect()]
    few = docs.sparkSession.createDataFrame(ids, "_id long, _lang string").distinct()
    # of several rows with one doc_id and lang the least text counts, so repeats don't enlarge the sample
    drawn = rows.join(F.broadcast(few), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")))
    texts = drawn.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text").toLocalIterator()
    words: dict[str, Counter] = {x: Counter() for x in n_docs}
    for r in texts:
        words[r["lang"]].update(WORD.findall(r["text"].lower()))
    return fit_counts(words, n_docs, vocabulary(path))


def predict(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the likeliest language of each text and its posterior probability."""
    if model is None:
        return docs.withColumn(lang, F.lit("und")).withColumn(score, F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        index = Pieces(m.pieces)
        for batch in batches:
            number: dict[str, int] = {}
            ids, sizes = [], []
            for x in batch:
                own = [number.setdefault(w, len(number)) for w in WORD.findall(x.lower())] if x else []
                ids.append(np.array(own, np.int32))
                sizes.append(len(own))
            words = list(number)
            table = np.zeros((len(words) + 1, len(m.langs) + 1))
            for at, codes in by_length([START + w for w in words]):
                table[at, :-1] = forward(index.find(codes), m.probs, codes.shape[1])
            table[:-1, -1] = [any(map(str.isalpha, w)) for w in words]
            table[table[:, -1] == 0] = 0
            pred, conf = [], []
            for own in ids:
                s = table[own].sum(0)
                if not s[-1]:
                    pred.append("und")
                    conf.append(0.0)
                    continue
                f = s[:-1] + m.prior
                best = int(f.argmax())
                pred.append(m.langs[best])
                conf.append(float(1 / np.exp(f - f[best]).sum()))
            yield pd.DataFrame({"lang": pred, "score": conf})

    scan.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    got = F.pandas_udf(scan, "struct<lang:string,score:double>")(F.col(text))
    own = private(docs)
    return docs.withColumn(own, got).withColumns({lang: F.col(own)["lang"], score: F.col(own)["score"]}).drop(own)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of op9; learnt from rows whose crc32(doc_id) mod 4 is not 2."""
    model = fit(docs, remainder("doc_id", 4) != 2)
    held = docs.select("doc_id", "text", (remainder("doc_id", 4) == 2).alias("held_out"))
    return predict(held, model).select("doc_id", "held_out", "lang_pred", "score")
