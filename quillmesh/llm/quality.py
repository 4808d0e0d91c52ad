"""Quality rules: a decision list learnt from labelled text statistics by sequential covering.

Each rule is a conjunction of thresholds on ratios. A rule is grown on two thirds of the labelled rows, one
threshold at a time, by information gain, and pruned on the other third; rows that it covers leave, and the next
rule is learnt. Learning stops when a rule is no longer precise. The list becomes one ordered conditional
expression of Spark: the first rule that holds rejects, and what no rule rejects is kept.

Fit: at most `max_rows` labelled rows of each class (drawn by a hash of doc_id) lend their statistics; only
numbers reach the driver. Statistics of the corpus are of whole texts.

Null text: no words, so the base rules reject it. Labels: see toxicity.sample's rules on repeats and nulls.
Without labels of both kinds the list is empty and only the base rules reject. Extra columns pass through; a
column named as the output is replaced. Repeated rows each get their own result. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_alpha", "n_digits", "n_punct", "n_distinct"]
STATS_TYPE = "struct<" + ",".join(f"{x}:long" for x in STATS) + ">"
#: The most labelled rows of each class in a fit.
MAX_ROWS = 4000
MIN_WORDS, MAX_REPEAT = 50, 50


def repeated(words: list[bytes]) -> tuple[int, int]:
    """Words in 3-word windows found at least twice, and distinct words."""
    n, number = len(words), {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if n < 4:
        return 0, len(number)
    pair = ids[:-2] * len(number) + ids[1:-1]
    if len(number) > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    _, inverse, count = np.unique(pair * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    mark = np.zeros(n, bool)
    for k in range(3):
        mark[k : n - 2 + k] |= again
    return int(mark.sum()), len(number)


def statistics(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: splits at exactly the six ASCII blanks
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            dup += line in seen
            seen.add(line)
    n_repeat, distinct = repeated(words)
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, int)
    upper, lower, high = codes[65:91].sum(), codes[97:123].sum(), codes[192:].sum()
    return (
        len(words), len(text) - sum(int(codes[ord(c)]) for c in BLANKS), sum(int(codes[ord(c)]) for c in SYMBOLS), dup, n_repeat, lines, len(text),
        int(upper), int(upper + lower + high), int(codes[48:58].sum()), int(codes[[33, 63, 46, 44, 59, 58]].sum()), distinct,
    )


def with_statistics(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([statistics(x or "") for x in batch], columns=STATS, dtype=np.int64)

    scan.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return docs.withColumn(out, F.pandas_udf(scan, STATS_TYPE)(F.col(text)))


#: Ratios that rules may test: numerator, denominator (1 for none).
RATIOS = {
    "words": ("n_words", None), "mean_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "n_alpha"), "alpha": ("n_alpha", "n_chars"), "digits": ("n_digits", "n_chars"), "punct_per_word": ("n_punct", "n_words"), "distinct": ("n_distinct", "n_words"), "words_per_line": ("n_words", "n_lines"),
}


def ratio(stats: Column, name: str) -> Column:
    over, under = RATIOS[name]
    x = stats[over].cast("double")
    return x if under is None else x / F.greatest(stats[under], F.lit(1))


@dataclass(frozen=True)
class Condition:
    name: str
    at_least: bool
    threshold: float

    def column(self, stats: Column) -> Column:
        x = ratio(stats, self.name)
        return x >= self.threshold if self.at_least else x < self.threshold

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(RATIOS).index(self.name)]
        return v >= self.threshold if self.at_least else v < self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < most and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-9
        for name, v in zip(RATIOS, x.T, strict=True):
            cuts = np.unique(np.quantile(v[inside & bad], np.linspace(0, 1, 33)))
            for cut in cuts:
                for up in (True, False):
                    c = inside & ((v >= cut) if up else (v < cut))
                    p, n = (c & bad).sum(), (c & ~bad).sum()
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = Condition(name, up, float(cut)), g
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, precision: float = 0.9, max_rules: int = 12, max_terms: int = 4) -> list[Rule]:
    """x: a row of RATIOS for each example; bad: whether it should go."""
    rules: list[Rule] = []
    order = np.random.default_rng(5).permutation(len(x))
    x, bad = x[order], bad[order]
    while bad.sum() >= 3 and len(rules) < max_rules:
        hold = np.arange(len(x)) % 3 == 2
        rule = _grow(x[~hold], bad[~hold], max_terms)

        def worth(r: Rule) -> float:
            c = _covered(r, x[hold])
            p, n = (c & bad[hold]).sum(), (c & ~bad[hold]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        if rule:
            rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        c = _covered(rule, x)
        if not rule or not (c & bad).any() or (c & bad).sum() < precision * c.sum():
            break
        rules.append(rule)
        x, bad = x[~c], bad[~c]
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[Rule]:
    y = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("_y"))
    ids = [(r["doc_id"], int(r["_y"])) for k in (0, 1) for r in y.where(F.col("_y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()]
    if not ids:
        return []
    few = docs.sparkSession.createDataFrame(ids, "_id long, _y int")
    # of several rows with one doc_id the least text counts, so repeats don't enlarge the sample
    drawn = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_y").alias("_y"))
    rows = with_statistics(drawn).select("doc_id", "_y", *(ratio(F.col("stats"), k).alias(k) for k in RATIOS)).collect()
    rows.sort(key=lambda r: tuple(r))
    return learn(np.array([list(r)[2:] for r in rows], float).reshape(len(rows), len(RATIOS)), np.array([r["_y"] == 0 for r in rows], bool))


def verdict(stats: Column, rules: list[Rule]) -> Column:
    """The ordered conditional expression: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        holds = rule[0].column(stats)
        for c in rule[1:]:
            holds = holds & c.column(stats)
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT * stats["n_words"])


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of op7."""
    rules, s = fit(docs, labels), F.col("stats")
    failed = base_failed(s)
    return with_statistics(docs.select("doc_id", "text")).select("doc_id", *(s[k].alias(k) for k in STATS[:5]), failed.alias("base_failed"), (~failed & verdict(s, rules)).alias("kept"))
