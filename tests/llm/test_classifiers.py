"""Toxicity, quality rules and languages: held-out accuracy, statistics against plain counts, odd rows."""

import itertools
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.llm import language, quality, toxicity


def test_distinct_ngrams_are_those_of_the_text(monkeypatch):
    d = toxicity.Distinct()
    plain = lambda t: {int(toxicity.hashes(toxicity.codes(t)[i : i + n])[-1]) for n in toxicity.ORDERS for i in range(len(t) + 3 - n)}
    texts = ("", "a", "Idiot", "abc" * 50, "é" * 30, "the quick brown fox" * 3)
    for block in (toxicity.BLOCK, 1, 7, 64):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        for t in texts:
            assert sorted(d(t).tolist()) == sorted(set(plain(t)))


def test_long_texts_gain_no_ngrams_at_block_borders():
    d = toxicity.Distinct()
    once = set(d("abcdefgh" * 4).tolist())
    assert set(d("abcdefgh" * 200_000).tolist()) == once


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.digest(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    caught = sum(r["predicted"] for r in held if r["toxic"]) / sum(r["toxic"] for r in held)
    false = sum(r["predicted"] for r in held if not r["toxic"]) / sum(1 - r["toxic"] for r in held)
    assert caught > 0.75 and false < 0.01


def test_toxicity_of_odd_rows(make, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (99, 1), (None, 0)], "doc_id long, toxic int")
    docs = make((1, None), (2, ""), (None, "some text"), (2, "")).withColumn("score", F.lit("kept"))
    got = toxicity.digest(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.digest(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.reject(docs, labels).columns == docs.columns
    assert toxicity.digest(make(), labels).count() == 0
    for name in ("_toxicity", "_own0", "_id", "y"):
        own = docs.withColumnRenamed("n_chars", name)
        assert toxicity.reject(own, labels).columns == own.columns and toxicity.reject(own, labels).count() == 4


def test_repeated_ids_count_once_in_a_fit(make, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    docs = make(*[(1, "b"), (1, "a"), (1, None), (2, "c")] * 5)
    assert toxicity.sample(docs, labels, "toxic", F.lit(True), 10) == [("a", 1), ("c", 0)]


def plain_statistics(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = t.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(len(re.findall(r"[#*$%&|<>]", x)) for x in [t]), dup, len(again)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é#", " ", "\n", "\t", " ", "c*", "\n\n", "\x0b", "\x1c", "a b c "]), max_size=40).map("".join))
def test_statistics_equal_plain_counts(t):
    assert quality.statistics(t)[:5] == plain_statistics(t)


def test_rules_separate_labelled_rows(documents, labels):
    rules = quality.fit(documents, labels)
    rows = quality.digest(documents, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    kept_good = sum(r["kept"] for r in rows if r["quality"] and not r["base_failed"]) / max(1, sum(r["quality"] and not r["base_failed"] for r in rows))
    assert kept_good > 0.95 and all(not (r["base_failed"] and r["kept"]) for r in rows)
    assert all(rule for rule in rules)


def test_decision_list_finds_a_planted_rule():
    r = np.random.default_rng(0)
    x = r.random((900, len(quality.RATIOS)))
    bad = (x[:, 2] > 0.8) & (x[:, 5] < 0.5)
    rules = quality.learn(x, bad)
    said = np.zeros(900, bool)
    for rule in rules:
        said |= quality._covered(rule, x)
    assert (said == bad).mean() > 0.97
    assert quality.learn(x, np.zeros(900, bool)) == []


def test_quality_of_odd_rows(make, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id long, quality int")
    docs = make((1, None), (2, ""), (None, "w " * 60), (3, "a b c d " * 20)).withColumn("stats", F.lit(1))
    got = {r["doc_id"]: r for r in quality.digest(docs, labels).collect()}
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[2]["kept"] and got[3]["base_failed"]
    assert quality.digest(make(), labels).count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", language.START, language.START + "a", "aba"]
    order = sorted(pieces)
    r = np.random.default_rng(1)
    probs = np.vstack([r.random((len(order), 2)), [[1e-3, 1e-3]]])
    index = language.Pieces(order)
    for word in ("a", "ab", "abab", "abaxb", "ab" * 40):
        full = language.START + word
        codes = np.array([[ord(c) for c in full]], np.uint64)
        got = language.forward(index.find(codes), probs, len(full))[0]
        if len(word) < 6:
            want = np.zeros(2)
            for cuts in itertools.product([0, 1], repeat=len(full) - 1):
                at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(full)]
                parts = [full[a:b] for a, b in itertools.pairwise(at)]
                if all(p in order or len(p) == 1 for p in parts):
                    want += np.prod([probs[order.index(p)] if p in order else probs[-1] for p in parts], axis=0)
            assert got == pytest.approx(np.log(want))
        assert np.isfinite(got).all()


def test_languages_on_held_out_rows(documents):
    rows = language.digest(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_rows(make):
    docs = make((1, "the house and the dog", "en"), (2, "la maison et le chien", "fr"), (3, None, "en"), (4, "123 ², ...", "fr"), (None, "x" * 3000, None), (5, "the dog", None), (5, "the dog", None))
    got = {(r["doc_id"], r["lang_pred"]) for r in language.predict(docs.withColumn("score", F.lit("x")), language.fit(docs, F.lit(True))).collect()}
    for name in ("_language", "_own0", "_id"):
        own = docs.withColumnRenamed("n_chars", name)
        assert language.predict(own, language.fit(own, F.lit(True))).columns == [*own.columns, "lang_pred", "score"]
    assert {(3, "und"), (4, "und")} <= got and (5, "en") in got
    assert {r["lang_pred"] for r in language.digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.digest(make()).count() == 0 and math.isfinite(1)
