"""Personal data and secrets: base patterns against the plain expressions, planted cases, odd texts."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import crf, pii, secrets, spans


def plain_pii(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def plain_secrets(t):
    word = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    out = [("assign", m.start(), m.end()) for m in re.finditer(word + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[1]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return out + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]


PIECES = ["a@b.c", "@", "x.y+z@m-n.o.p", "1.2.3.4", ".", "999.1.2.3", "4539 1488 0343 6467", "4539148803436467", "-", " ", "+1 (555) 010-9999", "+", "12", "é", "\n", "@@a.b", "0001.02.3.4.5"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_base_pii_equals_the_plain_expressions(t):
    assert sorted(pii.base_spans(t)) == sorted(plain_pii(t))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["Token", "api_key", "APIKEY", "=", ": ", '"', "secret", "abcdefgh1", "AKIA", "AKIAABCDEFGH1234", "0a1b" * 8, "f" * 31, "g", " ", "ſecret", "K"]), max_size=12).map("".join))
def test_base_secrets_equal_the_plain_expressions(t):
    assert sorted(secrets.base_spans(t)) == sorted(plain_secrets(t))


def test_long_texts_take_linear_time():
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 100_000, "token=" * 50_000, "f" * 300_000, "@" * 200_000):
        pii.base_spans(t)
        secrets.base_spans(t)


def test_fields_find_what_patterns_miss():
    tagger = crf.Tagger(pii.fit(), pii.features)
    t = "please call me on (487) 555-7209 today, card 4485275742308327."
    found = {(k, t[s:e]) for k, s, e in pii.tagged_spans([t], tagger)[0]}
    assert ("phone", "(487) 555-7209") in found and ("card", "4485275742308327") in found
    clean = ["and so on 12 of 40 pages in 1999, see version 2.0. and 4.0", "the number 1234567890123456 is not one", ""]
    assert pii.tagged_spans(clean, tagger) == [[], [], []]
    tagger = crf.Tagger(secrets.fit(), secrets.features)
    t = "use ghp_A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6Q7r8 for it"
    assert [t[s:e] for s, e in secrets.tagged_spans([t], tagger)[0]] == ["ghp_A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6Q7r8"]
    assert secrets.tagged_spans(["only 12 words in 1999, see https://a.com/b/123 and a_b"], tagger) == [[]]


def test_letters_after_a_cue_are_decoded():
    tagger = crf.Tagger(secrets.fit(), secrets.features)
    cut = lambda t: [t[s:e] for s, e in secrets.tagged_spans([t], tagger)[0]]
    assert cut("my password AbcdEfghKlMn is here") == ["AbcdEfghKlMn"] and cut("authorization bearer kQwErTzUiOpAsDf now") == ["kQwErTzUiOpAsDf"]
    for plain in ("the secret gardens of the town", "a token gesture towards Reconciliation", "the key elements are", "password protected files", "The Secret Garden opened in JavaScript and iPhone"):
        assert cut(plain) == [], plain


def test_every_token_of_a_text_is_decoded(documents, monkeypatch):
    """Labels of secrets' field against one Viterbi run over all tokens of a text, in one block and in many."""
    tagger = crf.Tagger(secrets.fit(), secrets.features)
    key = "QKZJXWVBNMASDFGHJKLQWERTYUIOPZXCVBNMLKJH"
    assert [secrets.tagged_spans([t], tagger)[0] for t in (f"use {key} for it", key)] == [[(4, 44)], [(0, 40)]]
    mixed = ["ghp_A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6Q7r8", key, "password", "AbcdEfghKl", "The", "=", "!!", "12", "https://www.example.org/some/path", "é", "JavaScript"]
    texts = [" ".join(mixed[(i * j + i) % len(mixed)] for j in range(i)) for i in range(40)] + [key + " " + (key + ",\n") * 30]
    texts += [r["text"] or "" for r in documents.orderBy("doc_id").limit(60).collect()]
    docs = [tagger.model.document(secrets.file_features(t)) for t in texts]
    want = []
    for t, doc in zip(texts, docs, strict=True):
        found = list(secrets.TOKEN.finditer(t))
        tags = tagger.decode([(None, [m[0] for m in found], None, doc)])[0] if found else []
        want.append([(x, *m.span()) for x, m in zip(tags, found, strict=True) if x != "O"])
    assert tagger.label(texts, secrets.TOKEN, docs) == want and sum(map(len, want)) > 60
    monkeypatch.setattr(crf, "PIECE", 50)
    monkeypatch.setattr(crf, "KNOWN", 20)
    assert tagger.label(texts, secrets.TOKEN, docs) == want


def test_plain_words_stay_plain():
    tagger = crf.Tagger(secrets.fit(), secrets.features)
    for t in ("THE END!! OF THIS, AND MORE", "Datenschutzgrundverordnung gilt. Ein Wort", "see https://www.example.org/some/path/index.html now", "Une élève. Immédiatement après", "write to jane.doe@mail.example.com"):
        assert secrets.tagged_spans([t], tagger) == [[]], t
    found = wrong = 0
    for tokens, _, doc in secrets.plain_table(300, 99):
        wrong += sum(x != "O" for x in tagger.decode([(None, tokens, None, tagger.model.document(doc))])[0])
        found += len(tokens)
    assert wrong < found / 200


def test_fields_are_accurate_on_rows_they_have_not_seen():
    """Spans of a labelled table of another seed: found and not found, token by token."""
    for operator in (pii, secrets):
        tagger = crf.Tagger(operator.fit(), operator.features)
        right = wrong = missed = 0
        for row in operator.labelled_table(300, 99):
            zero = tagger.model.document(row[2] if len(row) > 2 else [])
            got = tagger.decode([(None, row[0], None, zero)])[0]
            right += sum(a == b != "O" for a, b in zip(got, row[1], strict=True))
            wrong += sum(a != b and a != "O" for a, b in zip(got, row[1], strict=True))
            missed += sum(a != b and b != "O" for a, b in zip(got, row[1], strict=True))
        assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.9, (operator.__name__, right, wrong, missed)


def test_free_spans_by_trying_all():
    import random

    r = random.Random(2)
    for _ in range(200):
        found, taken = ([(a := r.randint(0, 40), a + r.randint(1, 5)) for _ in range(r.randint(0, 6))] for _ in "ab")
        want = [x for x in sorted(found, key=lambda x: x[0]) if all(x[1] <= a or b <= x[0] for a, b in taken)]
        assert spans.free(found, taken) == want


def test_very_long_texts_through_the_fields(make):
    t = ("word 12 " * 40_000) + "call (487) 555-7209 now, key ghp_A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6Q7r8"
    for operator in (pii, secrets):
        got = operator.find(make((1, t), (1, t))).collect()
        assert len(got) == 2 and got[0]["spans"] == got[1]["spans"] and got[0]["spans"]


def test_viterbi_equals_trying_all_paths():
    import itertools

    import numpy as np

    r = np.random.default_rng(3)
    labels = ["O", "B-x", "I-x"]
    mask, start = crf.allowed(labels)
    model = crf.Crf(labels, trans=mask + r.normal(size=(3, 3)), start=start + r.normal(size=3))
    e = r.normal(size=(5, 6, 3))
    lengths = np.array([6, 5, 3, 1, 2])
    got = crf.viterbi(model, e, lengths)
    for s in range(5):
        n = lengths[s]
        worth = lambda p: model.start[p[0]] + sum(e[s, t, p[t]] for t in range(n)) + sum(model.trans[p[t], p[t + 1]] for t in range(n - 1))  # noqa: E731, B023
        assert tuple(got[s, :n]) == max(itertools.product(range(3), repeat=int(n)), key=worth)


@pytest.mark.parametrize(("operator", "plain", "kinds"), [(pii, plain_pii, pii.KINDS), (secrets, plain_secrets, secrets.KINDS)])
def test_digest_of_whole_tables(documents, operator, plain, kinds):
    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    rank = {k: i for i, k in enumerate(kinds)}
    for r in operator.digest(documents).collect():
        own = sorted(plain(texts[r["doc_id"]]), key=lambda x: (x[1], rank[x[0]]))
        line = [":".join(map(str, x)) for x in own]
        assert r["base_sha256"] == hashlib.sha256(",".join(line).encode()).hexdigest() and set(line) <= set(r["spans"].split(",") if r["spans"] else [])
        assert all(r[f"n_{k}"] == sum(x[0] == k for x in own) for k in kinds if k != "secret")


@pytest.mark.parametrize("operator", [pii, secrets])
def test_odd_rows(make, spark, operator):
    docs = make((1, None), (None, "x@y.z token=abcdefgh12"), (2, ""), (2, "")).withColumnRenamed("n_chars", "spans")
    got = operator.find(docs).collect()
    assert [r["spans"] for r in got if r["text"] in (None, "")] == [[], [], []] and len(got) == 4
    assert operator.find(make()).count() == 0


def test_redaction(make):
    docs = make((1, 'a token = "abcdefgh12" b'), (2, "clean text"), (3, None), (4, "é " + "0a" * 20 + " end"))
    got = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert got == {1: f'a {secrets.MARK}" b', 2: "clean text", 3: None, 4: f"é {secrets.MARK} end"}
    assert secrets.redact(docs).columns == docs.columns
    assert spans.cut_out("abcdef", [(1, 3), (2, 4)], "-") == "a-ef"
