import numpy as np
import pytest

from quillmesh.llm import mixing, token_counts


def test_histogram_answers_every_limit(spark, documents):
    enc = token_counts.encoder()
    n = sorted(len(enc.encode_ordinary(r["text"] or "")) for r in documents.select("text").collect())
    sums = token_counts.suffix_sums(token_counts.histogram(documents), block=64).cache()
    rows = {r["length"]: r for r in sums.collect()}
    assert rows.keys() == set(n)
    for length, r in rows.items():
        assert r["n_docs"] == n.count(length) and r["docs_at_least"] == sum(x >= length for x in n) and r["tokens_at_least"] == sum(x for x in n if x >= length)
        assert r["truncated_total"] == sum(min(x, length) for x in n) and r["total_docs"] == len(n) and r["total_tokens"] == sum(n)
    got = {r["context"]: (r["docs_longer"], r["truncated_total"]) for r in token_counts.at_limits(sums, spark.createDataFrame([(0,), (100,), (777,), (10**7,)], "context long")).collect()}
    assert got == {c: (sum(x > c for x in n), sum(min(x, c) for x in n)) for c in (0, 100, 777, 10**7)}
    for share in (0.1, 0.5, 0.9, 1.0):
        assert token_counts.quantile(sums, share).first()["length"] == n[int(np.ceil(share * len(n))) - 1]


def test_histogram_of_odd_texts(make, spark):
    got = {r["length"]: r["n_docs"] for r in token_counts.digest(make((1, None), (1, None), (2, ""), (3, "<|endoftext|>"), (4, "x" * 50_000))).collect()}
    assert got[0] == 3 and sum(got.values()) == 5
    assert token_counts.digest(make()).count() == 0


def test_targets_share_the_excess():
    got = mixing.targets([("b", 10), ("a", 100), (None, 1), ("c", 1000)])
    # weights: a 1, b 2, c 3, null 1; b and null are full at three times their size
    assert got["b"] == 30 and got[None] == 3 and sum(got.values()) == pytest.approx(1111)
    assert got["c"] == pytest.approx(3 * got["a"])
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    p = mixing.permute(np.arange(n), n, 5)
    assert sorted(p.tolist()) == list(range(n)) and (n < 10 or p.tolist() != list(range(n)))


def test_shards_draw_exact_totals():
    totals = np.array([500, 30, 0, 1470])
    got = [mixing.shard_counts(totals, s, 100, 3) for s in range(20)]
    assert (sum(c for c, _ in got) == totals).all() and all(c.sum() == 100 for c, _ in got)
    at = np.zeros_like(totals)
    for c, before in got:
        assert (before == at).all()
        at = at + c


def test_mix_takes_what_it_plans(documents):
    t = {r["doc_id"]: r for r in mixing.digest(documents).collect()}
    again = {r["doc_id"]: r for r in mixing.digest(documents.repartition(3)).collect()}
    assert t == again and len(t) == documents.count()
    per: dict = {}
    for r in documents.select("doc_id", "source", "text").collect():
        x = t[r["doc_id"]]
        assert x["size"] == len([w for w in r["text"].replace("\t", " ").replace("\n", " ").split(" ") if w]) and x["taken"] <= 3 * x["size"]
        s = per.setdefault(r["source"], [0, 0, x["target"], x["source_size"]])
        s[0] += x["taken"]
        s[1] += x["size"]
    assert all(size == source_size and abs(taken - target) <= 1.5 * mixing.BLOCK for taken, size, target, source_size in per.values())


def test_blocks_hold_the_words_of_their_documents(make):
    docs = make((1, "a b c d e", "en", "x"), (2, " f\tg ", "en", "x"), (3, None, "en", "x"), (4, "h i j", "en", None), (4, "h i j", "en", None), (None, "k l", "en", "y"))
    m = mixing.mix(docs, block=2, shard_slots=3).collect()
    words = [w for r in m for w in r["text"].split()]
    taken = {(r["doc_id"], r["size"]): 0 for r in mixing.taken(docs, 2, 3).collect()}
    for r in mixing.taken(docs, 2, 3).collect():
        taken[r["doc_id"], r["size"]] += r["taken"]
    count = lambda letters: sum(w in letters for w in words)
    assert taken[1, 5] == count("abcde") and taken[2, 2] == count("fg") and taken[4, 3] == count("hij") and taken[None, 2] == count("kl") and taken[3, 0] == 0
    assert all(len(r["text"].split()) == r["n_words"] <= 2 for r in m)
    assert mixing.mix(make()).count() == 0 and mixing.digest(make()).count() == 0


def test_blocks_laid_end_to_end_are_the_texts(make):
    texts = ["  one\n\n\ttwo three  four\r\n", "x", "a\x0bb é\u2003ü  ", "   ", "", "w " * 700]
    docs = make(*((i, t, "en", "s") for i, t in enumerate(texts)), (None, "null id", "en", "s"), (None, "null id", "en", "s"), (None, "other", "en", "s")).withColumnRenamed("n_chars", "offset")
    m = mixing.mix(docs, block=3, shard_slots=5)
    blocks = {r["block"]: r["text"] for r in m.collect()}
    at, _ = mixing.placed(docs)
    order = [r["doc_id"] for r in at.where("size > 0").orderBy("offset").collect()]
    whole = "".join(blocks[b] for b in range(len(blocks)))
    left = whole
    for i in order:
        t = next(t for t in ([texts[i]] if i is not None else ["null id", "other"]) if left.startswith(t + mixing.BETWEEN))
        left = left[len(t) + 1 :]
    assert left == "" and len(order) == 7


def test_null_and_equal_ids_are_spread(spark):
    docs = spark.range(3000).selectExpr("cast(null as long) as doc_id", "concat('text of ', id) as text", "'s' as source")
    at, sizes = mixing.placed(docs)
    rows = at.collect()
    assert sorted(r["offset"] for r in rows) == list(range(0, 9000, 3)) and sizes.first()["source_size"] == 9000
    ranges = docs.selectExpr("shiftrightunsigned(xxhash64(doc_id, xxhash64(text)), 56) as r").groupBy("r").count()
    assert ranges.agg({"count": "max"}).first()[0] < 60


@pytest.mark.parametrize(("good", "bad", "n"), [(3 * 10**9, 10**10, 10**9), (5, 2 * 10**9, 10**9), (2 * 10**9, 0, 7), (10**10, 3, 10**10)])
def test_large_draws_follow_their_law(good, bad, n):
    draw = np.random.default_rng(1)
    got = np.array([mixing._hypergeometric(draw, good, bad, n) for _ in range(60)], float)
    mean, total = n * good / (good + bad), good + bad
    sd = (n * (good / total) * (bad / total) * (total - n) / (total - 1)) ** 0.5
    assert ((got >= max(0, n - bad)) & (got <= min(good, n))).all() and abs(got.mean() - mean) <= 5 * sd / 60**0.5 + 1e-9
    assert sd < 1 or 0.6 < got.std() / sd < 1.5


def test_taken_equals_a_plain_mix(make):
    """The whole result of a small mix, laid out again in plain Python from the placed texts and the drawn slots."""
    r = np.random.default_rng(4)
    docs = make(*((i, " ".join(f"w{i}_{k}" for k in range(r.integers(0, 40))), "en", "abc"[i % 3] if i % 7 else None) for i in range(60)))
    at, per = mixing.placed(docs)
    plan = mixing.plan(per, block=8)
    words = {p["source"]: [] for p in plan}
    for x in at.orderBy("offset").collect():
        assert len(words[x["source"]]) == x["offset"]
        words[x["source"]] += [x["doc_id"]] * x["size"]
    taken = dict.fromkeys(range(60), 0)
    for x in mixing.slots(docs.sparkSession, plan, 16).collect():
        for i in words[plan[x["_n"]]["source"]][8 * x["block"] : 8 * x["block"] + 8]:
            taken[i] += 1
    assert {x["doc_id"]: x["taken"] for x in mixing.taken(docs, 8, 16).collect()} == taken


def test_token_counts_pass_other_columns(make):
    docs = make((1, "a b"), (2, None)).withColumnRenamed("n_chars", "length").withColumnRenamed("lang", "n_docs")
    got = token_counts.with_length(docs)
    assert got.columns == [*docs.columns, "n_tokens"] and token_counts.digest(docs).count() == 2
