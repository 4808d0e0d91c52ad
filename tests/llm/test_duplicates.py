"""Near-copies, contaminated documents and repeated passages against brute force; hot groups; odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from quillmesh.llm import decontaminate, graphs, near_dups, substrings


def shingle_sets(rows, width):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    return out


def brute_components(rows, width=4, percent=80):
    sets = shingle_sets(rows, width)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def words(r, n):
    return [r.choice("abcdefghij") + r.choice("klmnop") + str(r.randint(0, 99)) for _ in range(n)]


def family(r, start, size, n=120, edits=2):
    """A text and copies with a few words replaced, and a chain in which each differs from the one before."""
    base = words(r, n)
    out = [(start, " ".join(base))]
    for k in range(1, size):
        if k % 2:
            base = list(base)
        w = list(base)
        for _ in range(edits):
            w[r.randrange(n)] = "edit" + str(r.randint(0, 9999))
        if k % 2:
            base = w
        out.append((start + k, " ".join(w)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(make, seed):
    r = random.Random(seed)
    rows = family(r, 0, 25) + family(r, 100, 12, n=40, edits=1) + [(200 + i, " ".join(words(r, 60))) for i in range(20)]
    rows += [(300, rows[3][1].upper()), (301, rows[3][1]), (302, "a b c"), (303, " A  b\tC "), (304, "a b"), (305, None), (306, "")] + family(r, 400, 10, n=9, edits=1)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dups.digest(make(*rows)).collect()}
    assert got == brute_components(rows)


def test_a_hot_group_hangs_together(make):
    r = random.Random(7)
    base = words(r, 200)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(4):
            w[r.randrange(200)] = f"e{r.randint(0, 99999)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[0][1]) for i in range(100)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dups.digest(make(*rows)).collect()}
    assert got == brute_components(rows)


def test_near_dups_of_odd_rows(make):
    docs = make((None, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e f"), (3, "other words in this one here"), (3, "a b c d e f"), (5, None))
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dups.digest(docs).collect()]
    assert collections.Counter(got) == collections.Counter([(None, None, True), (2, 2, True), (3, 2, False), (3, 2, False), (3, 2, False), (5, 5, True)])
    kept = near_dups.keep_first(docs.withColumnRenamed("n_chars", "rep"))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "5", "None"] and "rep" in kept.columns
    assert near_dups.digest(make()).count() == 0 and near_dups.digest(make((1, None))).count() == 1


@pytest.mark.parametrize("n", [300, 2000, 40_000])
def test_estimate_is_corrected(n):
    r = np.random.default_rng(0)
    for j in (0.0, 0.5, 0.8, 0.95):
        both = r.integers(0, 2**64, int(2 * n * j / (1 + j)), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, r.integers(0, 2**64, n - len(both), dtype=np.uint64)])) for _ in range(2))
        got, filled = near_dups.estimate(near_dups.registers(a), near_dups.registers(b), len(a), len(b), near_dups.Collisions())
        assert got == pytest.approx(j, abs=0.13) and (filled == near_dups.REGISTERS or n == 300)


def missed(n, bands):
    """Chance that sets at 0.8, the larger of n shingles, have no band with shingles in common and none that differs."""
    worst = 0.0
    for both in range(1, n + 1):
        for apart in (n - both, 2 * (n - both)):  # one set holds the other, or each has as many of its own
            if apart and both >= 0.8 * (both + apart) - 1e-9 and (both - 1) < 0.8 * (both + apart):
                p = np.eye(1, bands + 1)[0]  # of so many bands spoiled
                for _ in range(apart):
                    p = p * np.arange(bands + 1) / bands + np.concatenate([[0], p[:-1] * (bands - np.arange(bands)) / bands])
                worst = max(worst, float((p * (np.arange(bands + 1) / bands) ** both).sum()))
    return worst


def test_pairs_at_the_threshold_miss_all_bands_with_a_chance_below_3e_6():
    """Exact up to 150 shingles. Beyond, a bucket holds several, and the bands that agree are counted in 200 trials: they
    vary less than independent ones, whose chance of none is the bound."""
    sizes = [a for a, _ in near_dups.BANDS] + [10**9]
    for (a, bands), b in zip(near_dups.BANDS, sizes[1:], strict=True):
        assert near_dups.REGISTERS % bands == 0 and max([missed(n, bands) for n in range(a, min(b, 150))], default=0) < 3e-6
    r = np.random.default_rng(0)
    for n in (175, 254, 600):
        bands, agree = near_dups.BANDS[near_dups.bandings(n, 0.8)[0]][1], []
        for _ in range(200):
            both = r.integers(0, 2**64, n - n // 9, dtype=np.uint64)
            a, b = (near_dups.registers(np.unique(np.concatenate([both, r.integers(0, 2**64, n // 9, dtype=np.uint64)]))).reshape(bands, -1) for _ in "ab")
            agree.append(int(((a == b).all(1) & a.any(1)).sum()))
        mean = np.mean(agree)
        assert np.var(agree) < mean * (1 - mean / bands) and (1 - mean / bands) ** bands < 6e-6


@pytest.mark.parametrize("n", [5, 6, 7, 11, 12, 25, 26, 42, 43, 61, 62, 87, 88, 140, 160, 1000])
def test_sets_at_the_threshold_share_a_band(n):
    """Every pair of sets with as many differing shingles as 0.8 allows, of 300 tried, meets in a bucket."""
    r = np.random.default_rng(n)
    for k in range(300):
        more = k % 2 * (n // 4)  # one set holds the other, or both have shingles of their own
        only = 0 if more else int(n / 9)
        both = r.integers(0, 2**64, n - only, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, r.integers(0, 2**64, x, dtype=np.uint64)])) for x in (only, only + more))
        keys = []
        for s in (a, b):
            regs = near_dups.registers(s)
            keys.append({(i, j, row.tobytes()) for i in near_dups.bandings(len(s), 0.8) for j, row in enumerate(regs.reshape(near_dups.BANDS[i][1], -1)) if row.any()})
        assert keys[0] & keys[1], (len(a), len(b))


def test_extra_columns_may_have_any_name(make):
    docs = make((1, "a b c d e f"), (2, "a b c d e f"))
    for name in ("_id", "_own0", "rep", "set", "component_id", "_t"):
        kept = near_dups.keep_first(docs.withColumnRenamed("n_chars", name))
        assert [r["doc_id"] for r in kept.collect()] == [1] and name in kept.columns


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (5, 5)]
    got = {r["node"]: r["label"] for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    labels = graphs.merged(graphs.components(spark.createDataFrame(edges, "a long, b long")), spark.createDataFrame([(40, 129), (300, 201)], "a long, b long"))
    got = {r["node"]: r["label"] for r in labels.collect()}
    assert got[110] == 0 and got[300] == 200 and got[0] == 0


LOW = re.compile("[A-Z]")


def brute_hits(docs, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", LOW.sub(lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = find(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[a : a + k])].add(i)
    out = {}
    for d, t in docs:
        w, hit, own = find(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if got := windows.get(tuple(w[a : a + k])):
                    hit.update(range(a, a + k))
                    own |= got
        ids = sorted(str(x) for x in own if x is not None)
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize(("most_keys", "most_rows"), [(3, 3), (50_000, 50_000)])
def test_contamination_equals_brute_force(make, spark, most_keys, most_rows, monkeypatch):
    r = random.Random(3)
    item = [" ".join(r.choice(["the", "of", "Alpha", "İx", "beta9", "éa", "K"]) + r.choice(["", "", str(r.randint(0, 30))]) for _ in range(n)) for n in (30, 12, 10, 4, 1, 11, 25)]
    items = list(enumerate(item)) + [(7, None), (8, "... !!"), (None, "zeta " * 10), (9, item[1])]
    docs = [(0, None), (1, ""), (2, item[0].upper()), (3, "x, " + item[0].replace(" ", " - ") + "! y"), (4, " ".join(item[0].split()[5:20])), (5, " ".join(item[0].split()[:9])), (6, item[3] + " " + item[3]), (7, "zeta " * 30), (8, " ".join(item[1].split()[1:] + item[1].split()[:1]))]
    docs += [(20 + i, " ".join(r.choice(item).split()[r.randint(0, 5) :] * 2)) for i in range(25)]
    monkeypatch.setattr(decontaminate.hits, "__defaults__", (decontaminate.WIDTH, most_keys, most_rows))
    got = {x["doc_id"]: (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) for x in decontaminate.digest(make(*docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_hits(docs, items)


def test_contamination_of_odd_rows(make, spark):
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    docs = make((None, "One, two three four."), (2, "clean"), (2, "one two three four"), (2, "clean")).withColumnRenamed("n_chars", "spans")
    got = collections.Counter((r["doc_id"], r["contaminated"]) for r in decontaminate.digest(docs, items).collect())
    assert got == {(None, True): 1, (2, False): 2, (2, True): 1}
    left = decontaminate.remove(docs, items)
    assert left.columns == docs.columns and [r["text"] for r in left.collect()] == ["clean", "clean"]
    for name in ("_id", "_t", "_h", "_id0", "_TEXT0"):
        own = docs.withColumnRenamed("spans", name)
        assert decontaminate.remove(own, items).columns == own.columns and decontaminate.remove(own, items).count() == 2
    assert decontaminate.digest(docs, items.limit(0)).where("contaminated").count() == 0 and decontaminate.digest(make(), items).count() == 0


def test_contamination_of_long_items_and_hot_shingles(make, spark):
    r = random.Random(8)
    long = words(r, 20_000)
    items = [(1, " ".join(long)), (2, "hot cold " * 5_000)] + [(100 + i, f"hot cold hot cold hot cold hot cold hot end{i % 50}") for i in range(2_000)]
    docs = [(1, " ".join(long[5_000:9_000])), (2, "x hot cold hot cold hot cold hot cold hot end7 y"), (3, "hot cold " * 300), (4, " ".join(words(r, 3_000))), (5, " ".join(long[:9]))]
    got = {x["doc_id"]: (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) for x in decontaminate.digest(make(*docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_hits(docs, items)


def test_units_cover_the_words_of_a_text():
    t = "One line.\n\nA very long line that has many words in it so it is cut. Second part of it here! Third\n  \nlast"
    got = list(substrings.units(t))
    assert [t[s:e].strip() for s, e, _, _ in got] == ["One line.", "A very long line that has many words in it so it is cut.", "Second part of it here!", "Third", "last"]
    assert [w.decode() for u in got for w in u[2]] == re.findall(r"\w+", t.lower())


def brute_first(rows):
    """Every unit of the result that has been seen earlier in rank must be gone, and nothing else."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        gone = []
        for k, (_, _, w, ok) in enumerate(substrings.units(t or "")):
            if ok:
                if tuple(w) in seen:
                    gone.append(k)
                seen.add(tuple(w))
        out[i] = gone
    return out


def test_repeats_go_and_first_ones_stay(make):
    r = random.Random(5)
    line = [" ".join(words(r, n)) + "." for n in (5, 8, 20, 30, 60)]
    passage = " ".join(" ".join(words(r, 11)).capitalize() + "." for _ in range(6))
    rows = [(9, f"{line[0]}\n{line[2]}\n{line[0]}"), (3, f"{line[2]}\nown {line[1]}"), (5, f"{' '.join(words(r, 14))} {passage} {' '.join(words(r, 9))}."), (7, f"{' '.join(words(r, 20))} {passage} {' '.join(words(r, 6))}."), (8, "ab cd"), (4, "ab cd"), (1, None), (2, "")]
    rows += [(20 + i, " \t".join(line[3].upper().split(" ")) + f"\nown{i} text {i}") for i in range(30)]
    got = {x["doc_id"]: x for x in substrings.digest(make(*rows)).collect()}
    want, texts = brute_first(rows), dict(rows)
    assert len(got) == len(rows)
    for i, x in got.items():
        assert x["n_removed"] == len(want[i])
        t = texts[i]
        kept, at = "", 0
        for s in x["removed"]:
            kept += t[at : s["start"]]
            at = s["end"]
        assert x["text"] == (None if t is None else kept + t[at:])
        if not want[i]:
            assert x["text"] == t
    cut = got[7]["removed"][0]
    assert texts[7][cut["start"] : cut["end"]].strip() == passage and texts[5] == got[5]["text"]  # its ragged ends too


def test_repeats_of_odd_rows(make):
    docs = make((4, "the same line of words"), (4, "the same line of words"), (None, "the same line of words"), (6, "x\n" * 5)).withColumnRenamed("n_chars", "idx")
    got = collections.Counter((r["doc_id"], r["text"]) for r in substrings.digest(docs).collect())
    assert got == {(4, "the same line of words"): 2, (None, ""): 1, (6, "x\n" * 5): 1}
    assert substrings.digest(make()).count() == 0
    nameless = make((None, "one line of some words"), (None, "one line of some words"), (None, None), (2**63 - 1, "one line of some words"))
    assert sorted(str(r["text"]) for r in substrings.digest(nameless).collect()) == ["", "", "None", "one line of some words"]
    assert sorted(r["text"] for r in substrings.digest(nameless.where("doc_id is null and text is not null")).collect()) == ["", "one line of some words"]


def plain_units(text):
    """Words of each unit with their places, by expressions of their own."""
    out, at = [], 0
    for line in text.split("\n"):
        parts = [line]
        if len(line) > 80:
            parts = [p for s in re.findall(r"(?:.*?[.!?][\"')\]]*\s+|.+$)", line) for p in (re.findall(r"(?:.*?[,;:]\s+|.+$)", s) if len(s) > 160 else [s])]
        a = at
        for p in parts:
            found = [(m[0], a + m.start(), a + m.end()) for m in re.finditer("[0-9a-z\x80-\U0010ffff]+", p.lower())]
            if found:
                out.append((found, a, a + len(p), len(found) >= (5 if len(line) > 80 else 3)))
            a += len(p)
        at += len(line) + 1
    return out


def plain_dedup(rows):
    """Texts without later occurrences and the words that equal those beside the first one: each unit by itself."""
    all_units = {i: plain_units(t) for i, t in rows}
    words = {i: [w for u in us for w in u[0]] for i, us in all_units.items()}
    first, out = {}, {}
    for i, t in sorted(rows):
        gone, n = [], 0
        for k, (own, a, b, ok) in enumerate(all_units[i]):
            at = sum(len(u[0]) for u in all_units[i][:k])
            key = tuple(w for w, _, _ in own)
            if not ok or first.setdefault(key, (i, at)) == (i, at):
                continue
            n += 1
            j, other = first[key]
            left, right = 0, 0
            while min(at, other) - left > 0 and words[i][at - left - 1][0] == words[j][other - left - 1][0]:
                left += 1
            x, y = at + len(own), other + len(own)
            while x + right < len(words[i]) and y + right < len(words[j]) and words[i][x + right][0] == words[j][y + right][0]:
                right += 1
            gone += [(a, b), *([(words[i][at - left][1], b)] if left else []), *([(a, words[i][x + right - 1][2])] if right else [])]
        out[i] = ("".join(c for p, c in enumerate(t) if not any(a <= p < b for a, b in gone)), n)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_whole_result_equals_brute_force(make, seed):
    r = random.Random(seed)
    bits = [" ".join(words(r, r.randint(1, 14))) + r.choice([". ", "! ", ", ", "; ", " ", "\n", ".\n"]) for _ in range(14)]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for i in range(40)]
    got = {x["doc_id"]: (x["text"], x["n_removed"]) for x in substrings.digest(make(*rows)).collect()}
    assert got == plain_dedup(rows)


@pytest.mark.parametrize("n", [13, 16, 30, 200])
def test_edges_go_on_to_the_first_word_that_differs(make, n):
    r = random.Random(n)
    before, after = " ".join(words(r, n)), " ".join(words(r, n))
    passage = f"{before}. {' '.join(words(r, 11))}. {' '.join(words(r, 11))}. {after}"
    rows = [(i, f"only{i} {passage} mere{i} {' '.join(words(r, 9))}.") for i in range(3)]
    got = {x["doc_id"]: x["text"] for x in substrings.digest(make(*rows)).collect()}
    assert got[0] == rows[0][1]
    for i, t in rows[1:]:
        assert got[i] == t.replace(passage, "")


def test_edges_compare_words_not_short_hashes(make):
    import xxhash

    seen, i = {}, 0
    while (other := seen.setdefault(xxhash.xxh32_digest(f"w{i}")[:2], f"w{i}")) == f"w{i}":
        i += 1
    line = "this line stands in both of the documents"
    rows = [(1, f"{other}\n{line}\n{other}"), (2, f"w{i}\n{line}\nw{i}")]
    got = {x["doc_id"]: x["text"].split() for x in substrings.digest(make(*rows)).collect()}
    assert got == {1: rows[0][1].split(), 2: [f"w{i}"] * 2}
