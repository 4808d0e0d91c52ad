"""Order-dependent and literal cases of the operators; sums and joins are checked against SQL in test_queries."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.operators import bm25, chunking, evaluation, fusion, graph, names, ranking, validation, vectors


def lists(spark, rows):
    return spark.createDataFrame(rows, "qid int, list_id string, row_id int, score double, rnk int")


def test_fusions(spark):
    x = lists(spark, [(1, "a", 10, 9.0, 1), (1, "a", 11, 1.0, 2), (1, "b", 11, 5.0, 1), (1, "b", 12, 5.0, 2)])
    rrf = {r["row_id"]: r["score"] for r in fusion.rrf(x).collect()}
    assert rrf[11] == pytest.approx(1 / 62 + 1 / 61)
    mnz = {r["row_id"]: r["score"] for r in fusion.combmnz(x).collect()}
    assert mnz == {10: 1.0, 11: 2.0, 12: 1.0}  # a list of one value scales to 1
    assert [r["row_id"] for r in fusion.fuse(x).orderBy("rnk").collect()] == [11, 10, 12]
    scaled = x.withColumn("score", x.score * 3 + 1)
    assert {r["row_id"]: r["score"] for r in fusion.rrf(scaled).collect()} == rrf
    with pytest.raises(ValueError):
        fusion.fuse(x, "other")


def test_top_k_in_blocks_is_exact(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(200, 8)).tolist()
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "row_id long, v array<double>").repartition(5)
    q = spark.createDataFrame([(i, x) for i, x in enumerate(v[:7])], "qid long, v array<double>")
    got = {(x["qid"], x["rnk"]): x["row_id"] for x in vectors.top_k(q, rows, 4, block=3).collect()}
    s = np.array(v[:7]) @ np.array(v).T
    assert got == {(i, k + 1): j for i in range(7) for k, j in enumerate(np.argsort(-s[i], kind="stable")[:4].tolist())}
    assert vectors.top_k(q.limit(0), rows, 4).count() == 0


def test_similar_pairs_in_blocks(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(60, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row_id long, v array<double>")
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if v[i] @ v[j] > 0.7}
    assert {(x["a"], x["b"]) for x in vectors.similar_pairs(rows, 0.7, block=13).collect()} == want


def test_upsert_flags_a_turned_vector(spark):
    old = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "row_id int, v array<double>")
    new = spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.0, -1.0])], "row_id int, v array<double>")
    got = {r["row_id"]: (r["changed"], r["suspicious"]) for r in vectors.upsert(old, new).collect()}
    assert got == {1: (True, False), 2: (True, True), 3: (False, False)}


def near(cosine):
    return [cosine, (1 - cosine**2) ** 0.5]


def test_copies_and_translations(spark):
    docs = spark.createDataFrame([(1, d, s) for d, s in (("a", 9.0), ("b", 8.0), ("c", 7.0), ("d", 6.0), ("e", 5.0))], "qid int, doc string, score double")
    v = spark.createDataFrame([("a", "m", [1.0, 0.0]), ("b", "m", near(0.99)), ("c", "m", near(0.96)), ("d", "m", near(0.96)), ("e", "m", [0.0, 1.0])], "doc string, slug string, v array<double>")
    lang = spark.createDataFrame([("a", "es"), ("b", "es"), ("c", "pt"), ("d", "es"), ("e", "es")], "doc string, lang string")
    pick = lambda **o: [r["doc"] for r in ranking.without_copies(docs, v, lang, **o).orderBy("rnk").collect()]
    assert pick() == ["a", "d", "e"]  # b is a copy, c a translation, d a later edition
    assert pick(n=5) == ["a", "d", "e", "b", "c"]  # what was passed over fills the list
    assert pick(copy=1.0) == ["a", "b", "c"]


def test_diverse_selection(spark):
    text = "one two three four five six seven eight nine ten"
    rows = spark.createDataFrame([(1, "a", text), (2, "b", text + " eleven"), (3, "a", "x y z w"), (4, "a", "p q r s"), (5, "a", "k l m n"), (6, "c", "u v w x y")], "row_id int, doc string, text string")
    fused = spark.createDataFrame([(1, i, 10.0 - i, i) for i in range(1, 7)], "qid int, row_id int, score double, rnk int")
    pick = lambda n: [r["row_id"] for r in ranking.diverse(fused, rows, n).orderBy("rnk").collect()]
    assert pick(4) == [1, 3, 4, 6] and pick(6) == [1, 3, 4, 6, 2, 5]


def test_expansion_stays_within_the_target(spark):
    rows = [(i, "d", i, " ".join(f"w{i}x{k}" for k in range(59)) + " end.") for i in range(8)] + [(100, "e", 0, "alone here")]
    df = spark.createDataFrame(rows, "row_id int, doc string, pos int, text string")
    got = {r["row_id"]: r["text"] for r in ranking.expand(df.select("row_id"), df).collect()}
    assert got[100] == "alone here" and all(len(t.split()) <= 245 for t in got.values())
    assert len(got[3].split()) == 240 and got[3].startswith("w2x0") and got[3].endswith("w5x58 end.")  # next, previous, next


def test_expansion_goes_as_far_as_the_target(spark):
    r = np.random.default_rng(3)
    texts = {"short": [f"a{i} b{i} c{i}" for i in range(40)], "ones": [f"w{i}" for i in range(700)]}
    texts["mixed"] = [" ".join(f"m{i}x{k}" for k in range(r.choice([0, 0, 1, 3, 9, 300]))) for i in range(200)]
    at = {(d, 5 + i): t for d, own in texts.items() for i, t in enumerate(own) if (d, i) != ("mixed", 120)}
    df = spark.createDataFrame([(i, d, p, t) for i, ((d, p), t) in enumerate(at.items())], "row_id int, doc string, pos int, text string")

    def grown(d, p):
        total, ends, parts = len(at[d, p].split()), {1: 1, -1: 1}, [at[d, p]]
        grew = total < 245
        while grew:
            grew = False
            for side in (1, -1):
                t = at.get((d, p + side * ends[side]))
                if t is not None and total + len(t.split()) <= 245:
                    total, grew = total + len(t.split()), True
                    ends[side] += 1
                    parts = [*parts, t] if side > 0 else [t, *parts]
        return " ".join(filter(None, parts))

    got = {r["row_id"]: r["text"] for r in ranking.expand(df.select("row_id"), df).collect()}
    assert got == {i: grown(*k) for i, k in enumerate(at)}
    assert len(got[20].split()) == 120


def test_joining_drops_the_shared_sentence():
    shared = "this sentence stands in both of them."
    assert ranking.join_pieces(["First one. " + shared, shared + " Then more.", ""]) == f"First one. {shared} Then more."


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 60), min_size=1, max_size=12), min_size=1, max_size=6))
def test_chunks_never_exceed_the_limit(sizes):
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    text = "\n\n".join(" ".join(" ".join(f"w{letters(i)}q{letters(j)}x{letters(k)}" for k in range(n)).capitalize() + "." for j, n in enumerate(block)) for i, block in enumerate(sizes))
    got = chunking.chunk_text(text, fallback="spare")
    assert all(len(t.split()) <= chunking.MOST for _, t, _ in got)
    words = {w for _, t, _ in got for w in t.split()}
    if len(text.split()) >= chunking.LEAST:
        assert words == set(text.split())


def test_chunk_sections_and_noise():
    body = " ".join(["The quick animal went over the wall and came back."] * 8)
    got = chunking.chunk_text(f"1. First part\n\n{body}\n\n# Second part\n\nNow {body}\n\nA ...... 1\nB ...... 2\n\nFigura 3: x")
    assert [s for s, _, _ in got] == ["1. First part", "Second part"]
    assert chunking.blocks("One block that stays open and runs on for more than fifteen words in all so it\n\ncontinues here.")[0][1].endswith("continues here.")


def test_long_sentences_are_cut_at_clauses():
    long = "; ".join(" ".join(f"a{i}b{k}" for k in range(100)) for i in range(5))
    parts = chunking.split_long(long)
    assert all(len(p.split()) <= 240 for p in parts) and " ".join(parts).split() == long.split()
    assert len(chunking.split_long(" ".join(["w"] * 500))) == 3


def test_every_document_has_a_chunk(spark):
    docs = spark.createDataFrame([("x", None, "T", "obs"), ("y", "", None, None)], "doc_id string, text string, title string, observatory string")
    got = {r["doc_id"]: r["text"] for r in chunking.chunk(docs).collect()}
    assert got == {"x": "T. obs", "y": "Documento y del corpus."}


def test_bm25_matches_a_plain_sum(spark):
    docs = ["the cat sat", "the dog sat down", "cat and dog and cat", "bird"]
    rows = spark.createDataFrame(list(enumerate(docs)), "row_id int, text string")
    q = spark.createDataFrame([(1, "Cat dog dog")], "qid int, text string")
    got = {r["row_id"]: r["score"] for r in bm25.search(q, *bm25.index(rows)).collect()}
    import math

    toks = [d.split() for d in docs]
    df = {t: sum(t in d for d in toks) for d in toks for t in d}
    length = [sum(df[t] >= 2 for t in d) for d in toks]
    avg = sum(length) / 4
    want = {}
    for i, d in enumerate(toks):
        s = sum(math.log(1 + (4 - df[t] + 0.5) / (df[t] + 0.5)) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * length[i] / avg)) for t in ("cat", "dog") if t in d)
        if s:
            want[i] = s
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_gazetteer_takes_the_longest_and_inner_starts(spark):
    g = graph.gazetteer(spark.createDataFrame([("Estado Mayor Central", "EMC", "G", 0), ("Estado Mayor Central de las FARC", "EMC", "G", 1), ("FARC", "FARC-EP", "G", 2), ("UN", "ONU", "O", 3), ("inteligencia, vigilancia", "ISR", "T", 4)], "alias string, canonical string, type string, prio int"))
    rows = spark.createDataFrame([(1, "El Estado Mayor Central de las FÁRC dijo"), (2, "la UN"), (3, "inteligencia,  vigilancia"), (4, None)], "row_id int, text string")
    got = {(r["row_id"], r["canonical"]) for r in graph.gazetteer_hits(rows, g).collect()}
    assert got == {(1, "EMC"), (1, "FARC-EP"), (3, "ISR")}


def test_rule_names():
    got = dict(names.rule_names("Ayer el presidente Juan Manuel Pérez visitó el municipio de San José. Colombia habló. El Ministerio de Defensa dijo que XXI."))
    assert got["Juan Manuel Pérez"] == "PERSONA" and got["San José"] == "LUGAR" and got["Ministerio de Defensa"] == "ORGANIZACION"
    assert "Colombia" not in got and "XXI" not in got and not names.rule_names("ORBITAL DEBRIS CREATED BY TESTS")


def test_names_use_the_given_tables():
    lex = names.Lexicon(titles=frozenset({"captain"}), places=frozenset({"town of"}), organisations=frozenset({"harbour office"}), articles=frozenset({"the"}), links=frozenset({"of", "of the"}), stop=frozenset({"monday"}))
    t = "Today captain Ada Moss of the Isle came on Monday; near the town of Brill she saw The Harbour Office. Then Brill slept\nXIV and\nA LOUD HEADLINE OF WORDS"
    assert names.rule_names(t, lex) == [("Ada Moss of the Isle", "PERSONA"), ("Brill", "LUGAR"), ("Harbour Office", "ORGANIZACION"), ("Then Brill", "OTRO")]
    assert names.rule_names("", lex) == [] and names.rule_names("ab", lex) == []


def test_table_artefacts_are_no_names():
    import re

    for noise in ("https://a.b", "Li J. | x", "| x", "x |", "Chapter 3: y", "Jan;15(1):25", "Publication Year: 2020", "DOI : x", "Journal/Book: z"):
        assert re.search(names.TABLE_NOISE, noise), noise
    for name in ("ISO 24113:2023", "Gender Equality", "Outcome"):
        assert not re.search(names.TABLE_NOISE, name), name


def test_recognisers_and_relations_are_plugged_in(spark):
    rows = spark.createDataFrame([(1, "alpha helps beta and gamma"), (2, None), (3, "alpha beta")], "row_id int, text string")
    ents = names.recognise(rows, lambda t: [(w, "W") for w in t.split() if w in ("alpha", "beta", "gamma")] + [("x |", "N")])
    assert {(r["row_id"], r["canonical"]) for r in ents.collect()} == {(1, "alpha"), (1, "beta"), (1, "gamma"), (3, "alpha"), (3, "beta")}
    typed = names.relate(rows, ents, lambda t, own: [("beta", "helped_by", "alpha")] * 2 + [("beta", "sees", "delta"), ("beta", "is", "beta")] if "helps" in t else [])
    assert [tuple(r) for r in typed.collect()] == [(1, "beta", "helped_by", "alpha")]
    got = {(r["row_id"], r["s"], r["r"], r["o"]) for r in graph.facts_of(ents, typed).collect()}
    assert got == {(1, "beta", "helped_by", "alpha"), (1, "alpha", graph.CO_OCCURS, "gamma"), (1, "beta", graph.CO_OCCURS, "gamma"), (3, "alpha", graph.CO_OCCURS, "beta")}
    words = names.common_words(spark.createDataFrame([("The the the Madrid madrid Madrid",)], "text string"))
    assert [r["word"] for r in words.collect()] == ["the"]


@pytest.mark.parametrize("most", [0, 20_000])
def test_gazetteer_of_any_size(spark, most):
    g = graph.gazetteer(spark.createDataFrame([("red fox", "fox", "A", 0), ("fox den", "den", "P", 1)], "alias string, canonical string, type string, prio int"))
    rows = spark.createDataFrame([(1, "a Red-Fox den"), (2, "red red fox"), (3, ""), (4, None)], "row_id int, text string")
    assert {(r["row_id"], r["canonical"]) for r in graph.gazetteer_hits(rows, g, most_starts=most).collect()} == {(1, "fox"), (1, "den"), (2, "fox")}


@pytest.mark.parametrize("min_df", [1, 2, 3])
def test_bm25_of_asked_terms_equals_that_of_all(spark, min_df):
    rows = spark.createDataFrame([(1, "a b b c"), (2, "b c d"), (3, "c c e"), (4, ""), (5, "f")], "row_id int, text string")
    q = spark.createDataFrame([(1, "B c"), (2, "e f a")], "qid int, text string")
    every, asked = (sorted(map(tuple, bm25.search(q, *bm25.index(rows, min_df, queries)).collect())) for queries in (None, q))
    assert every == asked and (min_df > 2 or every)


def test_vectors_that_lost_their_rows_are_named(spark):
    from quillmesh.plans import search

    rows = spark.createDataFrame([(1,), (2,), (3,)], "row_id long")
    v = spark.createDataFrame([("a", i) for i in (1, 2, 3)] + [("b", i) for i in (1, 2, 2, 9)], "slug string, row_id long")
    assert [tuple(r) for r in search.misaligned(rows, v, ("a", "b")).collect()] == [("b", 3, 4, 1, 1)]
    assert search.misaligned(rows, v, ("a",)).where("slug = 'a'").count() == 0


def test_places(spark):
    a = spark.createDataFrame([("Calamar, El Retorno (Guaviare); Guaviare, Uno (Meta)",)], "municipios string")
    got = {r["name"]: r["type"] for r in graph.places_of_alerts(a).collect()}
    assert got == {"Calamar": "MUNICIPIO", "El Retorno": "MUNICIPIO", "Guaviare": "DEPARTAMENTO", "Meta": "DEPARTAMENTO"}
    t = spark.createDataFrame([("Amazonas", "Leticia", "Peru"), ("Leticia", "Peru", "Peru")], "adm1 string, adm2 string, country string")
    got = {r["name"]: r["type"] for r in graph.places_of_columns(t, {"adm1": "DEPARTAMENTO", "adm2": "MUNICIPIO"}, "country").collect()}
    assert got == {"Amazonas": "DEPARTAMENTO", "Leticia": "DEPARTAMENTO", "Peru": "PAIS"}


def test_edges_keep_the_heaviest_relation(spark):
    t = spark.createDataFrame([("a", "co_ocurre_con", "b", 5, 2, [1]), ("a", "apoya", "b", 7, 1, [2]), ("a", "dice", "b", 7, 1, [3]), ("a", "co_ocurre_con", "c", 1, 1, [4]), ("a", "apoya", "z", 9, 1, [5])], "s string, r string, o string, weight long, n_docs long, evidence array<int>")
    alive = spark.createDataFrame([("a",), ("b",), ("c",)], "canonical string")
    got = [(r["s"], r["o"], r["r"], r["other_relations"]) for r in graph.edges(t, alive).collect()]
    assert got == [("a", "b", "apoya", "dice;co_ocurre_con")]


def test_one_hop_counts_both_directions(spark):
    edge = spark.createDataFrame([("a", "b", 3), ("b", "a", 2), ("a", "c", 1)], "s string, o string, weight long")
    index = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 3)], "canonical string, row_id int")
    seed = spark.createDataFrame([(1, "a")], "qid int, canonical string")
    got = {r["row_id"]: round(r["score"], 6) for r in graph.search(seed, edge, index, neighbours=2).collect()}
    assert got == {1: 1.35, 2: 0.35}  # b holds both places


def test_measures(spark):
    res = spark.createDataFrame([(1, 1, 0.0), (1, 2, 1.0), (2, 1, 1.0)], "qid int, rnk int, rel double")
    ideal = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 1.0), (3, 0.0)], "qid int, rel double")
    import math

    got = {r["qid"]: r["ndcg"] for r in evaluation.ndcg(res, ideal).collect()}
    assert got[2] == 1.0 and got[3] == 0.0 and got[1] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    r = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "qid int, doc string, rnk int")
    rel = spark.createDataFrame([(1, x) for x in "abxyz"] + [(2, "q")], "qid int, doc string")
    assert {x["qid"]: x["f1"] for x in evaluation.f1_at(r, rel).collect()} == {1: pytest.approx(2 / 3), 2: 0.0}


def test_result_rules(spark):
    schema = "query_id string, documents array<struct<rank:int,doc_id:string>>, fragments array<struct<rank:int,chunk_id:string,doc_id:string,text:string>>"
    long = " ".join(["w"] * 251)
    ok = ("q1", [(i, f"d{i}") for i in (1, 2, 3)], [(i, f"c{i}", f"d{i}", "w " * 20) for i in range(1, 11)])
    bad = ("q2", [(1, "d"), (3, "e")], [(1, "c", "d", long)])
    got = {(r["rule"], r["qid"]) for r in validation.result_violations(spark.createDataFrame([ok, bad], schema), 3).collect()}
    assert got == {("line_count", None), ("document_count", "q2"), ("fragment_count", "q2"), ("document_rank", "q2"), ("fragment_too_long", "q2"), ("one_document", "q2")}
