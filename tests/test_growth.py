"""What must not grow with the tables: rows that operators make on the way, beside the same results."""

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import evaluation


def made(df, node):
    """df's rows, and the rows that each node of this name has made in the plan that ran."""
    rows, out = df.collect(), []

    def walk(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(p.plan())
        if name == node:
            out.append(p.metrics().get("numOutputRows").get().value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return rows, out


@pytest.mark.parametrize("most", [16 << 20, -1])
def test_documents_of_one_file_key_meet_names_once(spark, monkeypatch, most):
    monkeypatch.setattr(evaluation, "BROADCAST_BYTES", most, raising=False)
    names = spark.createDataFrame([("Report 1.pdf",), ("an old report 22 of ours.csv",), ("ab",), ("none",), ("...",)], "name string")
    i = F.col("id")
    docs = spark.range(3000).select(i.alias("doc"), F.concat(F.lit("The report "), (i % 3).cast("string"), F.lit(" v"), F.when(i < 7, "9").otherwise("8"), F.lit(".pdf")).alias("file"))
    docs = docs.unionAll(spark.createDataFrame([(5000, "report 22.pdf"), (4000, "xaby.txt"), (4001, "ab"), (1, "?")], "doc long, file string"))
    rows, runs = made(evaluation.match_files(names, docs), "GenerateExec")
    assert {r["name"]: r["doc"] for r in rows} == {"Report 1.pdf": 1, "an old report 22 of ours.csv": 5000, "ab": 4000}
    assert sum(runs) < 3000, runs


def test_line_items_of_one_number_are_different_fragments(spark, tmp_path):
    from quillmesh.plans import catalogue
    from tests.compare import compare

    spark.createDataFrame([(10, 3), (11, 9), (12, 9), (13, 15)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(10, 1), (10, 1), (11, 2), (11, 2), (12, 2), (13, 4)], "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = catalogue.queries()["result_differences"](spark, str(tmp_path))
    ok, said = compare(df, con, catalogue.oracle_sql()["result_differences"])
    assert ok and df.count() == 2, said


@pytest.mark.parametrize("name", ["ablation_weights", "f1_at_3", "gold_evaluation", "ablation_fusion", "diagnose_systems", "mrr_known_item", "ndcg_at_10", "toc_demote", "hybrid_rrf", "bm25_doc_top3"])
def test_documents_are_cut_into_tokens_once(spark, sf_dir, monkeypatch, name):
    from quillmesh.operators import bm25
    from quillmesh.plans import catalogue

    cuts = []
    bags = bm25.bags
    monkeypatch.setattr(bm25, "bags", lambda rows: cuts.append(1) or bags(rows))
    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().lower()
    # the lists, and the documents that hold an item, are short and written: what is left has no document to cut or to search
    assert len(cuts) == 1
    assert "lower(text" not in plan and "contains(text" not in plan


def test_rows_that_hold_an_item(spark):
    texts = ["one two three four", "xone two threex", "a  b c", "a  b", "", None, "zz one two", "two  three", "q a  b"]
    items = ["one two three", "a  b", "a  b c", "two", "", "e two t", " two ", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    asked = spark.createDataFrame(list(enumerate(items)), "qid long, text string")
    got = sorted(map(tuple, evaluation.holders(rows, asked).collect()))
    assert got == sorted((i, j) for i, q in enumerate(items) for j, t in enumerate(texts) if q is not None and t is not None and q in t)


@pytest.mark.parametrize("most", [0, 100_000])
def test_evidence_is_ranked_up_to_the_first_rows_of_docs(spark, monkeypatch, most):
    from collections import defaultdict

    from quillmesh.operators import graph

    monkeypatch.setattr(graph, "BROADCAST_TRIPLES", most, raising=False)
    monkeypatch.setattr(graph, "ENTITIES_IN_A_TASK", 500, raising=False)
    own = [(i, f"n{j}", f"d{i % 23}" if j < 3 else f"d{i % 23}") for i in range(1000) for j in range(4) if (i * (j + 3)) % 7 < 3 + j]
    own += [(5000 + i, c, "one") for i in range(40) for c in ("x", "y")] + [(6000, c, None) for c in ("x", "y")]
    ents = spark.createDataFrame([(i, c, d) for i, c, d in own], "row_id long, canonical string, doc string")
    rows_of, doc = defaultdict(set), {}
    for i, c, d in own:
        rows_of[i].add(c)
        doc[i] = d
    want = defaultdict(list)
    for i, cs in sorted(rows_of.items()):
        for a in cs:
            for b in cs:
                if a < b:
                    want[a, b].append(i)
    facts = graph.co_occurrences(ents)
    assert facts.rdd.getNumPartitions() == -(-len(own) // 500)
    got = {(r["s"], r["o"]): (r["weight"], r["n_docs"], r["evidence"]) for r in graph.triples(facts).collect()}
    assert got == {k: (len(v), len({doc[i] for i in v} - {None}), v[:8]) for k, v in want.items()}


def test_expansion_equals_a_plain_walk_over_odd_rows(spark):
    """Words of each row, blanks, gaps and long rows of few or many sentences: neighbours as far as they fit, then sentences."""
    import random

    from quillmesh.operators import ranking

    r = random.Random(3)
    target, rows = 40, []
    for doc in range(6):
        pos = 0
        for _ in range(60):
            pos += 1 + (r.random() < 0.05)
            n = r.choice([0, 1, 2, 3, 9, 20, 39, 40, 41, 90, 400])
            words = [f"w{doc}{pos}{k}" + (". " if r.random() < r.choice([0.02, 0.9]) else " ") for k in range(n)]
            rows.append((len(rows), doc, pos, "".join(words).strip() or r.choice(["", " ", None])))
    at = {(d, p): (t or "") for _, d, p, t in rows}

    def cut(t):
        import re

        return [s for s in re.split(r"(?<=[.!?])\s+", t.strip()) if s]

    def walk(doc, pos):
        text = at[doc, pos]
        total, step, out = len(text.split()), {1: 1, -1: 1}, {1: [], -1: []}
        if total >= target:
            return text
        grew = True
        while grew:
            grew = False
            for side in (1, -1):
                t = at.get((doc, pos + side * step[side]))
                if t is not None and total + len(t.split()) <= target:
                    out[side].append(t)
                    total += len(t.split())
                    step[side] += 1
                    grew = True
        for side in (1, -1):
            t = at.get((doc, pos + side * step[side]))
            if t is not None and target - total >= ranking.LEAST_ROOM:
                part = []
                for s in cut(t)[::side]:
                    if total + len(s.split()) > target:
                        break
                    part.append(s)
                    total += len(s.split())
                if part:
                    out[side].append(" ".join(part[::side]))
        return ranking.join_pieces([*out[-1][::-1], text, *out[1]])

    df = spark.createDataFrame(rows, "row_id long, doc long, pos long, text string")
    got = {x["row_id"]: x["text"] for x in ranking.expand(df.select("row_id"), df, target).collect()}
    assert got == {i: walk(d, p) for i, d, p, _ in rows}


def test_python_gets_few_objects_at_a_time(spark):
    from quillmesh.functions import text as T
    from quillmesh.operators import ranking

    df = spark.createDataFrame([(i, 1, i, "a b. c d") for i in range(5)], "row_id long, doc long, pos long, text string")
    plan = ranking.expand(df.select("row_id"), df)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    keys = spark.createDataFrame([(i, None if i == 70 else f"  Ñandú-{i}_ﬁ  ") for i in range(200)], "i int, t string").repartition(1).select("i", T.comparison_key("t").alias("k"))
    assert {r["i"]: r["k"] for r in keys.collect()} == {i: None if i == 70 else f"nandu {i} fi" for i in range(200)}


def test_keys_equal_the_decomposition_of_every_character(spark):
    import unicodedata

    from quillmesh.functions import text as T

    def key(t):
        plain = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()
        return " ".join("".join(c if c.isdigit() or "a" <= c <= "z" else " " for c in plain).split())

    each = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000)]) if ord(c) < 0x3000 or unicodedata.decomposition(c)]
    texts = ["x" + c + "Y1" for c in each] + ["".join(each[i : i + 50]) for i in range(0, len(each), 50)] + ["", " ", "a\x01b", "é\x01b", "ﬁ\x01x", "ȩ́ A", "İİß"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i long, t string")
    got = {r["i"]: r["k"] for r in df.select("i", T.comparison_key("t").alias("k")).collect()}
    assert got.pop(-1) is None
    assert {i: k for i, k in got.items() if k != key(texts[i])} == {}
    plain = spark.createDataFrame([("Ñandú… née",)], "t string")
    assert plain.where(T.comparison_key("t") == "nandu nee").count() == 1
