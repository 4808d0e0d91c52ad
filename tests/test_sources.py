"""Files of every format, loose query files, tiles, page layouts, and the incremental stream."""

import json
import zipfile

from pyspark.sql import functions as F

from quillmesh.operators.encoders import ENCODERS
from quillmesh.sources import files, records
from quillmesh.streaming import ingest

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def write_xlsx(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="One"/><sheet name="Empty"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>name</t></si><si><t>size</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {NS}><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c t="inlineStr"><is><t>box</t></is></c><c><v>3</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {NS}><sheetData/></worksheet>")


def test_extract_isolates_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("k;v\nx;1\ny;\n".encode("utf-8-sig"))
    (tmp_path / "b.json").write_text(json.dumps({"alerta_meta": {"codigo": "001-20", "municipios": "Calamar (Guaviare)"}, "body_paragraphs": ["p one", "p two"], "title": "Mapa"}))
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.txt").write_text("plain text", encoding="latin-1")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "g.json").write_text(json.dumps({"sections": [{"heading": "H", "paragraphs": ["q"]}, "loose"], "lists": [["i", "j"]], "excerpt": "new"}))
    write_xlsx(tmp_path / "f.xlsx")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.extract(spark, str(tmp_path)).collect()}
    assert got["a.csv"]["text"] == "Columnas: k, v\nk: x | v: 1\nk: y" and got["a.csv"]["extra"]["n_filas"] == "2"
    assert got["b.json"]["title"] == "Alerta Temprana 001-20 - Calamar (Guaviare)" and got["b.json"]["text"].endswith("p one\np two")
    assert got["c.json"]["error"].startswith("JSONDecodeError") and got["e.pdf"]["error"] == "no parser for pdf"
    assert got["d.txt"]["text"] == "plain text" and got["f.xlsx"]["blocks"] == ["Hoja: One. Columnas: name, size\nname: box | size: 3"]
    assert got["g.json"]["text"] == "new\n\n## H\n\nq\n\nloose\n\ni\nj"
    with_pdf = files.extract(spark, str(tmp_path), {"pdf": lambda data: {"title": "T", "text": data.decode()}}, "*.pdf")
    assert with_pdf.first()["text"] == "%PDF"


def test_flatten_writes_python_scalars():
    assert files.flatten({"a": True, "b": [1.0, None, "x"], "c": {"d": ""}}) == "a: True\nb: 1.0\nx"


def test_read_csv_finds_the_delimiter(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a\tb\n1\t2\n")
    assert files.read_csv(spark, str(tmp_path / "t.csv")).first().asDict() == {"a": "1", "b": "2"}


def test_queries_with_loose_shapes(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"ID": "x1", "Pregunta": " one "}\nbroken\n\n{"other": "a text of more than twenty characters"}\n')
    got = [(r["query_id"], r["text"]) for r in records.read_queries(spark, str(tmp_path / "q.jsonl")).orderBy("n").collect()]
    assert got == [("x1", "one"), ("q002", "a text of more than twenty characters")]
    (tmp_path / "q.json").write_text('[{"qid": "z", "query": "two"}, {"text": "three"}]')
    got = [(r["query_id"], r["text"]) for r in records.read_queries(spark, str(tmp_path / "q.json")).orderBy("n").collect()]
    assert got == [("z", "two"), ("q002", "three")]


def test_query_marks_keep_the_first(spark):
    t = spark.createDataFrame([("intro q001 What  is\nit? Q2 Why? q0001 again q003  ",)], "value string")
    assert {r["query_id"]: r["text"] for r in records.queries_from_marks(t).collect()} == {"q001": "What is it?", "q002": "Why?"}


def test_query_marks_reads_every_item(spark, tmp_path):
    import duckdb

    from quillmesh.plans import record_queries, registry
    from tests.compare import compare

    n = [0, 7, 999, 1000, 1001, 2345, 12345, *range(3000, 5200)]
    spark.createDataFrame([(i, f"what  is\n{i}x ?") for i in n], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{tmp_path}/benchmark.parquet/*.parquet')")
    df = record_queries.query_marks(spark, str(tmp_path))
    ok, said = compare(df, con, registry.SQL["query_marks"])
    assert ok and df.count() == len(n), said


def test_gold_continues_the_question(spark):
    rows = [(1, "Q1", "f1", "a.pdf"), (2, "", "f2", "no file"), (3, None, None, "b.PDF"), (4, "Q2", " ", "c.pdf")]
    got = records.gold(spark.createDataFrame(rows, "n int, question string, fragment string, document string")).collect()
    assert [(r["question"], r["fragments"], r["files"]) for r in got] == [("Q1", ["f1", "f2"], ["a.pdf", "b.PDF"])]


def test_tiles_without_rows_keep_a_header(spark):
    p = spark.createDataFrame([("x/tiles/5/1/AMAZONUW_2.pbf",), ("x/tiles/5/1/AMAZONUW_3.pbf",)], "path string")
    t = spark.createDataFrame([(1, "5", "1", "2", "P1", "Leticia", "SI"), (2, "5", "1", "2", "P1", "other", ""), (3, "5", "1", "2", "P2", "", "SI")], "n int, tile_zoom string, tile_x string, tile_y string, b_ADM2_PCODE string, b_ADM2_ES string, grupo_ELN string")
    got = {r["y"]: r for r in records.tiles(p, t).collect()}
    assert got["2"]["n_places"] == 1 and "Territorio: Leticia. presencia de grupos armados: Ejército de Liberación Nacional (ELN)." in got["2"]["text"]
    assert got["3"]["text"].endswith("0 territorios registrados.")


def test_two_columns_with_a_band(spark):
    blocks = [(1, 100.0, 5.0, 5.0, 95.0, 15.0, "TITLE")]
    for i in range(4):
        y = 20.0 + 20 * i
        blocks += [(1, 100.0, 5.0, y, 45.0, y + 10, f"L{i}"), (1, 100.0, 55.0, y, 95.0, y + 10, f"R{i}")]
    blocks += [(2, 100.0, 5.0, 20.0, 95.0, 30.0, "b"), (2, 100.0, 5.0, 5.0, 95.0, 15.0, "a")]
    df = spark.createDataFrame(blocks, "page int, width double, x0 double, y0 double, x1 double, y1 double, text string")
    got = {r["page"]: r["text"].split("\n\n") for r in records.page_texts(df).collect()}
    assert got[1] == ["TITLE", "L0", "L1", "L2", "L3", "R0", "R1", "R2", "R3"] and got[2] == ["a", "b"]


def test_stream_appends_and_restarts(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "doc_id string, text string"
    run = lambda: ingest.start(spark, src, schema, out, ck, ENCODERS["hash_a"]).awaitTermination()
    spark.createDataFrame([("a", "first version of a text that is long enough")], schema).write.mode("append").parquet(src)
    run()
    spark.createDataFrame([("a", "second version of a text that is long enough"), ("b", "another text that is also long enough")], schema).write.mode("append").parquet(src)
    run()
    run()
    table = spark.read.parquet(out)
    assert table.count() == 3
    now = {r["doc_id"]: r["text"] for r in ingest.latest(table.withColumn("arrived", F.col("arrived"))).collect()}
    assert now["a"].startswith("second") and len(now) == 2


def test_index_is_built_and_searched(spark, tmp_path):
    from quillmesh.config import Settings
    from quillmesh.operators import encoders, graph, validation
    from quillmesh.plans import search
    from quillmesh.sources import sinks

    topics = ["Orbital debris grows in low orbit every year. NASA said so.", "Illegal mining harms the rivers of the forest. NASA saw it.", "Machine learning helps to find patterns in the data. NASA uses it."]
    docs = spark.createDataFrame([(f"d{i}", " ".join(f"{topics[i % 3]} Note {w} stands here for number {w}." for w in ("one", "two", "three", "four")[: 2 + i % 3]), i % 3 + 1, "en") for i in range(9)], "doc_id string, text string, class int, lang string")
    settings = Settings(encoders=("hash_a", "hash_c"), n_documents=2, n_fragments=3).at(str(tmp_path / "index"))
    gaz = graph.gazetteer(spark.createDataFrame([("NASA", "NASA", "ORG", 0), ("orbital debris", "debris", "T", 1), ("mining", "mining", "T", 2)], "alias string, canonical string, type string, prio int"))
    search.build(docs, settings, gaz)
    queries = spark.createDataFrame([("q1", "orbital debris in low orbit"), ("q2", "illegal mining of rivers")], "qid string, text string")
    found, frags = search.Retriever(spark, settings).search(queries)
    first = {r["qid"]: int(r["doc"][1:]) % 3 for r in found.where("rnk = 1").collect()}
    assert first == {"q1": 0, "q2": 1} and frags.count() == 6
    out = str(tmp_path / "results")
    sinks.write_jsonl(sinks.result_objects(found, frags), out)
    assert validation.differences(sinks.result_objects(found, frags), spark.read.json(out)).count() == 0
    rows, kept = spark.read.parquet(settings.path("rows")), spark.read.parquet(settings.path("vectors")).where("slug = 'hash_a'")
    e = encoders.ENCODERS["hash_a"]
    assert encoders.misaligned(rows, kept, e, "embed_text").count() == 0
    cache = encoders.encode_changed(rows.select("row_id", "embed_text"), kept.select("row_id", F.lit(0).cast("long").alias("text_hash"), "v"), e, "embed_text")
    assert cache.count() == rows.count() and "<li>" in sinks.review_html(sinks.result_objects(found, frags))


def test_files_by_format_and_number(spark, tmp_path):
    for name in ("b.txt", "a.txt", "c.csv", "d.odd"):
        (tmp_path / name).write_text("x,y\n1,2\n")
    of = lambda **k: sorted(r["path"].rsplit("/", 1)[-1] for r in files.extract(spark, str(tmp_path), **k).collect())
    assert of() == ["a.txt", "b.txt", "c.csv", "d.odd"] and of(only="csv") == ["c.csv"] and of(only="txt", limit=2) == ["a.txt", "b.txt"]


def test_json_lines_are_read_with_types(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "é"}\nnot json\n\n{"b": "y"}\n[1]\n')
    got = records.read_jsonl(spark, str(tmp_path), "a long, b string")
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "é"), (None, "y")]


def test_gold_sheets_need_their_headers(spark):
    sheet = lambda *rows: spark.createDataFrame(list(enumerate(rows)), "n int, cells array<string>")
    got = records.gold(records.gold_rows(sheet(["Documento", "PREGUNTA", " fragmento "], ["a.pdf\nnote\nb.TXT", "Why?", "f1"], ["", "", "f2"], ["c.pdf", "No fragment?", ""]))).collect()
    assert [(r["question"], r["fragments"], r["files"]) for r in got] == [("Why?", ["f1", "f2"], ["a.pdf", "b.TXT"])]
    assert records.gold_rows(sheet(["a", "b"], ["c", "d"])).count() == 0 and records.gold_rows(sheet(["PREGUNTA", "FRAGMENTO", "DOCUMENTO"])).count() == 0
