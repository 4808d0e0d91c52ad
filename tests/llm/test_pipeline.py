import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, sf_dir, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == documents.columns, name
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dups", "decontamination", "secret_scans", "mixing"]
    left = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert 0 < len(left) < documents.count()
    mixed = corpus_pipeline.run(spark, sf_dir)
    used = {i for r in mixed.select("doc_ids").collect() for i in r["doc_ids"]}
    assert used <= left and mixed.agg({"n_words": "sum"}).first()[0] > 0
    assert not mixed.where("text like '%token = %'").count()


def test_the_whole_pipeline_on_odd_rows(spark, make, tmp_path):
    """Null, empty, blank, repeated and very long texts, null ids, and tables without rows go through all stages."""
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one plain text of a few words\n\n  and a second line"), (4, "one plain text of a few words\n\n  and a second line"), (None, "a text without an id"), (None, None), (5, "a token = abcdefgh12345 in it"), (6, long), (7, long + " end")]
    for name, docs in (("some", make(*rows)), ("none", make())):
        path = f"{tmp_path}/{name}"
        docs.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(0, "ten words that stand in no document at all here now")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        got = corpus_pipeline.run(spark, path).collect()
        if name == "none":
            assert got == []
            continue
        ids = {i for r in got for i in r["doc_ids"]}
        assert ids == {4, 5, 6, None} and not any("abcdefgh12345" in r["text"] for r in got)
        text = "".join(r["text"] for r in got)
        assert "words\n\n  and a second line" in text  # line breaks and indents stay


def test_extra_columns_with_any_name_go_through_all_filters(spark, make, sf_dir):
    docs = make((1, "some words of a text"), (2, "other words of one more text")).selectExpr("doc_id", "text", "lang", "source", "n_chars", "1 as _id", "2 as _text0", "3 as _own0", "4 as _toxicity", "5 as spans", "6 as _h")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() == 2
