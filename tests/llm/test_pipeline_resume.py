"""A run of the pipeline into a folder that was used before."""


def test_a_used_folder_never_gives_another_input_s_rows(spark, tmp_path):
    import corpus_pipeline

    def tables(name, texts):
        at = tmp_path / name
        spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.mode("overwrite").parquet(f"{at}/benchmark.parquet")
        return str(at)

    run = lambda d: {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, d, str(tmp_path / "run")).collect()}
    a = tables("a", ["one text of some words", "another one that is not like it at all"])
    first = run(a)
    assert set(first) == {0, 1} and run(a) == first
    # The same stages again come from the folder: their time of change stays.
    changed = (tmp_path / "run/4/_SUCCESS").stat().st_mtime_ns
    run(a)
    assert (tmp_path / "run/4/_SUCCESS").stat().st_mtime_ns == changed
    assert set(run(tables("b", ["a third, which stands alone in its table"]))) == {0}
    assert set(run(tables("a", ["one text of some words", "and then some", "more words than there were before"]))) == {0, 1, 2}


def test_texts_written_beside_a_stage(spark, tmp_path):
    from twinfold.common import files_below, get_text, put_text

    put_text(spark, f"{tmp_path}/x", "é")
    put_text(spark, f"{tmp_path}/x", "ö")
    assert get_text(spark, f"{tmp_path}/x") == "ö" and get_text(spark, f"{tmp_path}/y") is None
    assert [(p.rsplit("/", 1)[1], n) for p, n, _ in files_below(spark, str(tmp_path))] == [("x", 2)] and files_below(spark, f"{tmp_path}/none") == []
