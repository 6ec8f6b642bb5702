"""No text is lost to repeated ids, and empty tables go through every stage."""

import corpus_pipeline as cp

TEXT = "der Hafen war an diesem Morgen ruhig und die Boote lagen in einer Reihe im Wasser nummer"


def test_rows_that_share_an_id(spark):
    rows = [(1, f"{TEXT} eins"), (1, "the harbour was quiet that morning and nobody asked why"), (1, f"{TEXT} eins"), (2, "a clerk walked down the pier and counted crates of fish and salt"), (None, "no id at all"), (3, None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.remove_near_duplicates(spark, df, "")
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted({*rows}, key=repr)
    assert out.columns == df.columns


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_decontamination_holds_one_worker_a_task(spark, tmp_path):
    rows = [(1, "so it was: Der Hafen, war an (diesem) Morgen ruhig. And more words follow here to keep it all in place for now", 1), (2, TEXT, 2), (3, None, 3), (4, "", 4), (5, "nothing of it", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    spark.createDataFrame([(1, "der hafen war an diesem morgen ruhig"), (2, TEXT)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = cp.remove_benchmark(spark, df, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    left = "so it was: . And more words follow here to keep it all in place for now"
    assert sorted(map(tuple, out.collect())) == [(1, left, len(left)), (3, None, None), (4, "", 0), (5, "nothing of it", 13)]
