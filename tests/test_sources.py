"""Readers and small jobs that no registered query covers."""

import datetime
import json

import pytest

from panelgrove.operators import corpus, dataset, profiles
from panelgrove.sources import bars

SCHEMA = "code string, date date, feat_b double, feat_a double, target int, note string"
D = [datetime.date(2026, 1, i) for i in range(1, 6)]


def test_corpus_files(spark, tmp_path):
    one = {"meta": {"version": "2"}, "alphas": [{"corpus": "x", "alpha_id": 1, "formula": "rank(close)"}, {"corpus": "x", "alpha_id": 2, "formula": "close", "depth": 3}]}
    two = {"meta": {"version": "2"}, "alphas": [{"corpus": "y", "alpha_id": 1, "formula": "open"}]}
    for n, d in (("one", one), ("two", two), ("old", two | {"meta": {"version": "1"}})):
        (tmp_path / f"{n}.json").write_text(json.dumps(d, indent=1))
    got = bars.read_corpus(spark, str(tmp_path / "one.json"), str(tmp_path / "two.json"), version="2").collect()
    assert sorted((r["corpus"], r["alpha_id"], r["formula"], r["depth"]) for r in got) == [("x", 1, "rank(close)", None), ("x", 2, "close", 3), ("y", 1, "open", None)]
    with pytest.raises(ValueError, match="not of version"):
        bars.read_corpus(spark, str(tmp_path / "one.json"), str(tmp_path / "old.json"), version="2")


def test_bars_are_read_as_a_panel(spark, tmp_path):
    (tmp_path / "000660.csv").write_text("datetime,close\n2026-01-02 09:00:00,2\n2026-01-01 09:00:00,1\n")
    got = bars.read_csv_folder(spark, str(tmp_path)).withColumnRenamed("datetime", "date")
    made = dataset.with_target(got, 1)
    assert [(r["code"], r["close"], r["target"]) for r in made.collect()] == [("000660", 1.0, 1)]


def test_rows_with_anything_missing_go(spark):
    rows = spark.createDataFrame([("a", D[0], 1.0, 2.0, 1, "n"), ("a", D[1], None, 2.0, 1, "n"), ("a", D[2], 1.0, 2.0, 0, None)], SCHEMA)
    assert [r["date"] for r in dataset.complete(rows).collect()] == [D[0]]


def test_dates_and_codes(spark):
    rows = spark.createDataFrame([(c, d, 1.0, 1.0, 1, None) for c in "abc" for d in D], SCHEMA)
    assert dataset.between(rows, D[1], D[3], ["a", "c"]).count() == 4
    assert dataset.between(rows).count() == 15 and dataset.between(rows, end=D[1]).count() == 3 and dataset.between(rows, codes=[]).count() == 0


def test_matrix(spark):
    rows = spark.createDataFrame([("a", D[0], 1.0, 2.0, 1, "n")], SCHEMA)
    assert dataset.matrix(rows).first()["features"].toArray().tolist() == [2.0, 1.0]


def test_new_names_of_each_turn(spark):
    p = "array<struct<parameter_name:string,confidence:double>>"
    rows = [("u", 1, True, [("b", 0.1), ("a", 0.2), ("b", 0.3)]), ("u", 2, False, [("z", 1.0)]), ("u", 3, None, [("a", 0.9), ("r", 0.9), ("c", None), (None, 1.0)]), ("v", 1, True, None), ("v", 2, True, [("a", 0.5)])]
    got = profiles.new_names(spark.createDataFrame(rows, f"user string, turn int, is_relevant boolean, new_parameters {p}"), ("r",)).collect()
    assert sorted((r["user"], r["turn"], r["names"]) for r in got) == [("u", 1, ["b", "a"]), ("u", 3, ["c"]), ("v", 2, ["a"])]


def test_census_of_many_equal_counts(spark):
    rows = spark.createDataFrame([([f"op{i:04d}" for i in range(500)] + ["op0001", "sum", "sum", "sum"],), ([],), (None,)], "ops array<string>").repartition(2)
    got = corpus.census(rows).collect()
    want = sorted([("sum", 3), ("op0001", 2), *((f"op{i:04d}", 1) for i in range(500) if i != 1)], key=lambda x: (-x[1], x[0]))
    upto, by = 0, {r["op"]: r for r in got}
    for op, n in want:
        upto += n
        assert by[op]["n"] == n and by[op]["cumulative"] == pytest.approx(upto / 504) and by[op]["share"] == pytest.approx(n / 504)
    assert len(got) == 501 and corpus.census(rows.limit(0)).count() == 0


def test_bar_totals_do_not_depend_on_the_order_of_lines(spark, tmp_path):
    """0.1 + 0.2 + 0.3 and such sums have other last digits in another order."""
    for t in ("nation", "region", "supplier"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    lines = [(n, 1, 1, 0.1 * n, round(0.1 * n, 1)) for n in (1, 2, 3, 6, 7)]
    shape = "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double"
    seen = set()
    for i, order in enumerate(([0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [2, 1, 0, 4, 3], [1, 4, 2, 0, 3])):
        rows = spark.createDataFrame([lines[k] for k in order], shape).coalesce(1).selectExpr("*", "0L AS l_suppkey", "TIMESTAMP '2026-01-05' AS l_shipdate")
        (tmp_path / str(i)).mkdir()
        for t in ("nation", "region", "supplier"):
            (tmp_path / str(i) / f"{t}.parquet").symlink_to(tmp_path / f"{t}.parquet")
        rows.write.parquet(str(tmp_path / str(i) / "lineitem.parquet"))
        (bar,) = bars.bars(spark, str(tmp_path / str(i))).collect()
        seen.add((bar["volume"], bar["vwap"]))
    assert len(seen) == 1 and seen.pop() == (pytest.approx(1.9), pytest.approx(1.0))
