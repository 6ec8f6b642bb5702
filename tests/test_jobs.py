"""Jobs against hand-computed cases and the checking engine."""

import datetime
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelgrove import catalog
from panelgrove.operators import corpus, dataset, hygiene, profiles, replay, selection
from panelgrove.sources import bars as bar_files
from panelgrove.streaming.replay import stream_fills

D = [datetime.date(2026, 1, i) for i in range(1, 9)]
SF = "/root/testdata/sf0.001"


def bars(spark, closes, actions):
    rows = [("r", 1, d, c, c, a) for d, c, a in zip(D, closes, actions)]
    return spark.createDataFrame(rows, "run_id string, code long, date date, open double, close double, action string")


def test_next_open_fills_at_the_next_bar(spark):
    out = replay.fills(bars(spark, [100.0, 105.0, 105.0, 105.0], ["BUY", "HOLD", "HOLD", "HOLD"])).collect()
    assert [(r.action, r.price) for r in out] == [("BUY", 105.0)]
    assert out[0].qty == math.floor(1e7 / (105 * 1.00015))


def test_metrics(spark):
    rows = bars(spark, [100.0, 120.0, 90.0, 130.0], ["HOLD"] * 4).withColumnRenamed("close", "equity")
    none = spark.createDataFrame([], "run_id string, code long, action string, pnl double")
    m = replay.metrics(rows, none).first()
    assert m.total_return == pytest.approx(0.3) and m.mdd == pytest.approx(0.25) and m.n_trades == 0 and m.win_rate == 0


def test_unknown_action_is_refused(spark):
    with pytest.raises(Exception, match="unknown action"):
        replay.fills(bars(spark, [1.0, 2.0], ["BUY", "JUMP"])).collect()


def test_empty_bars(spark):
    assert replay.fills(bars(spark, [], [])).count() == 0


def test_profile_ties_go_to_the_later_turn(spark):
    rows = spark.createDataFrame([("u", 1, True, "A", 0.5), ("u", 2, True, "B", 0.5), ("u", 3, True, None, 0.9), ("u", 4, False, "C", 1.0)], "user string, turn int, is_relevant boolean, v string, c double")
    assert profiles.merged(rows, {"v": "c"}).first().v == "B"


def test_migration(spark):
    schema = "corpus string, alpha_id int, hash string"
    old, new = spark.createDataFrame([("x", 1, "a"), ("x", 2, "b")], schema), spark.createDataFrame([("x", 1, "n"), ("x", 2, "n")], schema)
    out = corpus.migrate(spark.createDataFrame([("a",), ("b",), ("z",)], "hash string"), old, new).orderBy("hash").collect()
    assert [(r.hash, r.status, r.merged_from) for r in out] == [("n", "remapped", ["b"]), ("z", "orphan", [])]


@pytest.mark.parametrize("name", ["q1_momentum_rank", "q10_oversold", "alphas_041_to_050", "training_rows", "replay_metrics", "hygiene_checks", "top_bottom", "profile_merge", "trading_parameters", "label_checks", "scale_invariance", "reconciliation", "corpus_census", "corpus_usage", "regime_strategy", "training_report"])
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("region", "nation", "supplier", "lineitem", "documents", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF).toPandas()
    want = c.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)

    def plain(df):
        return sorted(repr(tuple("-" if pd.isna(v) else (round(v, 5) + 0.0 if isinstance(v, float) else str(v)) for v in row)) for row in df[cols].astype(object).itertuples(index=False))

    assert plain(got) == plain(want)


def test_replay_of_minute_bars_and_text_codes(spark):
    t = datetime.datetime(2026, 1, 1, 9)
    closes = [100 + i / 10 for i in range(100)]
    rows = [("r", "005930", t + datetime.timedelta(minutes=i), c, c, "BUY" if i == 0 else "HOLD") for i, c in enumerate(closes)]
    b = spark.createDataFrame(rows, "run_id string, code string, date timestamp, open double, close double, action string")
    made = replay.fills(b, fee=0.0)
    out = made.collect()
    assert [(r.code, r.date, r.price) for r in out] == [("005930", t + datetime.timedelta(minutes=1), 100.1)]
    m = replay.metrics(replay.equity(b, made), made).first()
    assert m.total_return > 0.08 and m.code == "005930"
    assert replay.fills(b, "same_close").first().price == 100.0


def test_streamed_fills_are_those_of_the_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [("r", f"c{k}", datetime.date(2026, 1, 1) + datetime.timedelta(days=i), float(p), float(p) + 1, a) for k in range(4) for i, (p, a) in enumerate(zip(rng.uniform(50, 150, 30), rng.choice(["BUY", "SELL", "HOLD"], 30)))]
    schema = "run_id string, code string, date date, open double, close double, action string"
    b = spark.createDataFrame(rows, schema)
    for part in range(3):
        b.where(f"dayofmonth(date) > {part * 10} and dayofmonth(date) <= {part * 10 + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_fills(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(spark.read.parquet(str(tmp_path / "out"))) == plain(replay.fills(b)) != []


def test_split_of_timestamps(spark):
    t = datetime.datetime(2026, 1, 1)
    rows = spark.createDataFrame([(c, t + datetime.timedelta(hours=i), i) for c in ("a", "b") for i in range(10)], "code string, date timestamp, x int")
    assert dataset.with_split(rows).where("split = 'test'").count() == 4
    at = dataset.with_split(rows, at="2026-01-01 03:00:00")
    assert at.where("split = 'train'").count() == 6 and at.where("split = 'test'").agg(F.min("x")).first()[0] == 3
    # A border outside the range gives way to the share.
    assert dataset.with_split(rows, at="2027-01-01").where("split = 'test'").count() == 4


def test_split_files_keep_leading_zeros(spark, tmp_path):
    rows = spark.createDataFrame([("000660", 1.5, "train"), ("005930", 2.5, "train"), ("000660", 3.5, "test")], "code string, close double, split string")
    for kind in ("parquet", "csv"):
        bar_files.write_split(rows, str(tmp_path / kind), kind)
        got = bar_files.read_split(spark, str(tmp_path / kind), "train", "000660", kind).collect()
        assert [(r.code, r.close) for r in got] == [("000660", 1.5)]


def test_trading_parameters_of_the_worked_case(spark):
    schema = "user string, loss_feeling string, time_horizon string, company_size_preference string, risk_tolerance_hint double, risk_tolerance_confidence double, thematic_intent string, excluded_sectors array<string>, dynamic array<struct<parameter_name:string,dtype:string,value:string>>"
    extra = [("esg_preference", "bool", "true"), ("dividend_preference", "bool", "true")]
    rows = [("u", "SOMEWHAT_CONCERNED", "MEDIUM", "LARGE_CAP", 0.4, 0.5, "FUTURE_GROWTH_SECTOR", ["TOBACCO"], extra), ("v", "VERY_ANXIOUS", "LONG", None, None, None, None, None, None)]
    u, v = profiles.trading_parameters(spark.createDataFrame(rows, schema)).orderBy("user").collect()
    assert u.risk_tolerance == pytest.approx(0.45) and u.min_confidence_to_act == pytest.approx(0.7) and u.max_position_size_pct == pytest.approx(0.0785)
    assert u.stop_loss_pct == pytest.approx(0.056) and u.min_holding_period_days == 180 and u.max_leverage == pytest.approx(1.9)
    assert u.portfolio_allocation == {"LARGE_CAP": 0.8, "GROWTH_THEME_AUTO": 0.2} and u.excluded_sectors == ["TOBACCO"]
    assert u.agent_weights == pytest.approx({"HFT": 0.15 / 0.985, "ML": 0.335 / 0.985, "LLM": 0.5 / 0.985})
    assert [(x.name, x.value.as_bool) for x in u.extra_constraints] == [("esg_preference", True), ("dividend_preference", True)]
    assert v.portfolio_allocation == {"UNRESTRICTED": 1.0} and v.excluded_sectors == [] and v.risk_tolerance == pytest.approx(0.15)


def test_typed_values(spark):
    rows = [("bool", " Yes"), ("float", "1.5"), ("int", "-2.7"), ("list", "['a', b,]"), ("float", "x"), ("string", "s")]
    out = [r.t for r in spark.createDataFrame(rows, "d string, v string").select(profiles.typed(F.col("v"), F.col("d")).alias("t")).collect()]
    assert [out[0].as_bool, out[1].as_number, out[2].as_number, out[3].as_list, out[4].as_number, out[4].raw] == [True, 1.5, -2.0, ["a", "b"], None, "x"]


def test_a_selection_is_held_for_its_period(spark):
    days = [datetime.date(2026, 1, d) for d in (5, 6, 7, 12)]
    panel = spark.createDataFrame([(d, c) for d in days for c in "abc"], "date date, code string")
    chosen = spark.createDataFrame([(days[0], "a", 0.5), (days[0], "b", 0.5), (days[1], "c", 1.0), (days[3], "c", 1.0)], "date date, code string, weight double")
    out = sorted((r.date.day, r.code, r.weight) for r in selection.rebalanced(chosen, panel, "week").collect())
    assert out == [(d, c, 0.5) for d in (5, 6, 7) for c in "ab"] + [(12, "c", 1.0)]


def test_average_ranks_without_a_global_sort(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=200), [0.0, 0.0, -0.5, -0.5, 3.0, 1e-9, -1e12]])
    rows = spark.createDataFrame([("f", float(v)) for v in x], "factor_id string, a double")
    got = {r.a: r.a_rank for r in hygiene._ranked(rows, "a").collect()}
    want = pd.Series(x).rank()
    assert all(got[v] == r for v, r in zip(x, want))
