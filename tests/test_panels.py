"""Long histories in chunks and wide dates in buckets: the same rows as the plain book gives."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from panelgrove.functions import factors as f
from panelgrove.functions import panels
from panelgrove.functions.scan import Smoothing, smoothed
from panelgrove.plans import alphas, indicators


@pytest.fixture(scope="module")
def panel(spark):
    """Six codes: one listed late, one with a gap of 200 rows, one with a value in every third row, one short."""
    rng = np.random.default_rng(12)
    rows = []
    for code in range(6):
        close = np.round(50 + np.cumsum(rng.normal(size=900)), 1)
        for i, d in enumerate(pd.date_range("2026-01-01 09:00", periods=900 if code != 5 else 3, freq="min")):
            none = (code == 4 and i < 100) or (code == 2 and 150 <= i < 350) or (code == 3 and i % 3)
            x = None if none else float(close[i])
            rows.append((code, d.to_pydatetime(), i + 1, [None, "a", "b"][code % 3], x, float(rng.integers(0, 9)), 1.0))
    names = "code int, date timestamp, seq int, sector string, close double, volume double, one double"
    return spark.createDataFrame(rows, names).selectExpr("*", "close + volume / 10 as high", "close - 1 as low", "close as open", "close + 0.1 as vwap", "close * (code + 1) as cap").cache()


def same(panel, make, **how):
    b = f.Book()
    outputs = make(b)
    plain, other = (b.frame(panel, outputs, **h).toPandas().sort_values(["code", "date"]).reset_index(drop=True) for h in ({}, how))
    assert len(plain) == panel.count() == len(other)
    for n in outputs:
        x, y = plain[n].to_numpy(float), other[n].to_numpy(float)
        np.testing.assert_array_equal(np.isnan(x), np.isnan(y), err_msg=n)
        np.testing.assert_allclose(y, x, rtol=1e-7, atol=1e-7 * max(1e-9, np.nanmax(np.abs(x), initial=0)), err_msg=n)


def over_time(b):
    c, v, r = b.close, b.volume, f.ts_returns(b.close, 1)
    return {
        "delay": f.ts_delay(c, 3), "lead": f.ts_delay(c, -12), "mean": f.ts_mean(c, 7), "std": f.ts_std(r, 20), "sum": f.ts_sum(v, 9), "median": f.ts_median(c, 5),
        "skew": f.ts_skew(v, 7), "rank": f.ts_rank(c, 11), "product": f.ts_product(1 + r, 5), "argmax": f.ts_argmax(c, 7), "argmin": f.ts_argmin(v, 7), "slope": f.ts_slope(c, 7),
        "r2": f.ts_rsquare(c, 7), "resi": f.ts_resi(c, 7), "decay": f.ts_decay_linear(c, 7), "quantile": f.ts_quantile(v, 9, 0.8), "corr": f.ts_corr(c, v, 10), "cov": f.ts_cov(c, v, 10),
        "deep": f.ts_mean(f.ts_max(f.ts_delta(c, 30), 20), 10), "both": f.ts_delay(f.ts_mean(c, 15), -8), "cumsum": f.ts_cumsum(v), "cumprod": f.ts_cumprod(1 + r / 100),
        "ewm": f.ts_ewm(c, 9), "ewm2": f.ts_ewm(f.ts_ewm(c, 3), 40), "sma": f.ts_sma_cn(c, 9, 1), "of_sum": f.ts_mean(f.ts_cumsum(v), 6), "flow": f.ts_ewm(f.ts_cumsum(v * r), 10),
        "of_ewm": f.ts_std(f.ts_ewm(c, 9), 12), "adv": b.adv20, "last": f.ts_sma_cn(c, 1, 1),
    }


def test_chunks_over_time(panel):
    same(panel, over_time, chunk=100)


def test_halo_deeper_than_a_chunk(panel):
    same(panel, lambda b: {"deep": f.ts_mean(f.ts_max(f.ts_delta(b.close, 30), 20), 10), "ewm": f.ts_ewm(b.close, 30), "sma": f.ts_sma_cn(f.ts_sma_cn(b.close, 3, 2), 30, 1)}, chunk=8)


def across(b):
    m = f.ts_delta(b.close, 2)
    return {
        "rank": f.cs_rank(m), "ties": f.cs_rank(b.one), "volume": f.cs_rank(b.volume), "scale": f.cs_scale(m), "mean": f.cs_mean(m), "std": f.cs_std(m), "median": f.cs_median(m),
        "demean": f.grp_demean(m), "grp_rank": f.grp_rank(b.volume), "turned": f.cs_rank(-b.close * 1e-3), "again": f.cs_rank(f.ts_mean(f.cs_rank(m), 4)), "nested": f.grp_rank(f.cs_rank(m)),
    }


def test_buckets_across_codes(panel):
    same(panel, across, wide=True)


def test_indicators_in_chunks(panel):
    same(panel, lambda b: indicators.indicators(b, ["rsi", "ppo", "atr", "mfi", "obv", "adosc", "aroon_osc", "beta"]), chunk=300)


def test_formulas_in_chunks_and_buckets(panel):
    rows = panel.where("seq <= 330")
    same(rows, lambda b: alphas.alphas(b, [1, 15, 50, 63, 76]), chunk=128, wide=True)


def test_more_tasks_than_codes(spark, panel):
    """Rows of two codes are dealt to far more tasks, and none holds more than a part with its halo."""
    b = f.Book()
    out = b.frame(panel.where("code < 2"), {"y": f.ts_mean(b.close, 7)}, chunk=32)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("y")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 1800 and len(sizes) > 20 and max(sizes) < 900


def test_numbered(spark, panel):
    out = panels.numbered(panel.drop("seq"), "hour")
    both = out.select("code", "date", F.col("seq").alias("a")).join(panel.select("code", "date", "seq"), ["code", "date"])
    assert both.where("a = seq").count() == panel.count() == out.count()


def test_all_indicators_share_one_shuffle(spark, panel):
    b = f.Book()
    own = indicators.indicators(b)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = b.frame(panel, own)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_no_python_in_smoothing(panel):
    b = f.Book()
    for how in ({}, {"chunk": 100}):
        plan = b.frame(panel, {"y": f.ts_ewm(b.close, 12), "z": f.ts_sma_cn(b.close, 14, 1)}, **how)._jdf.queryExecution().executedPlan().toString()
        assert "Pandas" not in plan and "Arrow" not in plan


def test_weights_of_a_scan(spark):
    """A smoothing forgets what lies behind its depth, and nothing else: the oldest value counts while it can."""
    rows = [(1, i, i, 1e12 if i == 1 else (None if 2 <= i <= 40 else 1.0)) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "code int, date int, seq int, x double")
    for helper, want in (
        (Smoothing("x", 0.2, True), lambda s: s.ewm(alpha=0.2, min_periods=2).mean()),
        (Smoothing("x", 0.2, False), lambda s: s.ewm(alpha=0.2, adjust=False).mean()),
    ):
        own = smoothed(df, {"y": helper}).orderBy("seq").toPandas()
        np.testing.assert_allclose(own["y"].to_numpy(float), want(own["x"].astype(float)).to_numpy(), rtol=1e-12)
