"""Factor operators against pandas on a small panel with ties, gaps and a late listing."""

import numpy as np
import pandas as pd
import pytest

from panelgrove import catalog
from panelgrove.functions import factors as f
from panelgrove.functions.shown import shown
from panelgrove.plans import alphas


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = []
    for code in range(5):
        close = np.round(50 + np.cumsum(rng.normal(size=40)), 1)
        for i, d in enumerate(pd.bdate_range("2026-01-01", periods=40)):
            x = None if (code == 4 and i < 10) or (code == 2 and i == 20) else float(close[i])
            rows.append((code, d.date(), i + 1, ["a", "b"][code % 2], x, float(rng.integers(1, 9))))
    df = spark.createDataFrame(rows, "code int, date date, seq int, sector string, close double, volume double").cache()
    return df, df.toPandas().sort_values(["code", "date"])


def run(panel, make):
    df, _ = panel
    b = f.Book()
    return b.frame(df, {"y": make(b)}).toPandas().sort_values(["code", "date"])["y"].to_numpy(float)


def roll(panel, fn, w, col="close"):
    mp = min(w, max(2, w // 2))
    return panel[1].groupby("code")[col].transform(lambda s: fn(s.astype(float).rolling(w, min_periods=mp))).to_numpy(float)


@pytest.mark.parametrize(
    "make, fn",
    [
        (lambda b: f.ts_mean(b.close, 7), lambda r: r.mean()),
        (lambda b: f.ts_std(b.close, 7), lambda r: r.std()),
        (lambda b: f.ts_skew(b.close, 7), lambda r: r.skew()),
        (lambda b: f.ts_median(b.close, 7), lambda r: r.median()),
        (lambda b: f.ts_rank(b.close, 7), lambda r: r.rank(pct=True)),
        (lambda b: f.ts_quantile(b.close, 7, 0.8), lambda r: r.quantile(0.8)),
        (lambda b: f.ts_max(b.close, 7), lambda r: r.max()),
    ],
)
def test_rolling(panel, make, fn):
    np.testing.assert_allclose(run(panel, make), roll(panel, fn, 7), atol=1e-9)


def every(panel, fn, w, col="close"):
    """Over windows that hold a value in every row, cut at a code's begin."""
    least = min(w, max(2, w // 2))

    def one(s):
        x = s.to_numpy(float)
        out = np.full(len(x), np.nan)
        for i in range(len(x)):
            part = x[max(0, i - w + 1) : i + 1]
            if len(part) >= least and not np.isnan(part).any():
                out[i] = fn(part)
        return pd.Series(out, s.index)

    return panel[1].groupby("code")[col].transform(one).to_numpy(float)


def line(y, what):
    t = np.arange(len(y))
    b, a = np.polyfit(t, y, 1)
    fit = a + b * t
    if what == "r2":
        return 1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum() if y.max() > y.min() else np.nan
    return b if what == "slope" else y[-1] - fit[-1]


@pytest.mark.parametrize(
    "make, fn, col",
    [
        (lambda b: f.ts_product(b.close / 50, 5), lambda x: np.prod(x / 50), "close"),
        (lambda b: f.ts_argmax(b.volume, 5), lambda x: len(x) - 1 - np.argmax(x), "volume"),
        (lambda b: f.ts_argmin(b.volume, 5), lambda x: len(x) - 1 - np.argmin(x), "volume"),
        (lambda b: f.ts_slope(b.close, 5), lambda x: line(x, "slope"), "close"),
        (lambda b: f.ts_rsquare(b.volume, 5), lambda x: line(x, "r2"), "volume"),
        (lambda b: f.ts_resi(b.close, 5), lambda x: line(x, "resi"), "close"),
        (lambda b: f.ts_decay_linear(b.close, 5), lambda x: (x * np.arange(1, len(x) + 1)).sum() / (len(x) * (len(x) + 1) / 2), "close"),
    ],
)
def test_windows_that_need_every_value(panel, make, fn, col):
    np.testing.assert_allclose(run(panel, make), every(panel, fn, 5, col), atol=1e-8)


@pytest.mark.parametrize(
    "make, fn",
    [
        (lambda b: f.ts_delay(b.close, 3), lambda s: s.shift(3)),
        (lambda b: f.ts_delta(b.close, 3), lambda s: s - s.shift(3)),
        (lambda b: f.ts_returns(b.close, 3), lambda s: s / s.shift(3) - 1),
        (lambda b: f.ts_cumsum(b.close), lambda s: s.cumsum()),
        (lambda b: f.ts_cumprod(b.close / 50), lambda s: (s / 50).cumprod()),
        (lambda b: f.ts_sum(b.close, 6), lambda s: s.rolling(6, min_periods=3).sum()),
        (lambda b: f.ts_min(b.close, 6), lambda s: s.rolling(6, min_periods=3).min()),
        (lambda b: f.ts_var(b.close, 6), lambda s: s.rolling(6, min_periods=3).var()),
        (lambda b: f.ts_mean(b.close, 3.9), lambda s: s.rolling(3, min_periods=2).mean()),
    ],
)
def test_operators_over_time(panel, make, fn):
    want = panel[1].groupby("code")["close"].transform(lambda s: fn(s.astype(float))).to_numpy(float)
    np.testing.assert_allclose(run(panel, make), want, atol=1e-8)


@pytest.mark.parametrize("make, name", [(lambda b: f.ts_corr(b.close, b.volume, 8), "corr"), (lambda b: f.ts_cov(b.close, b.volume, 8), "cov")])
def test_pairs(panel, make, name):
    df = panel[1]
    parts = [getattr(g["close"].astype(float).rolling(8, min_periods=4), name)(g["volume"]) for _, g in df.groupby("code")]
    np.testing.assert_allclose(run(panel, make), pd.concat(parts).reindex(df.index).to_numpy(float), atol=1e-7)


@pytest.mark.parametrize(
    "make, fn, keys",
    [
        (lambda b: f.cs_scale(b.close), lambda s: s / s.abs().sum(), ["date"]),
        (lambda b: f.cs_mean(b.close), lambda s: s.mean(), ["date"]),
        (lambda b: f.cs_std(b.close), lambda s: s.std(), ["date"]),
        (lambda b: f.cs_median(b.close), lambda s: s.median(), ["date"]),
        (lambda b: f.grp_mean(b.close), lambda s: s.mean(), ["date", "sector"]),
        (lambda b: f.grp_demean(b.close), lambda s: s - s.mean(), ["date", "sector"]),
        (lambda b: f.grp_rank(b.volume), lambda s: s.rank(pct=True), ["date", "sector"]),
    ],
)
def test_operators_across_codes(panel, make, fn, keys):
    df = panel[1]
    col = "volume" if make.__code__.co_names[-1] == "volume" else "close"
    want = df.assign(x=df[col].astype(float)).groupby(keys)["x"].transform(fn).to_numpy(float)
    np.testing.assert_allclose(run(panel, make), want, atol=1e-9)


def test_smoothing(panel):
    want = panel[1].groupby("code")["close"].transform(lambda s: s.astype(float).ewm(span=9, adjust=True, min_periods=2).mean())
    np.testing.assert_allclose(run(panel, lambda b: f.ts_ewm(b.close, 9)), want, atol=1e-9)


def test_smoothing_across_gaps(panel):
    want = panel[1].groupby("code")["close"].transform(lambda s: s.astype(float).ewm(alpha=1 / 9, adjust=False, min_periods=1).mean())
    np.testing.assert_allclose(run(panel, lambda b: f.ts_sma_cn(b.close, 9, 1)), want, atol=1e-9)


def test_cross_section_rank(panel):
    want = panel[1].groupby("date")["volume"].rank(pct=True)
    np.testing.assert_allclose(run(panel, lambda b: f.cs_rank(b.volume)), want, atol=1e-12)


def test_stages_share_shuffles(spark, panel):
    b = f.Book()
    made = b.frame(panel[0], {f"a{i}": f.cs_rank(f.ts_mean(b.close, i)) for i in range(2, 8)})
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4  # twice in the text of an adaptive plan


def test_all_formulas_share_few_shuffles(spark, panel):
    b = f.Book()
    own = alphas.alphas(b, list(range(1, 102)))
    rows = panel[0].selectExpr("*", "close as open", "close as high", "close as low", "close as vwap", "close as cap")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = b.frame(rows, own)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") <= 7 and len({at // f.PHASE for at in b.stages}) <= 7


def test_names_match_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"model_trades", "indicator_statuses"}


def test_shown_values(spark):
    """Nothing turns null or is off by more than nine digits, and both engines show the same doubles."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(5)
    x = [0.0, -0.0, 1e-12, -0.1234567891234, 0.5, 1.0, 2641.86245, -6801.601125, 1e9, 1e30, -9.453440770716568e71, 9.833551094917522e303, 1.7e308, float("inf"), float("-inf"), None]
    x += [float(v) for v in rng.normal(size=500) * 10.0 ** rng.integers(-12, 300, 500)]
    rows = pd.DataFrame({"i": range(len(x)), "x": x})
    got = [r["y"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").selectExpr("i", f"{shown('x')} AS y").orderBy("i").collect()]
    con = duckdb.connect()
    con.register("rows", rows)
    own = [r[0] for r in con.execute(f"SELECT {shown('x')} FROM (SELECT i, CASE WHEN i <> 15 THEN x END AS x FROM rows) ORDER BY i").fetchall()]
    assert [repr(v) for v in got] == [repr(v) for v in own]
    assert got[15] is None and got[13:15] == [float("inf"), float("-inf")] and str(got[1]) == "0.0"
    for v, y in zip(x, got):
        if v is not None and np.isfinite(v):
            assert abs(v - y) <= max(1e-9, abs(v) * 2e-9)


def test_deviations_take_the_same_steps_in_both_engines(spark):
    """Values that differ in their last digits only: what is left of them after subtraction depends on each step."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"code": np.repeat(np.arange(10), 40), "seq": np.tile(np.arange(1, 41), 10), "sector": "a"})
    rows["date"] = rows["seq"]
    rows["x"], rows["y"] = 1e5 * (1 + 10.0 ** rng.integers(-9, -3, 400) * rng.normal(size=400)), rng.normal(size=400) * 1e4 + 2e4
    b = f.Book()
    made = {f"{k}{w}": e for w in (2, 5, 12) for k, e in {"r": f.ts_corr(b.x, b.y, w), "q": f.ts_corr(b.y, b.x, w), "c": f.ts_cov(b.x, b.y, w), "s": f.ts_std(b.x, w), "v": f.ts_var(b.x, w)}.items()}
    got = b.frame(spark.createDataFrame(rows), made).toPandas().sort_values(["code", "date"])
    con = duckdb.connect()
    con.register("rows", rows)
    want = con.execute(b.sql("SELECT * FROM rows", made)).df().sort_values(["code", "date"])
    for n in made:
        np.testing.assert_array_equal(got[n].to_numpy(float), want[n].to_numpy(float), err_msg=n)
