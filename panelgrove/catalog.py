"""All registered queries of the factor jobs, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import factors as f
from .functions.shown import shown
from .plans import alphas, indicators, jobs, panels, reconcile, studies
from .sources.bars import bars, bars_sql

def _elementwise(b: f.Book) -> dict[str, f.Ex]:
    x, y = b.close - b.open, b.vwap - b.close
    return {
        "e_add": x + y, "e_sub": x - y, "e_mul": x * y, "e_div": x / y, "e_pow": f.signedpower(x / b.close, 2.0),
        "e_signedpower": f.signedpower(y / b.close, 3.0), "e_neg": -x, "e_abs": f.absolute(x), "e_log": f.log(b.volume),
        "e_log1p": f.log1p(x / b.close), "e_sqrt": f.sqrt(x), "e_exp": f.exp(x / b.close), "e_sign": f.sign(x),
        "e_min": f.smaller(x, y), "e_max": f.larger(x, y), "e_where": f.where(x, b.high, b.low), "e_lt": x < y, "e_gt": x > y,
        "e_le": x <= y, "e_ge": x >= y, "e_eq": b.high == b.low, "e_ne": b.high != b.low, "e_or": x | y, "e_and": x & y,
    }


def _time_series(b: f.Book) -> dict[str, f.Ex]:
    c, v = b.close, b.volume
    return {
        "t_delay": f.ts_delay(c, 3), "t_lead": f.ts_delay(c, -2), "t_delta": f.ts_delta(c, 5), "t_returns": f.ts_returns(c, 5), "t_mean": f.ts_mean(c, 7),
        "t_std": f.ts_std(c, 7), "t_var": f.ts_var(v, 7), "t_sum": f.ts_sum(v, 7), "t_min": f.ts_min(c, 7), "t_max": f.ts_max(c, 7),
        "t_median": f.ts_median(c, 7), "t_skew": f.ts_skew(v, 7), "t_rank": f.ts_rank(c, 7), "t_product": f.ts_product(1 + f.ts_returns(c, 1) / 100, 5),
        "t_argmax": f.ts_argmax(c, 7), "t_argmin": f.ts_argmin(c, 7), "t_slope": f.ts_slope(c, 7), "t_rsquare": f.ts_rsquare(c, 7), "t_resi": f.ts_resi(c, 7),
        "t_cumsum": f.ts_cumsum(v), "t_cumprod": f.ts_cumprod(1 + f.ts_returns(c, 1) / 1000), "t_decay_linear": f.ts_decay_linear(c, 7),
        "t_ewm": f.ts_ewm(c, 9), "t_sma_cn": f.ts_sma_cn(c, 9, 2), "t_quantile": f.ts_quantile(c, 7, 0.8), "t_corr": f.ts_corr(c, v, 7),
        "t_cov": f.ts_cov(c, v, 7), "t_adv20": b.adv20,
    }


def _cross_section(b: f.Book) -> dict[str, f.Ex]:
    x = f.ts_returns(b.close, 1)
    return {
        "c_rank": f.cs_rank(x), "c_scale": f.cs_scale(x), "c_mean": f.cs_mean(x), "c_std": f.cs_std(x), "c_median": f.cs_median(x),
        "g_demean": f.grp_demean(x), "g_mean": f.grp_mean(x), "g_rank": f.grp_rank(x),
    }


#: Late listings, as in real panels: every tenth code has no prices before 1996, but its rows.
_LATE = "CASE WHEN NOT (code % 10 = 0 AND date < DATE '1996-01-01') THEN {c} END AS {c}"
PRICES = ("open", "close", "high", "low", "volume", "vwap", "cap")


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("code", "date", "seq", "sector", *[F.expr(_LATE.format(c=c)) for c in PRICES])


def _panel_sql() -> str:
    return f"SELECT code, date, seq, sector, {', '.join(_LATE.format(c=c) for c in PRICES)} FROM ({bars_sql(duck=True)})"


def _book_query(make: Callable[[f.Book], dict[str, f.Ex]]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = f.Book()
        outputs = make(b)
        made = b.frame(_panel(spark, sf_dir), outputs)
        return made.select("code", F.col("date").cast("string").alias("date"), *[F.expr(shown(n)).alias(n) for n in outputs])

    return query


def _book_sql(make: Callable[[f.Book], dict[str, f.Ex]]) -> str:
    b = f.Book()
    outputs = make(b)
    return b.sql(_panel_sql(), outputs, ["code", "CAST(date AS VARCHAR) AS date"], shown)


def _books() -> dict[str, Callable[[f.Book], dict[str, f.Ex]]]:
    made = {"elementwise": _elementwise, "time_series": _time_series, "cross_section": _cross_section}
    made |= {q: (lambda b, q=q: {"value": indicators.composed(b, q)}) for q in indicators.COMPOSED}
    for i in range(0, len(indicators.NAMES), 8):
        part = indicators.NAMES[i : i + 8]
        made[f"indicators_{part[0]}_to_{part[-1]}"] = lambda b, part=part: indicators.indicators(b, part)
    for i in range(1, 102, 10):
        part = list(range(i, min(i + 10, 102)))
        made[f"alphas_{part[0]:03d}_to_{part[-1]:03d}"] = lambda b, part=part: alphas.alphas(b, part)
    return made


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _book_query(make) for n, make in _books().items()} | jobs.queries() | studies.queries() | panels.queries() | {"indicator_statuses": reconcile.indicator_statuses}


def oracle_sql() -> dict[str, str]:
    own = jobs.oracle_sql()
    return {n: _book_sql(make) for n, make in _books().items()} | own | studies.oracle_sql(own["training_rows"]) | panels.oracle_sql(own["replay_metrics"])
