"""Panels of extreme shapes: few codes with long histories, and few dates with many codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import factors as f
from ..functions.panels import numbered
from ..functions.shown import shown
from ..operators import ingest, replay
from ..sources.bars import bars_sql
from ..sources.written import written
from .indicators import indicators

#: Rows of a chunk of a long history. Its halo is as deep as the windows; chunks far above that waste little.
CHUNK = 1024


def _minutes(duck: bool) -> str:
    """A bar a kind of event and minute."""
    first, last, pack = ("arg_min", "arg_max", "row") if duck else ("min_by", "max_by", "struct")
    key = f"{pack}(ts, event_id)"
    return f"""
SELECT event_type AS code, date_trunc('minute', ts) AS date, {first}(value + 1000, {key}) AS open, {last}(value + 1000, {key}) AS close, max(value + 1000) AS high, min(value + 1000) AS low,
       CAST(count(*) AS DOUBLE) AS volume, sum(value + 1000) / count(*) AS vwap, CAST(NULL AS VARCHAR(9)) AS sector, {last}(value, {key}) * 1000 AS cap
FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2"""


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _minutes(False).replace("FROM events", "FROM {events}")
    return numbered(spark.sql(text, events=spark.read.parquet(f"{sf_dir}/events.parquet")), "day")


def _years(duck: bool) -> str:
    """A bar a customer and year."""
    first, last, pack = ("arg_min", "arg_max", "row") if duck else ("min_by", "max_by", "struct")
    key = f"{pack}(o_orderdate, o_orderkey, o_totalprice)"
    bars = f"""
SELECT o_custkey AS code, CAST(date_trunc('year', o_orderdate) AS DATE) AS date, {first}(o_totalprice, {key}) AS open, {last}(o_totalprice, {key}) AS close, max(o_totalprice) AS high,
       min(o_totalprice) AS low, CAST(count(*) AS DOUBLE) AS volume, sum(o_totalprice) / count(*) AS vwap, CASE WHEN o_custkey % 11 <> 0 THEN concat('s', o_custkey % 5) END AS sector
FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY o_custkey, CAST(date_trunc('year', o_orderdate) AS DATE)"""
    return f"SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS seq, close * 1000 AS cap FROM ({bars}) b"


def _over_time(b: f.Book) -> dict[str, f.Ex]:
    c, v, r = b.close, b.volume, f.ts_returns(b.close, 1)
    own = indicators(b, ["rsi", "macd_signal", "stoch_d", "obv", "linearreg_slope"])
    return own | {
        "lead": f.ts_delay(c, -2), "std": f.ts_std(r, 30), "rank": f.ts_rank(c, 20), "median": f.ts_median(c, 15), "argmax": f.ts_argmax(c, 60), "decay": f.ts_decay_linear(c, 12),
        "corr": f.ts_corr(c, v, 30), "deep": f.ts_mean(f.ts_max(f.ts_delta(c, 60), 30), 10), "cumsum": f.ts_cumsum(v), "cumprod": f.ts_cumprod(1 + c / 1e6), "traded": b.adv30,
    }


def _across(b: f.Book) -> dict[str, f.Ex]:
    c, v, g = b.close, b.volume, f.ts_returns(b.close, 1)
    return {
        "c_rank": f.cs_rank(c), "c_ties": f.cs_rank(v), "c_scale": f.cs_scale(g), "c_mean": f.cs_mean(g), "c_std": f.cs_std(c), "c_median": f.cs_median(g),
        "g_mean": f.grp_mean(c), "g_demean": f.grp_demean(g), "g_rank": f.grp_rank(v), "c_nested": f.cs_rank(f.ts_mean(f.cs_rank(g), 3)), "g_nested": f.grp_rank(f.cs_rank(c)),
    }


def long_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators over time on minute bars of few codes, in chunks."""
    b = f.Book()
    own = _over_time(b)
    made = b.frame(minute_bars(spark, sf_dir), own, ["code", "date", "seq"], chunk=CHUNK)
    return made.select("code", "seq", F.minute("date").cast("long").alias("minute"), *[F.expr(shown(n)).alias(n) for n in own])


def _long_sql() -> str:
    b = f.Book()
    rows = f"SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS seq FROM ({_minutes(True)})"
    return b.sql(rows, _over_time(b), ["code", "seq", "minute(date) AS minute"], shown)


def wide_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators across codes on yearly bars of many codes, in buckets of near values."""
    b = f.Book()
    own = _across(b)
    text = _years(False).replace("FROM orders", "FROM {orders}")
    made = b.frame(spark.sql(text, orders=spark.read.parquet(f"{sf_dir}/orders.parquet")), own, wide=True)
    return made.select("code", F.col("date").cast("string").alias("date"), *[F.expr(shown(n)).alias(n) for n in own])


def _wide_sql() -> str:
    b = f.Book()
    return b.sql(_years(True), _across(b), ["code", "CAST(date AS VARCHAR) AS date"], shown)


def minute_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossing means against holding on minute bars: the signal in chunks, the trades folded over the orders that can fill."""
    b = f.Book()
    rows = b.frame(minute_bars(spark, sf_dir), {"short": f.ts_mean(b.close, 3), "long": f.ts_mean(b.close, 6)}, ["code", "date", "seq", "open", "close"], chunk=CHUNK)
    ready = F.col("seq") >= 6
    rows = rows.withColumns({c: F.round(c, 9) for c in ("short", "long")})  # equal means are equal in any engine
    cross = F.when(ready & (F.col("short") > F.col("long")), "BUY").when(ready & (F.col("short") < F.col("long")), "SELL").otherwise("HOLD")
    rows = rows.select("code", "date", "open", "close", F.explode(F.array(*[F.struct(F.lit(n).alias("run_id"), a.alias("action")) for n, a in (("ma_cross", cross), ("hold", F.when(F.col("seq") == 1, "BUY").otherwise("HOLD")))])).alias("r"))
    runs = written(rows.select("code", "date", "open", "close", "r.*"), "runs")
    trades = written(replay.fills(runs), "trades")
    made = replay.metrics(replay.equity(runs, trades), trades)
    return made.select("run_id", "code", *[F.expr(shown(c)).alias(c) for c in ("total_return", "mdd", "sharpe")], "n_trades", F.expr(shown("win_rate")).alias("win_rate"))


def _replay_sql(monthly: str) -> str:
    """The replay of monthly bars over minute bars instead."""
    minutes = f"SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS seq FROM ({_minutes(True)})"
    assert bars_sql(duck=True) in monthly
    return monthly.replace(bars_sql(duck=True), minutes).replace("avg(close) OVER s", "round(avg(close) OVER s, 9)").replace("avg(close) OVER l", "round(avg(close) OVER l, 9)")


def _lines(duck: bool) -> str:
    """Raw bars as they may come: a line a sale, with several a day, reversed ranges and negative volumes."""
    return """
SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS close, CAST(l_extendedprice AS DOUBLE) AS high,
       CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) + CASE WHEN l_partkey % 50 = 0 THEN 1e6 ELSE 0 END AS low, CAST(l_quantity AS DOUBLE) - 2 AS volume
FROM lineitem WHERE l_quantity > 0"""


def ingest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the panel and of each reason for rejection by code."""
    text = _lines(False).replace("FROM lineitem", "FROM {lineitem}")
    panel, rejects = ingest.gate(spark.sql(text, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet")))
    good = panel.groupBy("code").agg(F.count("*").alias("n"), F.sum("volume").alias("volume")).withColumn("reason", F.lit("kept"))
    bad = rejects.groupBy("code", "reason").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("volume")).alias("volume"))
    return good.unionByName(bad)


def _gate_sql() -> str:
    return f"""
WITH r AS ({_lines(True)}),
j AS (SELECT *, CASE WHEN code IS NULL OR date IS NULL THEN 'no key' WHEN high < low THEN 'high below low' WHEN high <= 0 THEN 'high not positive' WHEN low <= 0 THEN 'low not positive' WHEN close <= 0 THEN 'close not positive' WHEN volume < 0 THEN 'negative volume' END AS reason FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY code, date ORDER BY close, high, low, volume) AS i FROM j WHERE reason IS NULL),
a AS (SELECT code, volume, CASE WHEN i = 1 THEN 'kept' ELSE 'repeated key' END AS reason FROM k UNION ALL SELECT code, volume, reason FROM j WHERE reason IS NOT NULL)
SELECT code, reason, count(*) AS n, sum(volume) AS volume FROM a GROUP BY 1, 2"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"long_histories": long_histories, "wide_dates": wide_dates, "minute_replay": minute_replay, "ingest_gate": ingest_gate}


def oracle_sql(replay_metrics: str) -> dict[str, str]:
    return {"minute_replay": _replay_sql(replay_metrics), "long_histories": _long_sql(), "wide_dates": _wide_sql(), "ingest_gate": _gate_sql()}
