"""Registered jobs on data sets, replay, hygiene, selection, corpora and profiles, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import factors as f
from ..functions.shown import shown
from ..operators import corpus, dataset, hygiene, profiles, replay, selection
from ..sources.bars import bars, bars_sql
from ..sources.written import written


def _shown(df: DataFrame) -> DataFrame:
    """Doubles to nine digits, dates as text."""
    cols = []
    for c, t in df.dtypes:
        if t == "double":
            cols.append(F.expr(shown(f"`{c}`")).alias(c))
        elif t == "date":
            cols.append(F.col(c).cast("string").alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dataset.dataset(bars(spark, sf_dir))
    names = [c for c in made.columns if c.startswith("feat_")]
    return _shown(made.select("code", "date", *names, F.col("target").cast("long").alias("target"), "split"))


def _training_sql() -> str:
    w = "(PARTITION BY code ORDER BY date)"

    def frame(n: int) -> str:
        return f"(PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    def full(x: str, agg: str, n: int) -> str:
        return f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {agg}({x}) OVER {frame(n)} END"

    ret = ", ".join(f"close / nullif(lag(close, {n}) OVER {w}, 0) - 1 AS feat_ret_{n}" for n in (1, 5, 20))
    gap = ", ".join(f"close / nullif({full('close', 'avg', n)}, 0) - 1 AS feat_ma{n}_gap" for n in (5, 20, 60))
    names = ["feat_ret_1", "feat_ret_5", "feat_ret_20", "feat_ma5_gap", "feat_ma20_gap", "feat_ma60_gap", "feat_vol_ratio", "feat_vol_20", "feat_rsi_14"]
    return f"""
WITH a AS (
  SELECT *, {ret}, {gap}, volume / nullif({full('volume', 'avg', 20)}, 0) AS feat_vol_ratio, close - lag(close, 1) OVER {w} AS d,
         coalesce(lead(close, 5) OVER {w} > close, false)::INT::BIGINT AS target, count(*) OVER (PARTITION BY code) - row_number() OVER {w} AS rest
  FROM ({bars_sql(duck=True)})),
g AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS down FROM a),
b AS (
  SELECT *, {full('feat_ret_1', 'stddev_samp', 20)} AS feat_vol_20,
         100 - 100 / nullif(1 + ({full('up', 'avg', 14)}) / nullif({full('down', 'avg', 14)}, 0), 0) AS feat_rsi_14 FROM g),
c AS (SELECT * FROM b WHERE rest >= 5 AND {' AND '.join(f'{n} IS NOT NULL' for n in names)}),
q AS (SELECT code, quantile_cont(date_diff('day', DATE '1970-01-01', date)::DOUBLE, 0.8) AS border FROM c GROUP BY code),
s AS (SELECT c.*, CASE WHEN date_diff('day', DATE '1970-01-01', date) < border THEN 'train' ELSE 'test' END AS split FROM c JOIN q USING (code))
SELECT code, CAST(date AS VARCHAR) AS date, {', '.join(f'{shown(n)} AS {n}' for n in names)}, target, split
FROM s WHERE code IN (SELECT code FROM s GROUP BY code HAVING count(DISTINCT split) = 2)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bars(spark, sf_dir).select("code", "date", "open", "close")
    a = rows.withColumns({"run_id": F.lit("ma_cross"), "action": replay.ma_cross()})
    b = rows.withColumns({"run_id": F.lit("hold"), "action": replay.buy_and_hold()})
    return a.unionByName(b)


def replay_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(replay.fills(_runs(spark, sf_dir)))


def replay_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    trades = written(replay.fills(runs), "trades")  # read for the curve and for the counts
    return _shown(replay.metrics(replay.equity(runs, trades), trades))


_TRADES = f"""
WITH RECURSIVE bars AS ({bars_sql(duck=True)}),
sig AS (
  SELECT code, date, seq, open, close, 'ma_cross' AS run_id,
         CASE WHEN seq >= 6 AND avg(close) OVER s > avg(close) OVER l THEN 'BUY' WHEN seq >= 6 AND avg(close) OVER s < avg(close) OVER l THEN 'SELL' ELSE 'HOLD' END AS action
  FROM bars WINDOW s AS (PARTITION BY code ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), l AS (PARTITION BY code ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
  UNION ALL SELECT code, date, seq, open, close, 'hold', CASE WHEN seq = 1 THEN 'BUY' ELSE 'HOLD' END FROM bars),
o AS (SELECT *, lag(action) OVER (PARTITION BY run_id, code ORDER BY date) AS act, coalesce(open, close) AS price FROM sig),
st(run_id, code, seq, date, close, did, price, qty, cash, shares, paid, pnl) AS (
  SELECT run_id, code, 1::BIGINT, date, close, NULL::VARCHAR, price, 0.0::DOUBLE, 10000000.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE FROM o WHERE seq = 1
  UNION ALL
  SELECT n.run_id, n.code, n.seq, n.date, n.close, n.did, n.price,
         CASE n.did WHEN 'BUY' THEN n.k WHEN 'SELL' THEN n.shares ELSE 0 END,
         CASE n.did WHEN 'BUY' THEN n.cash - n.k * n.price * 1.00015::DOUBLE WHEN 'SELL' THEN n.cash + n.shares * n.price * 0.99985::DOUBLE ELSE n.cash END,
         CASE n.did WHEN 'BUY' THEN n.k WHEN 'SELL' THEN 0 ELSE n.shares END,
         CASE n.did WHEN 'BUY' THEN n.k * n.price * 1.00015::DOUBLE ELSE n.paid END,
         CASE n.did WHEN 'SELL' THEN n.shares * n.price * 0.99985::DOUBLE - n.paid END
  FROM (
    SELECT o.run_id, o.code, o.seq, o.date, o.close, o.price, st.cash, st.shares, st.paid, floor(st.cash / (o.price * 1.00015::DOUBLE)) AS k,
           CASE WHEN o.act = 'BUY' AND st.shares = 0 AND floor(st.cash / (o.price * 1.00015::DOUBLE)) > 0 THEN 'BUY' WHEN o.act = 'SELL' AND st.shares > 0 THEN 'SELL' END AS did
    FROM o JOIN st ON o.run_id = st.run_id AND o.code = st.code AND o.seq = st.seq + 1) n)
"""

_TRADES_SQL = _TRADES + f"""
SELECT run_id, code, CAST(date AS VARCHAR) AS date, did AS action, {shown('price')} AS price, {shown('qty')} AS qty, {shown('pnl')} AS pnl, {shown('cash')} AS cash, {shown('shares')} AS shares
FROM st WHERE did IS NOT NULL"""

_METRICS_SQL = _TRADES + f""",
e AS (SELECT *, cash + shares * close AS eq FROM st),
r AS (SELECT *, max(eq) OVER (PARTITION BY run_id, code ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak, eq / lag(eq) OVER (PARTITION BY run_id, code ORDER BY seq) - 1 AS step FROM e),
m AS (
  SELECT run_id, code, count(*) AS n, arg_max(eq, seq) / arg_min(eq, seq) - 1 AS tr, max((peak - eq) / peak) AS dd, avg(step) AS a, stddev_samp(step) AS s,
         count(did) AS k, avg(CASE WHEN did = 'SELL' THEN (pnl > 0)::INT END) AS won FROM r GROUP BY 1, 2)
SELECT run_id, code, {shown('CASE WHEN n < 2 THEN 0 ELSE tr END')} AS total_return, {shown('CASE WHEN n < 2 THEN 0 ELSE dd END')} AS mdd,
       {shown('CASE WHEN n < 3 OR s = 0 THEN 0 ELSE a / s * sqrt(252) END')} AS sharpe, k AS n_trades, {shown('coalesce(won, 0)')} AS win_rate FROM m"""


def _signals() -> tuple[f.Book, dict[str, f.Ex]]:
    b = f.Book()
    own = {"momentum": f.cs_rank(f.ts_returns(b.close, 20)), "calm": -f.ts_std(f.ts_returns(b.close, 1), 20), "constant": b.close * 0 + 1, "neutral": f.grp_demean(f.ts_returns(b.close, 5))}
    return b, own


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals as rows; checks read them several times, so the factors are written once."""
    b, own = _signals()
    wide = written(b.frame(bars(spark, sf_dir), own, ["code", "date", "sector"]), "signals")
    return wide.select("code", "date", "sector", F.explode(F.create_map(*[x for n in own for x in (F.lit(n), F.col(n))])).alias("factor_id", "value"))


def _long_sql() -> str:
    b, own = _signals()
    each = " UNION ALL ".join(f"SELECT code, date, sector, '{n}' AS factor_id, {n} AS value FROM wide" for n in own)
    return f"WITH wide AS ({b.sql(bars_sql(duck=True), own, ['code', 'date', 'sector'])}), x AS ({each})"


def hygiene_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = hygiene.checks(_long(spark, sf_dir))
    return _shown(made.select("factor_id", "valid_ratio", "n_valid", "inf_ratio", "infinite", "std", "date_std", "mode_share", "undecidable", "sparse", "constant", "no_cross_section", "degenerate", "bounded", "rank_range"))


def hygiene_neutrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By date and sector, and by date alone."""
    rows = _long(spark, sf_dir).where("value is not null")
    both = [hygiene.neutrality(rows, by).withColumn("level", F.lit("_".join(by))) for by in (["date", "sector"], ["date"])]
    return _shown(both[0].unionByName(both[1]))


def _checks_sql() -> str:
    return _long_sql() + f"""
, w AS (SELECT factor_id, count(value)::DOUBLE / count(*) AS valid_ratio, count(value) AS n_valid, coalesce(avg(CASE WHEN abs(value) = 'inf'::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE value IS NOT NULL), 0) AS inf_ratio, stddev_samp(value) AS std, avg(abs(value)) AS ma, min(value) AS lo, max(value) AS hi FROM x GROUP BY 1),
p AS (SELECT factor_id, avg(s) AS date_std FROM (SELECT factor_id, date, stddev_samp(value) AS s FROM x GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT factor_id, max(c)::DOUBLE / sum(c) AS mode_share FROM (SELECT factor_id, round(value, 10) AS r, count(*) AS c FROM x WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT factor_id, {shown('valid_ratio')} AS valid_ratio, n_valid, {shown('inf_ratio')} AS inf_ratio, inf_ratio > 0.01 AS infinite, {shown('std')} AS std, {shown('date_std')} AS date_std, {shown('mode_share')} AS mode_share, n_valid < 50 AS undecidable,
       valid_ratio < 0.3 AS sparse, std < 1e-9 * (1 + ma) AS constant, date_std < greatest(1e-12, 1e-6 * std) AS no_cross_section, mode_share > 0.9 AS degenerate,
       greatest(abs(lo), abs(hi)) < 1e6 AS bounded, lo >= -1 AND hi <= 1 AND (lo >= 0 OR hi <= 0) AS rank_range
FROM w JOIN p USING (factor_id) JOIN m USING (factor_id)"""


def _neutrality_sql() -> str:
    return _long_sql() + f"""
, g AS (SELECT factor_id, 'date_sector' AS level, avg(value) AS m, sum(abs(value)) AS s, count(value) AS n FROM x WHERE value IS NOT NULL GROUP BY factor_id, date, sector
  UNION ALL SELECT factor_id, 'date', avg(value), sum(abs(value)), count(value) FROM x WHERE value IS NOT NULL GROUP BY factor_id, date),
r AS (SELECT factor_id, level, avg(abs(m)) / (sum(s) / sum(n)) AS ratio FROM g GROUP BY 1, 2)
SELECT factor_id, level, {shown('ratio')} AS ratio, ratio < 0.01 AS neutral FROM r"""


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, own = _signals()
    refs = hygiene.references(b)
    wide = written(b.frame(bars(spark, sf_dir), own | refs), "signals")
    made = hygiene.fingerprint_wide(wide, list(own))
    return made.select("factor_id", *[F.round(n, 6).alias(n) for n in hygiene.REFERENCES], F.col("best.name").alias("best"))


def _fingerprints_sql() -> str:
    b = f.Book()
    refs = hygiene.references(b)
    table = b.sql(bars_sql(duck=True), refs)

    def corr(n: str) -> str:
        u, v = f"CASE WHEN {n} IS NOT NULL THEN value END", n
        return f"CASE WHEN count({v}) > 50 AND max({u}) > min({u}) AND max({v}) > min({v}) THEN covar_samp({u}, {v}) / nullif(stddev_samp({u}) * stddev_samp({v}), 0) END AS {n}"

    each = ", ".join(f"CASE WHEN abs({n}) >= {hygiene.MATCH} THEN struct_pack(s := abs({n}), n := '{n}') END" for n in hygiene.REFERENCES)
    return _long_sql() + f""", t AS ({table}),
c AS (SELECT factor_id, {', '.join(corr(n) for n in hygiene.REFERENCES)} FROM x JOIN t USING (code, date) WHERE value IS NOT NULL GROUP BY 1)
SELECT factor_id, {', '.join(f'round({n}, 6) AS {n}' for n in hygiene.REFERENCES)}, list_max([{each}]).n AS best FROM c"""


def top_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = f.Book()
    made = b.frame(bars(spark, sf_dir), {"signal": f.ts_returns(b.close, 3), "cap": b.cap})
    picked = selection.weighted(selection.top_bottom_n(selection.top_n_by(made, "cap", 50), "signal", 10), "rank", "signal")
    out = selection.rebalanced(picked.select("date", "code", "signal", "side", "weight"), made, "quarter")
    return _shown(out.select("code", "date", "signal", F.col("side").cast("long").alias("side"), "weight"))


def _top_bottom_sql() -> str:
    b = f.Book()
    made = b.sql(bars_sql(duck=True), {"signal": f.ts_returns(b.close, 3), "cap": b.cap})
    return f"""
WITH a AS ({made}),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY cap DESC NULLS LAST, code) AS r FROM a) WHERE r <= 50 AND cap IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY signal DESC, code) AS d, row_number() OVER (PARTITION BY date ORDER BY signal, code DESC) AS p FROM u WHERE signal IS NOT NULL),
k AS (SELECT *, CASE WHEN d <= 10 THEN 1 ELSE -1 END AS side FROM s WHERE d <= 10 OR p <= 10),
w AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY signal, code DESC) AS q FROM k),
v AS (SELECT *, q::DOUBLE / sum(q) OVER (PARTITION BY date) AS weight FROM w),
f AS (SELECT date_trunc('quarter', date) AS period, min(date) AS start FROM a GROUP BY 1)
SELECT a.code, CAST(a.date AS VARCHAR) AS date, {shown('v.signal')} AS signal, v.side::BIGINT AS side, {shown('v.weight')} AS weight
FROM a JOIN f ON f.period = date_trunc('quarter', a.date) JOIN v ON v.date = f.start AND v.code = a.code"""


def _formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("source").alias("corpus"), F.col("doc_id").alias("alpha_id"), F.md5("text").alias("hash"), F.split("text", " ").alias("ops"))


def corpus_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_by_hash(_formulas(spark, sf_dir).drop("ops"))


def corpus_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(corpus.census(_formulas(spark, sf_dir)))


_UNIQUE_SQL = "SELECT arg_min(source, row(source, doc_id)) AS corpus, arg_min(doc_id, row(source, doc_id)) AS alpha_id, md5(text) AS hash FROM documents GROUP BY md5(text)"
_CENSUS_SQL = f"""
WITH c AS (SELECT op, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS op FROM documents) GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS total FROM c)
SELECT op, n, {shown('n / total')} AS share, {shown('sum(n) OVER (ORDER BY n DESC, op ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / total')} AS cumulative FROM t"""


def profile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").alias("user"),
        "turn",
        (F.col("role") == "user").alias("is_relevant"),
        F.when(size % 5 != 0, F.concat(F.lit("size_"), (size % 3).cast("string"))).alias("company_size"),
        F.when(size % 7 != 0, (size % 4) / 4).alias("company_size_confidence"),
        F.array(F.concat(F.lit("s"), (size % 6).cast("string"))).alias("sectors"),
    )
    out = profiles.merged(turns, {"company_size": "company_size_confidence"}, ("sectors",))
    return out.select("user", "company_size", "company_size_confidence", F.array_join("sectors", ",").alias("sectors"))


_PROFILE_SQL = """
WITH t AS (
  SELECT conv_id AS u, turn, CASE WHEN length(text) % 5 <> 0 THEN 'size_' || (length(text) % 3) END AS v,
         coalesce(CASE WHEN length(text) % 7 <> 0 THEN (length(text) % 4) / 4 END, 0.0)::DOUBLE AS c, 's' || (length(text) % 6) AS s
  FROM conversations WHERE coalesce(role = 'user', true))
SELECT u AS "user", arg_max(v, row(c, turn)) FILTER (WHERE v IS NOT NULL) AS company_size, max(c) FILTER (WHERE v IS NOT NULL) AS company_size_confidence,
       array_to_string(list_sort(list_distinct(list(s))), ',') AS sectors FROM t GROUP BY u"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (training_rows, replay_trades, replay_metrics, hygiene_checks, hygiene_neutrality, fingerprints, top_bottom, corpus_unique, corpus_census, profile_merge)
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    return {
        "training_rows": _training_sql(),
        "replay_trades": _TRADES_SQL,
        "replay_metrics": _METRICS_SQL,
        "hygiene_checks": _checks_sql(),
        "hygiene_neutrality": _neutrality_sql(),
        "fingerprints": _fingerprints_sql(),
        "top_bottom": _top_bottom_sql(),
        "corpus_unique": _UNIQUE_SQL,
        "corpus_census": _CENSUS_SQL,
        "profile_merge": _PROFILE_SQL,
    }
