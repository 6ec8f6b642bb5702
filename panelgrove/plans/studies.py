"""More registered jobs with their SQL: parameters of profiles, label and signal checks by recomputation,
reconciliation, strategies, corpus tables and look-ups, models. The SQL is written by hand from what each
job is to give, not made from the job's own expressions, but for the factors it starts from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import factors as f
from ..functions.shown import shown
from ..operators import corpus, dataset, hygiene, lookup, models, profiles, replay, selection
from ..sources.bars import bars, bars_sql
from .indicators import indicators
from .jobs import _fingerprints_sql, _long, _shown

# Profiles.

_TURNS = """
SELECT conv_id AS user, turn, role = 'user' AS is_relevant, n, conv_id % 3 AS answer,
       CASE WHEN n % 5 <> 0 THEN concat('SIZE_', n % 3) END AS company_size_preference, CASE WHEN n % 7 <> 0 THEN CAST(n % 4 AS DOUBLE) / 4 END AS company_size_confidence,
       CASE n % 4 WHEN 0 THEN 'FUTURE_GROWTH_SECTOR' WHEN 1 THEN 'OTHER' END AS thematic_intent, CAST(n % 3 AS DOUBLE) / 4 AS thematic_intent_confidence,
       CASE WHEN n % 2 = 0 THEN CAST(n % 11 AS DOUBLE) / 10 END AS risk_tolerance_hint, CAST(n % 9 AS DOUBLE) / 8 AS risk_tolerance_confidence,
       CASE WHEN n % 6 = 0 THEN concat('s', n % 5) END AS sector, CASE WHEN n % 3 = 0 THEN concat('p', n % 7) END AS parameter, CAST(n % 5 AS DOUBLE) / 4 AS parameter_confidence
FROM (SELECT *, length(text) AS n FROM {conversations}) t"""
_SCALARS = {"company_size_preference": "company_size_confidence", "thematic_intent": "thematic_intent_confidence", "risk_tolerance_hint": "risk_tolerance_confidence"}


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_TURNS, conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    record = F.struct(F.col("parameter").alias("parameter_name"), F.lit("int").alias("dtype"), F.concat(F.col("n").cast("string"), F.lit(".7")).alias("value"), F.col("parameter_confidence").alias("confidence"))
    return rows.withColumns({"excluded_sectors": F.array_compact(F.array("sector")), "new_parameters": F.filter(F.array(record), lambda p: p["parameter_name"].isNotNull())})


def dynamic_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profiles.dynamic_parameters(_turns(spark, sf_dir), ("p3",))
    return out.select("user", "parameter_name", "first_turn", F.col("record.value").alias("value"), F.col("record.confidence").alias("confidence"))


def new_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profiles.new_names(_turns(spark, sf_dir), ("p3",))
    return out.select("user", F.col("turn").cast("long").alias("turn"), F.array_join("names", ",").alias("names"))


def trading_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    merged = profiles.merged(turns, _SCALARS, ("excluded_sectors",))
    dynamic = profiles.dynamic_parameters(turns, ("p3",)).groupBy("user").agg(F.collect_list("record").alias("dynamic"))
    answers = turns.groupBy("user").agg(F.min("answer").alias("a"))
    loss = F.element_at(F.array(*[F.lit(x) for x in profiles.LOSS_AVERSION]), F.col("a").cast("int") + 1)
    horizon = F.element_at(F.array(*[F.lit(x) for x in profiles.HOLDING_DAYS]), F.col("a").cast("int") + 1)
    rows = merged.join(dynamic, "user", "left").join(answers, "user").withColumns({"loss_feeling": loss, "time_horizon": horizon})
    out = profiles.trading_parameters(rows)
    plain = ["risk_tolerance", "loss_aversion", "min_confidence_to_act", "max_position_size_pct", "stop_loss_pct", "max_leverage"]
    share = F.col("portfolio_allocation")
    return _shown(
        out.select(
            "user", *plain, "time_horizon", F.col("min_holding_period_days").cast("long").alias("holding_days"),
            F.coalesce(F.try_element_at(share, F.lit("GROWTH_THEME_AUTO")), F.lit(0.0)).alias("theme_share"), F.coalesce(F.try_element_at(share, F.lit("UNRESTRICTED")), F.lit(0.0)).alias("free_share"),
            F.array_join("excluded_sectors", ",").alias("excluded"), *[F.element_at("agent_weights", F.lit(n)).alias(n.lower()) for n in ("HFT", "ML", "LLM")],
            F.coalesce(F.aggregate("extra_constraints", F.lit(0.0), lambda a, x: a + x["value"]["as_number"]), F.lit(0.0)).alias("constraints_sum"),
        )
    )


def _turns_sql() -> str:
    return f"WITH t AS ({_TURNS.format(conversations='conversations').replace('AS user,', 'AS u,')}), r AS (SELECT * FROM t WHERE coalesce(is_relevant, true))"


_DYNAMIC = """dyn AS (
  SELECT u, parameter, min(turn) AS first_turn, arg_max(n, row(parameter_confidence, -turn)) AS n, max(parameter_confidence) AS confidence
  FROM r WHERE parameter IS NOT NULL AND parameter <> 'p3' GROUP BY 1, 2)"""


def _dynamic_sql() -> str:
    return f"{_turns_sql()}, {_DYNAMIC} SELECT u AS \"user\", parameter AS parameter_name, first_turn, n || '.7' AS value, confidence FROM dyn"


def _parameters_sql() -> str:
    def best(c: str, w: str) -> str:
        return f"arg_max({c}, row(coalesce({w}, 0), turn)) FILTER (WHERE {c} IS NOT NULL) AS {c}, max(coalesce({w}, 0)) FILTER (WHERE {c} IS NOT NULL) AS {w}"

    merged = ", ".join(best(c, w) for c, w in _SCALARS.items())
    return f"""{_turns_sql()}, {_DYNAMIC},
m AS (SELECT u, {merged}, coalesce(string_agg(DISTINCT sector, ',' ORDER BY sector), '') AS excluded FROM r GROUP BY u),
k AS (SELECT u, count(*) AS n, sum(n) AS s FROM dyn GROUP BY u), a AS (SELECT u, min(answer) AS a FROM t GROUP BY u),
x AS (
  SELECT m.*, coalesce(k.n, 0) AS k, coalesce(k.s, 0) AS s, CASE a WHEN 0 THEN 0.85 WHEN 1 THEN 0.5 ELSE 0.2 END::DOUBLE AS av, CASE a WHEN 0 THEN 'SHORT' WHEN 1 THEN 'MEDIUM' ELSE 'LONG' END AS h
  FROM m JOIN a USING (u) LEFT JOIN k USING (u)),
y AS (SELECT *, CASE WHEN risk_tolerance_hint IS NULL THEN 1 - av ELSE (1 - coalesce(risk_tolerance_confidence, 0)) * (1 - av) + coalesce(risk_tolerance_confidence, 0) * risk_tolerance_hint END AS risk,
  least(1, ((excluded <> '')::INT + (thematic_intent IS NOT NULL)::INT + k) / 4.0::DOUBLE) AS c FROM x),
z AS (SELECT *, CASE h WHEN 'SHORT' THEN 0.5 WHEN 'MEDIUM' THEN 0.15 ELSE 0.05 END::DOUBLE AS w1, 0.2 + 0.3 * greatest(0, least(1, risk)) AS w2, 0.2 + 0.3 * c AS w3 FROM y)
SELECT u AS "user", {shown('risk')} AS risk_tolerance, {shown('av')} AS loss_aversion, {shown('0.55 + 0.3 * av')} AS min_confidence_to_act,
       {shown('0.02 + 0.13 * greatest(0, least(1, risk))')} AS max_position_size_pct, {shown('0.02 + 0.08 * greatest(0, least(1, risk))')} AS stop_loss_pct,
       {shown('1 + 2 * greatest(0, least(1, risk))')} AS max_leverage, h AS time_horizon, CASE h WHEN 'SHORT' THEN 5 WHEN 'MEDIUM' THEN 180 ELSE 720 END::BIGINT AS holding_days,
       {shown("CASE WHEN thematic_intent = 'FUTURE_GROWTH_SECTOR' THEN CASE WHEN company_size_preference IS NULL THEN 1 ELSE 0.2 END ELSE 0 END::DOUBLE")} AS theme_share,
       (company_size_preference IS NULL AND coalesce(thematic_intent, '') <> 'FUTURE_GROWTH_SECTOR')::INT::DOUBLE AS free_share, excluded,
       {shown('w1 / (w1 + w2 + w3)')} AS hft, {shown('w2 / (w1 + w2 + w3)')} AS ml, {shown('w3 / (w1 + w2 + w3)')} AS llm, s::DOUBLE AS constraints_sum FROM z"""


# Labels and intents.

_LABELS = [("momentum", "mom20", 1, None), ("calm", "vol20", 1, None), ("neutral", None, 1, "reversal"), ("constant", "size", 1, None)]


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, b = bars(spark, sf_dir), f.Book()
    return hygiene.fingerprint(_long(spark, sf_dir).where("value is not null").drop("sector"), b.frame(rows, hygiene.references(b)))


def label_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.createDataFrame(_LABELS, "factor_id string, direction_ref string, direction_sign int, category string")
    prints = _prints(spark, sf_dir)
    top = hygiene.top_references(prints).select("factor_id", F.array_join(F.transform("top", lambda t: t["name"]), ",").alias("top"))
    out = hygiene.verify_labels(labels, prints).join(top, "factor_id", "left")
    return out.select("factor_id", "direction_ref", "direction_sign", "old_sign", "label_status", F.coalesce("top", F.lit("")).alias("top"))


def label_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.status_counts(label_checks(spark, sf_dir)).select("label_status", "n", F.round("trust_share", 9).alias("trust_share"))


def intent_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("momentum", "mom20", 1), ("calm", "vol20", -1), ("calm", "size", 1), ("neutral", "revers", 1), ("constant", "liq", 1)], "factor_id string, ref string, sign int")
    return hygiene.intents(wanted, _prints(spark, sf_dir)).withColumn("corr", F.round("corr", 6))


def _corrs_sql() -> str:
    names = hygiene.REFERENCES
    whole = _fingerprints_sql()
    raw = whole[: whole.rindex("SELECT factor_id, round(")]
    each = " UNION ALL ".join(f"SELECT factor_id, '{n}' AS ref, {n} AS corr FROM c" for n in names)
    return f"{raw}, e AS ({each})"


def _labels_sql() -> str:
    rows = ", ".join(f"('{a}', {'NULL' if (b or hygiene.CATEGORY_REFERENCES.get(c)) is None else repr(b or hygiene.CATEGORY_REFERENCES.get(c))}, {s})" for a, b, s, c in _LABELS)
    return f"""{_corrs_sql()}, l(factor_id, ref, sign) AS (VALUES {rows}),
best AS (SELECT factor_id, arg_max(ref, row(abs(corr), ref)) AS ref, arg_max(corr, row(abs(corr), ref)) AS corr FROM e WHERE abs(corr) >= 0.15 GROUP BY 1),
tops AS (SELECT factor_id, string_agg(ref, ',' ORDER BY abs(corr) DESC, ref) AS top FROM (SELECT *, row_number() OVER (PARTITION BY factor_id ORDER BY abs(corr) DESC, ref) AS r FROM e WHERE corr IS NOT NULL) WHERE r <= 3 GROUP BY 1),
j AS (SELECT l.*, e.corr, best.ref AS bref, best.corr AS bcorr, coalesce(top, '') AS top FROM l LEFT JOIN e ON e.factor_id = l.factor_id AND e.ref = l.ref LEFT JOIN best ON best.factor_id = l.factor_id LEFT JOIN tops ON tops.factor_id = l.factor_id),
s AS (SELECT *, CASE WHEN corr * sign > 0.15 THEN 'verified' WHEN abs(corr) >= 0.15 THEN 'verified_flipped' WHEN bref IS NOT NULL THEN 'reassigned' ELSE 'unverifiable' END AS st FROM j)"""


_LABEL_CHECKS_SQL = """
SELECT factor_id, CASE st WHEN 'reassigned' THEN bref ELSE ref END AS direction_ref, (CASE st WHEN 'verified_flipped' THEN -sign WHEN 'reassigned' THEN sign(bcorr) ELSE sign END)::INT AS direction_sign,
       sign AS old_sign, st AS label_status, top FROM s"""
_LABEL_COUNTS_SQL = ", n AS (SELECT st, count(*) AS n FROM s GROUP BY 1) SELECT st AS label_status, n, round(sum(CASE WHEN st <> 'unverifiable' THEN n ELSE 0 END) OVER () / sum(n) OVER (), 9)::DOUBLE AS trust_share FROM n"
_INTENTS_SQL = """, w(factor_id, ref, sign) AS (VALUES ('momentum', 'mom20', 1), ('calm', 'vol20', -1), ('calm', 'size', 1), ('neutral', 'revers', 1), ('constant', 'liq', 1))
SELECT factor_id, ref, sign, round(corr, 6) AS corr, corr * sign > 0.15 AS as_intended FROM w JOIN e USING (factor_id, ref)"""

# Checks by recomputation on changed panels.


def _tested(b: f.Book) -> dict[str, f.Ex]:
    return {"momentum": f.cs_rank(f.ts_returns(b.close, 20)), "peek": f.ts_delay(b.close, -2) / b.close, "level": b.close, "flow": f.ts_mean(b.volume, 5)}


def _values(panel: DataFrame) -> DataFrame:
    b = f.Book()
    own = _tested(b)
    return b.frame(panel, own).select("code", "date", F.explode(F.create_map(*[x for n in own for x in (F.lit(n), F.col(n))])).alias("factor_id", "value"))


def _values_sql(panel: str) -> str:
    b = f.Book()
    own = _tested(b)
    wide = b.sql(panel, own)
    return " UNION ALL ".join(f"SELECT code, date, '{n}' AS factor_id, {n} AS value FROM ({wide})" for n in own)


_NUMBERS = ("open", "close", "high", "low", "vwap", "cap", "volume")


def lookahead_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = bars(spark, sf_dir).select("code", "date", "seq", "sector", *_NUMBERS)
    dates = panel.select("date").distinct()  # one row a date: small whatever the panel
    cut = dates.withColumns({"r": F.row_number().over(Window.orderBy("date")), "n": F.count("*").over(Window.partitionBy())}).where("r = floor(0.6 * n) + 1").select(F.col("date").alias("cut"))
    factor = F.lit(0.5) + F.pmod(F.col("seq") * 7919 + F.col("code") * 104729, F.lit(1000)) / 1000
    later = panel.join(F.broadcast(cut))
    changed = later.select("code", "date", "seq", "sector", *[F.when(F.col("date") > F.col("cut"), F.col(c) * factor).otherwise(F.col(c)).alias(c) for c in _NUMBERS])
    return _shown(hygiene.drift(_values(panel), _values(changed), cut))


def _drift_sql() -> str:
    base = bars_sql(duck=True)
    cut = f"(SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM ({base}))) WHERE r = floor(0.6 * n) + 1)"
    moved = ", ".join(f"CASE WHEN date > {cut} THEN {c} * (0.5 + ((seq * 7919 + code * 104729) % 1000) / 1000) ELSE {c} END AS {c}" for c in _NUMBERS)
    return f"""
WITH a AS ({_values_sql(base)}), b AS ({_values_sql(f"SELECT code, date, seq, sector, {moved} FROM ({base})")}),
j AS (SELECT factor_id, a.value AS x, b.value AS y FROM a JOIN b USING (factor_id, date, code) WHERE a.value IS NOT NULL AND b.value IS NOT NULL AND date <= {cut}),
g AS (SELECT factor_id, count(*) AS n, CASE WHEN count(*) > 50 THEN avg(abs(x - y)) / (avg(abs(x)) + 1e-12) END AS d FROM j GROUP BY 1)
SELECT factor_id, n, {shown('d')} AS drift, d > 1e-6 AS looks_ahead FROM g"""


def scale_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = bars(spark, sf_dir).select("code", "date", "seq", "sector", *_NUMBERS)
    factor = F.lit(0.2) + F.pmod(F.col("code") * 7919, F.lit(480)) / 100
    scaled = panel.withColumns({c: F.col(c) * factor for c in _NUMBERS if c != "volume"})
    # Prices times a constant may differ in their last digit: values are compared to ten.
    a, b = (d.withColumn("value", F.round("value", 6)) for d in (_values(panel), _values(scaled)))
    out = hygiene.scale_invariance(a, b)
    return out.select("factor_id", "n", F.round("rho", 4).alias("rho"), "invariant")


def _scale_sql() -> str:
    base = bars_sql(duck=True)
    moved = ", ".join(c if c == "volume" else f"{c} * (0.2 + ((code * 7919) % 480) / 100) AS {c}" for c in _NUMBERS)
    return f"""
WITH a AS ({_values_sql(base)}), b AS ({_values_sql(f"SELECT code, date, seq, sector, {moved} FROM ({base})")}),
j AS (SELECT factor_id, round(a.value, 6) AS x, round(b.value, 6) AS y FROM a JOIN b USING (factor_id, date, code) WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
k AS (SELECT factor_id, rank() OVER (PARTITION BY factor_id ORDER BY x) + (count(*) OVER (PARTITION BY factor_id, x) - 1) / 2.0 AS p, rank() OVER (PARTITION BY factor_id ORDER BY y) + (count(*) OVER (PARTITION BY factor_id, y) - 1) / 2.0 AS q FROM j),
g AS (SELECT factor_id, count(*) AS n, covar_samp(p, q) / nullif(stddev_samp(p) * stddev_samp(q), 0) AS r FROM k GROUP BY 1)
SELECT factor_id, n, round(r, 4) AS rho, r >= 0.98 AS invariant FROM g"""


_RECONCILED = ("sma", "roc", "willr", "obv", "stddev")


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of the factor book against plain window functions."""
    panel, b = bars(spark, sf_dir), f.Book()
    got = b.frame(panel, indicators(b, list(_RECONCILED)))
    w = Window.partitionBy("code").orderBy("date")

    def over(n: int):
        return w.rowsBetween(1 - n, 0)

    step = F.col("close") - F.lag("close").over(w)
    plain = panel.withColumn("turn", F.signum(step) * F.col("volume")).select(
        "code",
        "date",
        (F.sum("close").over(over(20)) / F.count("close").over(over(20))).alias("sma"),
        (100 * (F.col("close") - F.lag("close", 10).over(w)) / F.lag("close", 10).over(w)).alias("roc"),
        F.try_divide(100 * (F.col("close") - F.max("high").over(over(14))), F.max("high").over(over(14)) - F.min("low").over(over(14))).alias("willr"),
        (F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1000).alias("obv"),
        F.stddev_pop("close").over(over(20)).alias("stddev"),
    )
    long = [d.select("code", "date", F.explode(F.create_map(*[x for n in _RECONCILED for x in (F.lit(n), F.col(n))])).alias("factor_id", "value")) for d in (got, plain)]
    out = hygiene.reconciled(long[0], long[1], panel, {"sma": 20, "roc": 20, "willr": 20, "obv": 20, "stddev": 20}, ("obv",))
    return out.select("factor_id", "n", (F.col("max_diff") < 1e-6).alias("close_by"), F.round("corr", 6).alias("corr"), "status")


def _reconciliation_sql() -> str:
    b = f.Book()
    got = b.sql(bars_sql(duck=True), indicators(b, list(_RECONCILED)), ["code", "date"])

    def rows(t: str, v: str) -> str:
        return " UNION ALL ".join(f"SELECT code, date, '{n}' AS factor_id, {n} AS {v} FROM {t}" for n in _RECONCILED)

    def w(n: int) -> str:
        return f"(PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    o = "(PARTITION BY code ORDER BY date)"
    return f"""
WITH got AS ({got}), base AS (SELECT *, sign(close - lag(close) OVER {o}) * volume AS turn, row_number() OVER {o} AS seen FROM ({bars_sql(duck=True)})),
plain AS (
  SELECT code, date, avg(close) OVER {w(20)} AS sma, 100 * (close / lag(close, 10) OVER {o} - 1) AS roc, -100 * (max(high) OVER {w(14)} - close) / nullif(max(high) OVER {w(14)} - min(low) OVER {w(14)}, 0) AS willr,
         sum(turn) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) + 1000 AS obv, stddev_pop(close) OVER {w(20)} AS stddev FROM base),
g AS ({rows('got', 'g')}), r AS ({rows('plain', 'r')}),
j AS (SELECT factor_id, code, g, r FROM g JOIN r USING (factor_id, code, date) JOIN base USING (code, date) WHERE seen > 20 AND g IS NOT NULL AND r IS NOT NULL),
k AS (SELECT factor_id, CASE WHEN factor_id = 'obv' THEN g - avg(g) OVER (PARTITION BY factor_id, code) ELSE g END AS g, CASE WHEN factor_id = 'obv' THEN r - avg(r) OVER (PARTITION BY factor_id, code) ELSE r END AS r FROM j),
s AS (SELECT factor_id, count(*) AS n, max(abs(g - r)) AS d, avg(abs(r)) + 1e-12 AS scale, covar_samp(g, r) / nullif(stddev_samp(g) * stddev_samp(r), 0) AS c FROM k GROUP BY 1)
SELECT factor_id, n, d < 1e-6 AS close_by, round(c, 6) AS corr, CASE WHEN n < 200 THEN 'mismatch' WHEN d < 1e-8 * (1 + scale) THEN 'exact' WHEN c > 0.995 THEN 'approximate' ELSE 'mismatch' END AS status FROM s"""


# Strategies and models.


def regime_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the 500 largest, the 50 best by momentum in rising and by calm in falling prices, equally weighted, held for a week."""
    b = f.Book()
    rising = f.ts_mean(b.close, 20) > f.ts_mean(b.close, 60)
    signal = f.where(rising, f.cs_rank(f.ts_returns(b.close, 20)), 1 - f.cs_rank(f.ts_std(f.ts_returns(b.close, 1), 60)))
    panel = b.frame(bars(spark, sf_dir, "day"), {"signal": signal, "cap": b.cap})
    panel = panel.withColumn("signal", F.round("signal", 9))
    chosen = selection.weighted(selection.top_n_by(selection.top_n_by(panel, "cap", 500), "signal", 50), "equal", "signal")
    return _shown(selection.rebalanced(chosen.select("date", "code", "signal", "weight"), panel, "week"))


def _regime_sql() -> str:
    w = "(PARTITION BY code ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    return f"""
WITH b AS (SELECT *, close / lag(close, 20) OVER (PARTITION BY code ORDER BY date) - 1 AS r20, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r1 FROM ({bars_sql('day', duck=True)})),
t AS (
  SELECT *, CASE WHEN count(close) OVER {w.format(19)} >= 10 THEN avg(close) OVER {w.format(19)} END AS m20, CASE WHEN count(close) OVER {w.format(59)} >= 30 THEN avg(close) OVER {w.format(59)} END AS m60,
         CASE WHEN count(r1) OVER {w.format(59)} >= 30 THEN stddev_samp(r1) OVER {w.format(59)} END AS s60 FROM b),
c AS (
  SELECT *, CASE WHEN r20 IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY r20) + (count(r20) OVER (PARTITION BY date, r20) - 1) / 2.0::DOUBLE) / count(r20) OVER (PARTITION BY date) END AS k1,
         CASE WHEN s60 IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY s60) + (count(s60) OVER (PARTITION BY date, s60) - 1) / 2.0::DOUBLE) / count(s60) OVER (PARTITION BY date) END AS k2 FROM t),
a AS (SELECT code, date, cap, round(CASE WHEN m20 > m60 THEN k1 ELSE 1 - k2 END, 9) AS signal FROM c),
u AS (SELECT * FROM a WHERE cap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY cap DESC, code) <= 500),
s AS (SELECT * FROM u WHERE signal IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY signal DESC, code) <= 50),
v AS (SELECT code, date, signal, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS weight FROM s),
q AS (SELECT date_trunc('week', date) AS p, min(date) AS start FROM a GROUP BY 1)
SELECT a.code, CAST(a.date AS VARCHAR) AS date, {shown('v.signal')} AS signal, {shown('v.weight')} AS weight
FROM a JOIN q ON q.p = date_trunc('week', a.date) JOIN v ON v.date = q.start AND v.code = a.code"""


def threshold_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted sum of two ranks of every third code; those of 1.2 or more, weighted by signal, daily."""
    b = f.Book()
    rows = b.frame(bars(spark, sf_dir), {"m": f.cs_rank(f.ts_returns(b.close, 3)), "v": f.cs_rank(b.volume)})
    codes = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("code")).where("code % 3 = 0")
    rows = selection.listed(rows, codes).withColumn("signal", F.round(selection.weighted_sum({"m": 1.5, "v": 0.5}), 9))
    return _shown(selection.weighted(selection.threshold(rows, "signal", 1.2), "signal", "signal").select("code", "date", "signal", "weight"))


def _threshold_sql() -> str:
    def rank(c: str) -> str:
        return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {c}) + (count({c}) OVER (PARTITION BY date, {c}) - 1) / 2.0::DOUBLE) / count({c}) OVER (PARTITION BY date) END"

    return f"""
WITH b AS (SELECT *, close / lag(close, 3) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM ({bars_sql(duck=True)})),
s AS (SELECT code, date, round(1.5 * ({rank('r')}) + 0.5 * ({rank('volume')}), 9) AS signal FROM b),
t AS (SELECT * FROM s WHERE code % 3 = 0 AND signal >= 1.2)
SELECT code, CAST(date AS VARCHAR) AS date, {shown('signal')} AS signal, {shown('signal / sum(abs(signal)) OVER (PARTITION BY date)')} AS weight FROM t"""


def training_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split at a date, rows and rising targets of each side."""
    rows = bars(spark, sf_dir)
    return _shown(dataset.report(dataset.dataset(rows, at="1996-06-01"), rows).select("code", F.coalesce("n_train", F.lit(0)).alias("n_train"), F.coalesce("n_test", F.lit(0)).alias("n_test"), "up_train", "up_test", "status"))


def _report_sql(training: str) -> str:
    border = "SELECT code, quantile_cont(date_diff('day', DATE '1970-01-01', date)::DOUBLE, 0.8) AS border FROM c GROUP BY code"
    at = "date_diff('day', DATE '1970-01-01', DATE '1996-06-01')"
    new = f"SELECT code, CASE WHEN min(date) < DATE '1996-06-01' AND DATE '1996-06-01' < max(date) THEN {at} ELSE quantile_cont(date_diff('day', DATE '1970-01-01', date)::DOUBLE, 0.8) END AS border FROM c GROUP BY code"
    assert border in training
    return f"""
WITH k AS ({training.replace(border, new)}),
g AS (SELECT code, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test, avg(target) FILTER (WHERE split = 'train') AS u, avg(target) FILTER (WHERE split = 'test') AS v FROM k GROUP BY 1)
SELECT code, coalesce(n_train, 0) AS n_train, coalesce(n_test, 0) AS n_test, {shown('u')} AS up_train, {shown('v')} AS up_test, CASE WHEN n_train > 0 THEN 'ok' ELSE 'skipped' END AS status
FROM (SELECT DISTINCT code FROM ({bars_sql(duck=True)})) LEFT JOIN g USING (code)"""


def trained(made: DataFrame):
    """Standardised logistic regression of ``target`` on the ``feat_`` columns of the training rows."""
    names = sorted(c for c in made.columns if c.startswith("feat_"))
    steps = [VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol="target", maxIter=100)]
    return Pipeline(stages=steps).fit(made.where("split = 'train'"))


def model_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the earlier part of all codes, trade on the later one by the model's probability."""
    rows = bars(spark, sf_dir)
    made = dataset.dataset(rows)
    scored = trained(made).transform(made.where("split = 'test'")).withColumn("p", vector_to_array("probability")[1])
    runs = scored.select(F.lit("model").alias("run_id"), "code", "date", "open", "close", replay.from_probability(F.col("p"), 0.52, 0.48).alias("action"))
    return _shown(replay.fills(runs, "same_close"))


_FEATURES = ["ret_20", "vol_20", "ma_gap_20"]


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = f.Book()
    ret = f.ts_returns(b.close, 1)
    own = {"ret_20": f.ts_returns(b.close, 20), "vol_20": f.ts_std(ret, 20), "ma_gap_20": b.close / f.ts_mean(b.close, 20), "next": f.ts_delay(ret, -1)}
    rows = b.frame(bars(spark, sf_dir), own).dropna("any", subset=_FEATURES)
    known = F.lead("date").over(Window.partitionBy("code").orderBy("date"))
    return rows.withColumns({"period": F.date_trunc("quarter", "date").cast("date"), "known": F.date_trunc("quarter", known).cast("date")})


def model_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of every quarter: least squares of the next return on all rows whose next bar lies before it."""
    rows = _features(spark, sf_dir)
    fits = models.expanding_fits(rows, _FEATURES, "next", "known", rows.select("period"))
    shown_ = [F.round(c, 7).alias(c) for c in ("intercept", *[f"b_{x}" for x in _FEATURES])]
    return fits.select(F.col("period").cast("string").alias("period"), "n", *shown_)


def model_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return, volatility and gap to the mean of 20 bars, the quarter's linear model of the next return, the 20 best against the 20 worst by rank."""
    scored = models.walk_forward(_features(spark, sf_dir), _FEATURES, "next", "known", "period").withColumn("signal", F.round("prediction", 8))
    return _shown(selection.weighted(selection.top_bottom_n(scored, "signal", 20), "rank", "signal").select("code", "date", "signal", F.col("side").cast("long").alias("side"), "weight"))


def _model_sql() -> str:
    """The normal equations by determinants."""
    w = "(PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    o = "(PARTITION BY code ORDER BY date)"
    xs, pairs = ("x", "y", "z"), ("xx", "xy", "xz", "yy", "yz", "zz", "xr", "yr", "zr")
    sums = ", ".join([f"sum({c}) AS s{c}" for c in (*xs, "r")] + [f"sum({p[0]} * {p[1]}) AS s{p}" for p in pairs])
    cells = ["n", *[f"s{c}" for c in (*xs, "r")], *[f"s{p}" for p in pairs]]
    run = ", ".join(f"coalesce(sum({c}) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {c}" for c in cells)
    cov = ", ".join(f"s{p} - s{p[0]} * s{p[1]} / nullif(n, 0) AS c{p}" for p in pairs)

    def det(*m: str) -> str:
        a, b, c, d, e, f_, g, h, i = m
        return f"({a} * ({e} * {i} - {f_} * {h}) - {b} * ({d} * {i} - {f_} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    whole = det("cxx", "cxy", "cxz", "cxy", "cyy", "cyz", "cxz", "cyz", "czz")
    bx = det("cxr", "cxy", "cxz", "cyr", "cyy", "cyz", "czr", "cyz", "czz")
    by = det("cxx", "cxr", "cxz", "cxy", "cyr", "cyz", "cxz", "czr", "czz")
    bz = det("cxx", "cxy", "cxr", "cxy", "cyy", "cyr", "cxz", "cyz", "czr")
    return f"""
WITH b AS (SELECT code, date, close, close / nullif(lag(close, 20) OVER {o}, 0) - 1 AS x, close / nullif(lag(close) OVER {o}, 0) - 1 AS ret FROM ({bars_sql(duck=True)})),
t AS (
  SELECT code, date, x, CASE WHEN count(ret) OVER {w} >= 10 THEN stddev_samp(ret) OVER {w} END AS y, close / nullif(CASE WHEN count(close) OVER {w} >= 10 THEN avg(close) OVER {w} END, 0) AS z,
         lead(ret) OVER {o} AS r FROM b),
g AS (SELECT *, date_trunc('quarter', date)::DATE AS period, date_trunc('quarter', lead(date) OVER {o})::DATE AS known FROM t WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
m AS (SELECT known AS period, count(*) AS n, {sums} FROM g WHERE r IS NOT NULL AND known IS NOT NULL GROUP BY 1),
a AS (SELECT * FROM (SELECT DISTINCT period FROM g) FULL JOIN m USING (period)),
u AS (SELECT period, {run} FROM a),
c AS (SELECT *, {cov} FROM u),
s AS (SELECT *, CASE WHEN n > 4 THEN {bx} / nullif({whole}, 0) END AS bx, CASE WHEN n > 4 THEN {by} / nullif({whole}, 0) END AS by_, CASE WHEN n > 4 THEN {bz} / nullif({whole}, 0) END AS bz FROM c),
f AS (SELECT period, n, (sr - bx * sx - by_ * sy - bz * sz) / nullif(n, 0) AS b0, bx, by_, bz FROM s WHERE period IN (SELECT period FROM g))
"""


_COEFFICIENTS_SQL = "SELECT CAST(period AS VARCHAR) AS period, CAST(n AS BIGINT) AS n, round(b0, 7) AS intercept, round(bx, 7) AS b_ret_20, round(by_, 7) AS b_vol_20, round(bz, 7) AS b_ma_gap_20 FROM f"
_STRATEGY_SQL = f"""
, p AS (SELECT code, date, round(b0 + bx * x + by_ * y + bz * z, 8) AS signal FROM g JOIN f USING (period)),
e AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY signal DESC, code) AS d, row_number() OVER (PARTITION BY date ORDER BY signal, code DESC) AS l FROM p WHERE signal IS NOT NULL),
k AS (SELECT *, CASE WHEN d <= 20 THEN 1 ELSE -1 END AS side FROM e WHERE d <= 20 OR l <= 20),
q AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY signal, code DESC) AS place FROM k)
SELECT code, CAST(date AS VARCHAR) AS date, {shown('signal')} AS signal, side::BIGINT AS side, {shown('place::DOUBLE / sum(place) OVER (PARTITION BY date)')} AS weight FROM q"""


# Corpora and look-ups.

_FORMULAS = "SELECT source AS corpus, doc_id AS alpha_id, lang AS kind, md5(text) AS hash, md5(lower(trim(text))) AS new_hash, length(text) AS n FROM {documents}"


def _formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("source").alias("corpus"), F.col("doc_id").alias("alpha_id"), F.col("lang").alias("kind"), F.md5("text").alias("hash"), F.md5(F.lower(F.trim("text"))).alias("new_hash"), F.length("text").alias("n"), F.split("text", " ").alias("ops"))


def corpus_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = corpus.duplicate_groups(_formulas(spark, sf_dir).where("hash is not null"))
    return out.select("hash", "n", F.col("first.alpha_id").alias("first_id"), F.col("last.alpha_id").alias("last_id"))


def corpus_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _formulas(spark, sf_dir)
    return corpus.operator_sets(rows.where("alpha_id % 2 = 0"), rows.where("alpha_id % 2 = 1"))


def corpus_merged_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _formulas(spark, sf_dir)
    a, b = (corpus.census(rows.where(f"alpha_id % 2 = {i}")) for i in (0, 1))
    return corpus.merged_census(a, b).select("op", "n_a", "n_b", "in_both")


def corpus_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _formulas(spark, sf_dir).select(F.explode("ops").alias("op"), F.col("kind").alias("axis"), (F.col("n") % 4).alias("arity"), F.when(F.col("n") % 3 > 0, F.col("n") % 250).alias("window"))
    out = corpus.usage(used)
    return out.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(-1)) for c in ("window_min", "window_max")})


def corpus_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(corpus.kinds(_formulas(spark, sf_dir).withColumn("depth", F.col("n") % 12)))


def corpus_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _formulas(spark, sf_dir).where("hash is not null")
    labels = rows.select("hash").distinct().unionByName(spark.range(3).select(F.md5(F.col("id").cast("string")).alias("hash")))
    out = corpus.migrate(labels, rows.select("corpus", "alpha_id", "hash"), rows.select("corpus", "alpha_id", F.col("new_hash").alias("hash")))
    return out.select("hash", "old", "status", F.size("merged_from").cast("long").alias("n_merged"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"), "text")


def indicator_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes are the benchmark's items: the first word with the number is the name, all words are aliases, the text is the expression."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id is not null and text is not null")
    words = F.split("text", " ")
    recipes = items.select(
        F.concat(words[0], F.lit(" "), F.col("item_id").cast("string")).alias("name"), F.array_distinct(words).alias("aliases"), F.col("text").alias("expression"),
        F.when(F.col("item_id") % 9 == 4, "mismatch").otherwise("exact").alias("status"),
    )
    return lookup.find_indicators(_requests(spark, sf_dir), recipes)


def example_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are those of documents, under their text's hash: words of its beginning are the keywords."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = corpus.first_by_hash(
        docs.join(marks, "doc_id").select(
            F.md5("text").alias("hash"), F.col("source").alias("corpus"), F.col("doc_id").alias("alpha_id"), (F.length("text") % 12).alias("depth"), F.col("lang").alias("category"),
            F.when(F.col("quality") == 0, "unverifiable").otherwise("verified").alias("label_status"), F.array_distinct(F.filter(F.slice(F.split("text", " "), 2, 5), lambda w: F.length(w) > 3)).alias("keywords"),
        )
    )
    out = lookup.find_examples(_requests(spark, sf_dir), rows.select("hash", "keywords", "category", "label_status"), rows.select("hash", "corpus", "alpha_id", "depth"))
    return out.select("request_id", "rank", "hash", "score", "corpus", "alpha_id", F.col("depth").cast("long").alias("depth"))


_REQUESTS_SQL = "q AS (SELECT conv_id || ':' || turn AS request_id, lower(coalesce(text, '')) AS t FROM conversations)"
_LOOKUP_SQL = f"""WITH {_REQUESTS_SQL},
r AS (SELECT string_split(text, ' ')[1] || ' ' || item_id AS name, list_distinct(string_split(text, ' ')) AS aliases, length(text) AS size FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL AND item_id % 9 <> 4),
k AS (SELECT name, size, lower(name) AS word, 3 AS w FROM r UNION ALL SELECT name, size, lower(a), CASE WHEN length(a) >= 3 THEN 2 ELSE 1 END FROM (SELECT name, size, unnest(aliases) AS a FROM r)),
h AS (SELECT DISTINCT request_id, t, word FROM q JOIN (SELECT DISTINCT word FROM k WHERE word <> '') ON contains(t, word)),
s AS (SELECT request_id, name, size, sum(w) AS score FROM h JOIN k USING (word) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, size DESC, name) AS rank FROM s)
SELECT request_id, rank::INT AS rank, name, score::INT AS score FROM o WHERE rank <= 2"""
_EXAMPLES_SQL = f"""WITH {_REQUESTS_SQL},
d AS (SELECT md5(text) AS hash, source AS corpus, doc_id AS alpha_id, length(text) % 12 AS depth, lang AS category, quality, text FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL),
f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY hash ORDER BY corpus, alpha_id) = 1),
k AS (
  SELECT hash, lower(w) AS word, 2 AS weight FROM (SELECT hash, unnest(list_distinct(list_filter(string_split(text, ' ')[2:6], lambda w: length(w) > 3))) AS w FROM f WHERE depth <= 8)
  UNION ALL SELECT hash, lower(category), 1 FROM f WHERE depth <= 8 AND category <> ''),
h AS (SELECT DISTINCT request_id, t, word FROM q JOIN (SELECT DISTINCT word FROM k) ON contains(t, word)),
s AS (SELECT request_id, hash, sum(weight)::DOUBLE AS score FROM h JOIN k USING (word) GROUP BY ALL),
e AS (SELECT request_id, f.hash, score * CASE WHEN quality = 0 THEN 0.8 ELSE 1.0 END::DOUBLE AS score, corpus, alpha_id, depth FROM s JOIN f USING (hash)),
o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, depth, hash) AS rank FROM e)
SELECT request_id, rank::INT AS rank, hash, score::DOUBLE AS score, corpus, alpha_id, depth::BIGINT AS depth FROM o WHERE rank <= 4"""


_F = f"WITH f AS ({_FORMULAS.format(documents='documents')}), o AS (SELECT doc_id, lang, length(text) AS n, unnest(string_split(text, ' ')) AS op FROM documents)"
_CORPUS_SQL = {
    "corpus_duplicates": f"{_F} SELECT hash, count(*) AS n, arg_min(alpha_id, row(corpus, alpha_id)) AS first_id, arg_max(alpha_id, row(corpus, alpha_id)) AS last_id FROM f WHERE hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "corpus_sets": f"{_F} SELECT op, CASE WHEN bool_or(doc_id % 2 = 0) AND bool_or(doc_id % 2 = 1) THEN 'both' WHEN bool_or(doc_id % 2 = 0) THEN 'only_a' ELSE 'only_b' END AS kept_by FROM o GROUP BY 1",
    "corpus_merged_census": f"{_F} SELECT op, count(*) FILTER (WHERE doc_id % 2 = 0) AS n_a, count(*) FILTER (WHERE doc_id % 2 = 1) AS n_b, bool_or(doc_id % 2 = 0) AND bool_or(doc_id % 2 = 1) AS in_both FROM o GROUP BY 1",
    "corpus_usage": f"{_F} SELECT op, count(*) AS n, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang), '') AS axes, string_agg(DISTINCT (n % 4)::VARCHAR, ',' ORDER BY (n % 4)::VARCHAR) AS arities, coalesce(min(CASE WHEN n % 3 > 0 THEN n % 250 END), -1)::BIGINT AS window_min, coalesce(max(CASE WHEN n % 3 > 0 THEN n % 250 END), -1)::BIGINT AS window_max FROM o GROUP BY 1",
    "corpus_kinds": f"{_F} SELECT kind, count(*) AS n, count(DISTINCT hash) AS n_hashes, max(n % 12)::INT AS depth_max, {shown('avg(n % 12)')} AS depth_mean FROM f GROUP BY 1",
    "corpus_migration": f"""{_F}, l AS (SELECT DISTINCT hash AS old FROM f WHERE hash IS NOT NULL UNION ALL SELECT md5(i::VARCHAR) FROM range(3) r(i)),
p AS (SELECT DISTINCT hash AS old, new_hash FROM f WHERE hash IS NOT NULL), j AS (SELECT l.old, coalesce(new_hash, l.old) AS hash, CASE WHEN new_hash IS NULL THEN 'orphan' WHEN new_hash = l.old THEN 'unchanged' ELSE 'remapped' END AS status FROM l LEFT JOIN p ON p.old = l.old)
SELECT hash, min(old) AS old, arg_min(status, old) AS status, count(DISTINCT old) - 1 AS n_merged FROM j GROUP BY 1""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        dynamic_parameters, new_parameters, trading_parameters, label_checks, label_status_counts, intent_checks, lookahead_drift, scale_invariance, reconciliation, regime_strategy, threshold_strategy,
        training_report, model_trades, model_coefficients, model_strategy, corpus_duplicates, corpus_sets, corpus_merged_census, corpus_usage, corpus_kinds, corpus_migration, indicator_lookup, example_lookup,
    )
    return {q.__name__: q for q in own}


def oracle_sql(training: str) -> dict[str, str]:
    """SQL of all but the job with a logistic model; ``training`` is that of the training rows."""
    return {
        "dynamic_parameters": _dynamic_sql(),
        "new_parameters": f"{_turns_sql()}, {_DYNAMIC} SELECT u AS \"user\", first_turn::BIGINT AS turn, string_agg(parameter, ',' ORDER BY parameter) AS names FROM dyn GROUP BY 1, 2",
        "trading_parameters": _parameters_sql(),
        "label_checks": _labels_sql() + _LABEL_CHECKS_SQL,
        "label_status_counts": _labels_sql() + _LABEL_COUNTS_SQL,
        "intent_checks": _corrs_sql() + _INTENTS_SQL,
        "lookahead_drift": _drift_sql(),
        "scale_invariance": _scale_sql(),
        "reconciliation": _reconciliation_sql(),
        "regime_strategy": _regime_sql(),
        "threshold_strategy": _threshold_sql(),
        "training_report": _report_sql(training),
        "model_coefficients": _model_sql() + _COEFFICIENTS_SQL,
        "model_strategy": _model_sql() + _STRATEGY_SQL,
        "indicator_lookup": _LOOKUP_SQL,
        "example_lookup": _EXAMPLES_SQL,
        **_CORPUS_SQL,
    }
