"""Investor-profile turns: merge, and map to trading parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(turns: DataFrame, scalars: dict[str, str], lists: tuple[str, ...] = ()) -> DataFrame:
    """One row per user. ``scalars`` maps fields to their confidences: the highest confidence wins,
    of equal ones the later turn; missing values never win, a missing confidence is 0. Lists are
    joined, sorted and distinct. Turns marked irrelevant are left out."""
    rows = turns.where(F.coalesce("is_relevant", F.lit(True)))
    best = []
    for field, confidence in scalars.items():
        order = F.struct(F.coalesce(confidence, F.lit(0.0)), "turn")
        best.append(F.max_by(F.when(F.col(field).isNotNull(), F.col(field)), F.when(F.col(field).isNotNull(), order)).alias(field))
        best.append(F.max(F.when(F.col(field).isNotNull(), F.coalesce(confidence, F.lit(0.0)))).alias(confidence))
    out = rows.groupBy("user").agg(*best)
    for c in lists:
        # Distinct values first, so that a user of very many turns gathers no more than these.
        values = rows.select("user", F.explode(c).alias("v")).distinct().groupBy("user").agg(F.array_sort(F.collect_list("v")).alias(c))
        out = out.join(values, "user", "left").withColumn(c, F.coalesce(c, F.array().cast(dict(rows.dtypes)[c])))
    return out


def dynamic_parameters(turns: DataFrame, reserved: tuple[str, ...] = ()) -> DataFrame:
    """Per user and name: the record of highest confidence, of equal ones the earliest, and the
    turn the name first came up. ``new_parameters`` is an array of structs with
    ``parameter_name`` and ``confidence``."""
    rows = turns.where(F.coalesce("is_relevant", F.lit(True))).select("user", "turn", F.posexplode("new_parameters").alias("pos", "p"))
    rows = rows.where(F.col("p.parameter_name").isNotNull() & ~F.col("p.parameter_name").isin(*reserved)) if reserved else rows.where("p.parameter_name is not null")
    order = F.struct(F.coalesce("p.confidence", F.lit(0.0)), -F.col("turn"), -F.col("pos"))
    return rows.groupBy("user", F.col("p.parameter_name").alias("parameter_name")).agg(F.max_by("p", order).alias("record"), F.min("turn").alias("first_turn"))


def new_names(turns: DataFrame, reserved: tuple[str, ...] = ()) -> DataFrame:
    """Per user and turn that brought any: the names of parameters that no earlier turn had, in the turn's order."""
    rows = turns.where(F.coalesce("is_relevant", F.lit(True))).select("user", "turn", F.posexplode("new_parameters").alias("pos", "p"))
    rows = rows.select("user", "turn", "pos", F.col("p.parameter_name").alias("name")).where(F.col("name").isNotNull() & ~F.col("name").isin(*reserved))
    first = rows.groupBy("user", "name").agg(F.min(F.struct("turn", "pos")).alias("at"))
    each = first.groupBy("user", F.col("at.turn").alias("turn")).agg(F.array_sort(F.collect_list(F.struct("at.pos", "name"))).alias("n"))
    return each.select("user", "turn", F.col("n.name").alias("names"))


def clamped(x: Column, low: float, high: float) -> Column:
    """Linear from low (at 0) to high (at 1)."""
    return F.lit(low) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * (high - low)


def risk_tolerance(answer: Column, hint: Column, confidence: Column) -> Column:
    """The stated tolerance mixed with the hint, by the hint's confidence."""
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(hint.isNull(), answer).otherwise((1 - c) * answer + c * hint)


# Loss aversion by the feeling about losses, and holding days by horizon.
LOSS_AVERSION = {"VERY_ANXIOUS": 0.85, "SOMEWHAT_CONCERNED": 0.5, "CAN_TOLERATE": 0.2}
HOLDING_DAYS = {"SHORT": 5, "MEDIUM": 180, "LONG": 720}
HORIZON_WEIGHT = {"SHORT": 0.5, "MEDIUM": 0.15, "LONG": 0.05}
THEME = "FUTURE_GROWTH_SECTOR"


def _of(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def allocation(size: Column, theme: Column) -> Column:
    """Shares of the portfolio: the preferred size, a growth theme, both (80 to 20), or no restriction."""
    growth = F.coalesce(theme == THEME, F.lit(False))
    some = F.coalesce(size != "", F.lit(False))
    return (
        F.when(some & growth, F.create_map(size, F.lit(0.8), F.lit("GROWTH_THEME_AUTO"), F.lit(0.2)))
        .when(some, F.create_map(size, F.lit(1.0)))
        .when(growth, F.create_map(F.lit("GROWTH_THEME_AUTO"), F.lit(1.0)))
        .otherwise(F.create_map(F.lit("UNRESTRICTED"), F.lit(1.0)))
    )


def agent_weights(horizon: Column, risk: Column, complexity: Column) -> Column:
    """Weights of the three agents, which add up to 1: by horizon, by risk, and by how many wishes go
    beyond the questions (0 to 4)."""
    raw = {"HFT": _of(HORIZON_WEIGHT, horizon), "ML": clamped(risk, 0.2, 0.5), "LLM": clamped(complexity / 4, 0.2, 0.5)}
    total = raw["HFT"] + raw["ML"] + raw["LLM"]
    return F.create_map(*[x for n, w in raw.items() for x in (F.lit(n), w / total)])


def trading_parameters(profiles: DataFrame) -> DataFrame:
    """One row of parameters per user, from ``loss_feeling``, ``time_horizon`` and the merged profile:
    ``company_size_preference``, ``risk_tolerance_hint``, ``risk_tolerance_confidence``, ``thematic_intent``,
    ``excluded_sectors`` and ``dynamic`` (array of records with name, dtype and value)."""
    aversion = _of(LOSS_AVERSION, F.col("loss_feeling"))
    rows = profiles.withColumn("loss_aversion", aversion)
    rows = rows.withColumn("risk_tolerance", risk_tolerance(1 - F.col("loss_aversion"), F.col("risk_tolerance_hint"), F.col("risk_tolerance_confidence")))
    risk = F.col("risk_tolerance")
    excluded = F.coalesce("excluded_sectors", F.array().cast("array<string>"))
    dynamic = F.size(F.coalesce("dynamic", F.array().cast(dict(profiles.dtypes)["dynamic"])))
    complexity = (F.size(excluded) > 0).cast("int") + F.coalesce(F.col("thematic_intent") != "", F.lit(False)).cast("int") + dynamic
    return rows.select(
        "user",
        "risk_tolerance",
        "time_horizon",
        "loss_aversion",
        clamped(F.col("loss_aversion"), 0.55, 0.85).alias("min_confidence_to_act"),
        clamped(risk, 0.02, 0.15).alias("max_position_size_pct"),
        clamped(risk, 0.02, 0.10).alias("stop_loss_pct"),
        _of(HOLDING_DAYS, F.col("time_horizon")).alias("min_holding_period_days"),
        clamped(risk, 1.0, 3.0).alias("max_leverage"),
        allocation(F.col("company_size_preference"), F.col("thematic_intent")).alias("portfolio_allocation"),
        excluded.alias("excluded_sectors"),
        agent_weights(F.col("time_horizon"), risk, complexity).alias("agent_weights"),
        F.transform("dynamic", lambda p: F.struct(p["parameter_name"].alias("name"), typed(p["value"], p["dtype"]).alias("value"))).alias("extra_constraints"),
    )


def typed(value: Column, dtype: Column) -> Column:
    """A text value in the form its type names; what can't be read stays raw."""
    t, v = F.lower(F.trim(dtype)), F.trim(value)
    return F.struct(
        F.when(t == "bool", F.lower(v).isin("true", "1", "yes")).alias("as_bool"),
        F.when(t == "float", v.try_cast("double")).when(t == "int", F.signum(v.try_cast("double")) * F.floor(F.abs(v.try_cast("double")))).alias("as_number"),
        F.when(t == "list", F.filter(F.transform(F.split(F.btrim(v, F.lit("[]")), ","), lambda x: F.btrim(F.trim(x), F.lit("'\""))), lambda x: x != "")).alias("as_list"),
        value.alias("raw"),
    )
