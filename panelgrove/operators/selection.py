"""Universe, selection, weighting and rebalancing per date. Ties go to the smaller code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n_by(rows: DataFrame, field: str, n: int) -> DataFrame:
    w = Window.partitionBy("date").orderBy(F.col(field).desc_nulls_last(), "code")
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col(field).isNotNull() & (F.col("__r") <= n)).drop("__r")


def top_bottom_n(rows: DataFrame, field: str, n: int) -> DataFrame:
    """``side`` 1 for the n largest and -1 for the n smallest; a code is on one side only."""
    down = Window.partitionBy("date").orderBy(F.col(field).desc(), "code")
    up = Window.partitionBy("date").orderBy(F.col(field).asc(), F.col("code").desc())
    ranked = rows.where(F.col(field).isNotNull()).withColumns({"__d": F.row_number().over(down), "__u": F.row_number().over(up)})
    return ranked.withColumn("side", F.when(F.col("__d") <= n, 1).when(F.col("__u") <= n, -1)).where("side is not null").drop("__d", "__u")


def weighted(rows: DataFrame, kind: str, field: str) -> DataFrame:
    """``weight`` per date: equal, by rank, or by signal size."""
    w = Window.partitionBy("date")
    rank = F.row_number().over(w.orderBy(F.col(field).asc(), F.col("code").desc()))
    if kind == "equal":
        return rows.withColumn("weight", 1 / F.count("*").over(w))
    if kind == "rank":
        return rows.withColumn("__r", rank).withColumn("weight", F.col("__r") / F.sum("__r").over(w)).drop("__r")
    if kind == "signal":
        return rows.withColumn("weight", F.try_divide(field, F.sum(F.abs(field)).over(w)))
    raise ValueError(kind)


def threshold(rows: DataFrame, field: str, least: float) -> DataFrame:
    """Rows whose ``field`` is at least so large."""
    return rows.where(F.col(field) >= least)


def listed(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows of an explicit list of codes."""
    return rows.join(codes.select("code").distinct(), "code", "left_semi")


def weighted_sum(parts: dict[str, float]):
    """A signal column: the weighted sum of other columns."""
    total = F.lit(0.0)
    for name, w in sorted(parts.items()):
        total = total + F.col(name) * w
    return total


def rebalanced(chosen: DataFrame, panel: DataFrame, unit: str) -> DataFrame:
    """The rows of ``chosen`` (date, code, ...) on the panel's first date of each week, month (or other
    unit) are held for the whole of it: on each of its dates that the code has in ``panel``."""
    period = F.date_trunc(unit, "date").alias("__period")
    dates = panel.select("date", period).distinct()
    first = dates.groupBy("__period").agg(F.min("date").alias("date"))
    held = chosen.join(first, "date").drop("date")
    return panel.select("date", "code", period).join(held, ["__period", "code"]).drop("__period")
