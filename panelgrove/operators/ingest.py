"""The gate of a panel: what is wrong in raw bars is turned away with its reason, what is missing becomes null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = ("open", "high", "low", "close", "volume", "vwap", "cap")


def masked(rows: DataFrame) -> DataFrame:
    """NaN and infinite numbers as nulls: sums would turn into them."""
    kinds = dict(rows.dtypes)
    floats = [c for c, t in kinds.items() if t in ("double", "float")]
    return rows.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in floats}) if floats else rows


def _reason(columns: list[str]) -> Column:
    has = set(columns)
    out = F.when(F.col("code").isNull() | F.col("date").isNull(), "no key")
    if {"high", "low"} <= has:
        out = out.when(F.col("high") < F.col("low"), "high below low")
    for c in ("open", "high", "low", "close", "vwap"):
        if c in has:
            out = out.when(F.col(c) <= 0, f"{c} not positive")
    return out.when(F.col("volume") < 0, "negative volume") if "volume" in has else out


def gate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(panel, rejects) of raw bars (code, date, any of ``NUMBERS``, and others that can be ordered). The panel has one row a code
    and date. Rejects have all columns, the ``reason``, and ``n``, the number of such rows.

    Of rows that share a code and date the smallest by all columns in their order stays, the others are rejected as ``repeated key``;
    equal rows are counted, not listed, so a key that very many rows share is combined before any shuffle.
    """
    raw = masked(rows)
    columns, rest = raw.columns, [c for c in raw.columns if c not in ("code", "date")]
    judged = raw.withColumn("reason", _reason(columns))
    bad = judged.where("reason is not null").groupBy(*columns, "reason").agg(F.count("*").alias("n"))
    alike = judged.where("reason is null").groupBy(*columns).agg(F.count("*").alias("n"))
    first = alike.groupBy("code", "date").agg(F.min(F.struct(*rest) if rest else F.lit(0)).alias("__first"), F.sum("n").alias("__all"))
    panel = first.select("code", "date", *([f"__first.{c}" for c in rest]))
    again = first.where("__all > 1")
    same = F.struct(*rest) == F.col("__first") if rest else F.lit(True)
    left = alike.join(again, ["code", "date"]).withColumn("n", F.col("n") - F.when(same, 1).otherwise(0)).where("n > 0")
    return panel.select(*columns), bad.unionByName(left.select(*columns, F.lit("repeated key").alias("reason"), "n"))
