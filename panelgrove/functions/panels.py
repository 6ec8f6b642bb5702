"""Panels that are too long for a task a code, or too wide for a task a date.

**Long**: every code's history is cut into runs of rows. :func:`halo` copies the last rows of a run to the ones
behind that need them, so that a window over time finds its whole frame within one part; :func:`unhalo` drops the
copies. Running totals add up in parts and start from the totals of the parts before.

**Wide**: means, sums and deviations of a date are aggregates that combine before the shuffle. Ranks and medians come from counts
of equal values: these are put in order within buckets of near values, and buckets by their totals, so that
neither a date nor a value that many codes share is ever sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shown import trimmed

#: Groups of date and sector whose aggregates are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_GROUPS = 100_000


@dataclass(frozen=True)
class Running:
    """The running sum or product of the SQL text ``x``; missing where x is."""

    x: str
    product: bool

    def total(self) -> Column:
        return (F.product if self.product else F.sum)(F.expr(self.x))

    def column(self, *part: str) -> Column:
        over = Window.partitionBy("code", *part).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        return F.when(F.expr(self.x).isNotNull(), self.total().over(over))


@dataclass(frozen=True)
class Across:
    """An operator across codes of the SQL text ``x``, by date or by date and sector."""

    kind: str
    x: str
    sectors: bool = False

    def text(self) -> str:
        """As a window."""
        by = "date, sector" if self.sectors else "date"
        x, w, o = self.x, f"(PARTITION BY {by})", f"PARTITION BY {by} ORDER BY {trimmed(self.x)} ASC NULLS LAST"
        t = {
            "rank": f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({o}) + (count({x}) OVER ({o} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / CAST(2 AS DOUBLE)) / count({x}) OVER {w} END",
            "scale": f"{x} / nullif(sum(abs({x})) OVER {w}, 0)",
            "mean": f"avg({x}) OVER {w}",
            "std": f"CASE WHEN count({x}) OVER {w} > 1 THEN stddev_samp({x}) OVER {w} END",
            "median": f"median({x}) OVER {w}",
        }[self.kind]
        return f"CASE WHEN sector IS NOT NULL THEN {t} END" if self.sectors else t

    def total(self) -> Column:
        """What of a group ``scale``, ``mean`` and ``std`` need."""
        x = F.expr(self.x)
        return F.sum(F.abs(x)) if self.kind == "scale" else F.avg(x) if self.kind == "mean" else F.when(F.count(x) > 1, F.stddev_samp(x))


# Long panels.


def numbered(rows: DataFrame, unit: str = "month") -> DataFrame:
    """``rows`` (code, date) with ``seq``, each code's running number by date: counts by ``unit`` of time come
    first, so that no task holds a code."""
    cut = rows.withColumn("__unit", F.date_trunc(unit, "date"))
    upto = Window.partitionBy("code").orderBy("__unit").rowsBetween(Window.unboundedPreceding, -1)
    start = cut.groupBy("code", "__unit").agg(F.count("*").alias("__n")).select("code", "__unit", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__start"))
    own = cut.withColumn("__own", F.row_number().over(Window.partitionBy("code", "__unit").orderBy("date")))
    return own.join(start, ["code", "__unit"]).withColumn("seq", F.col("__start") + F.col("__own")).drop("__unit", "__start", "__own")


def halo(rows: DataFrame, size: int, back: int, ahead: int) -> DataFrame:
    """``rows`` (code, seq) in parts of ``size`` rows of a code, each with copies of the ``back`` rows before it
    and the ``ahead`` rows behind it."""
    at = F.col("seq").cast("long") - 1
    own = F.expr(f"(CAST(seq AS BIGINT) - 1) DIV {size}")
    if not back and not ahead:
        return rows.withColumns({halo.PART: own, halo.OWN: own})
    least = F.greatest(F.lit(0), F.floor((at - ahead) / size))
    most = F.floor((at + back) / size)
    return rows.withColumn(halo.OWN, own).withColumn(halo.PART, F.explode(F.sequence(least.cast("long"), most.cast("long"))))


halo.PART, halo.OWN = "__part", "__own_part"


def unhalo(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(halo.PART) == F.col(halo.OWN)).drop(halo.OWN)


def running_totals(rows: DataFrame, totals: dict[str, Running]) -> DataFrame:
    """Running totals of whole histories over rows in parts."""
    if not totals:
        return rows
    over = Window.partitionBy("code").orderBy(halo.PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("code", halo.PART).agg(*[t.total().alias(n) for n, t in totals.items()])
    starts = sums.select("code", halo.PART, *[(F.product if t.product else F.sum)(n).over(over).alias(f"{n}__0") for n, t in totals.items()])
    out = rows.withColumns({n: t.column(halo.PART) for n, t in totals.items()}).join(starts, ["code", halo.PART])
    both = {n: F.col(n) * F.coalesce(f"{n}__0", F.lit(1.0)) if t.product else F.col(n) + F.coalesce(f"{n}__0", F.lit(0.0)) for n, t in totals.items()}
    return out.withColumns(both).drop(*[f"{n}__0" for n in totals])


# Wide panels.


def bucket_of(x: Column) -> Column:
    """A number that rises with x, of few thousand values: sign and size to a 64th of a doubling."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * F.greatest(F.lit(1.0), F.floor(F.log2(F.abs(x)) * 64) + 70_000))


def ranked_values(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``counts`` (keys, v, k: rows of value v) with ``below``, the rows of smaller values of the group, and
    ``n``, all rows of it."""
    cut = counts.withColumn("__bucket", bucket_of(F.col("v")))
    sums = cut.groupBy(*keys, "__bucket").agg(F.sum("k").alias("__all"))
    over = Window.partitionBy(*keys)
    ahead = F.coalesce(F.sum("__all").over(over.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*keys, "__bucket", ahead.alias("__ahead"), F.sum("__all").over(over).alias("n"))
    near = Window.partitionBy(*keys, "__bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn("__near", F.coalesce(F.sum("k").over(near), F.lit(0)))
    return own.join(starts, [*keys, "__bucket"]).select(*keys, "v", "k", (F.col("__ahead") + F.col("__near")).alias("below"), "n")


def across_wide(rows: DataFrame, defs: dict[str, Across]) -> DataFrame:
    """``rows`` (code, date, sector, and what the texts read) with one column for each of ``defs``; the rows are
    read several times."""
    columns = rows.columns
    xs = {n: f"{n}__x" for n in defs}
    out = rows.withColumns({xs[n]: F.expr(trimmed(a.x) if a.kind == "rank" else a.x).cast("double") + 0.0 for n, a in defs.items()})
    for sectors in (False, True):
        keys = ["date", "sector"] if sectors else ["date"]
        plain = {n: Across(a.kind, xs[n], sectors) for n, a in defs.items() if a.sectors == sectors and a.kind in ("scale", "mean", "std")}
        if plain:
            sums = out.groupBy(*keys).agg(*[a.total().alias(f"{n}__t") for n, a in plain.items()])
            out = _joined(out, sums, keys)
            for n, a in plain.items():
                t = F.col(f"{n}__t")
                value = F.try_divide(xs[n], F.nullif(t, F.lit(0.0))) if a.kind == "scale" else t
                out = out.withColumn(n, F.when(F.col("sector").isNotNull(), value) if sectors else value)
    order = {n: a for n, a in defs.items() if a.kind in ("rank", "median")}
    if order:
        names = list(order)
        group = {n: F.col("sector") if order[n].sectors else F.lit("") for n in names}
        each = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), group[n].cast("string").alias("g"), F.col(xs[n]).alias("v")) for i, n in enumerate(names)]), lambda e: e["v"].isNotNull() & e["g"].isNotNull())
        long = out.select("code", "date", F.inline(each))
        keys = ["date", "i", "g"]
        ranked = ranked_values(long.groupBy(*keys, "v").agg(F.count("*").alias("k")), keys)
        share = (F.col("below") + (F.col("k") + 1) / 2) / F.col("n")
        ranks = [i for i, n in enumerate(names) if order[n].kind == "rank"]
        if ranks:
            own = long.where(F.col("i").isin(ranks)).join(ranked.select(*keys, "v", share.alias("r")), [*keys, "v"])
            back = own.groupBy("code", "date").agg(*[F.max(F.when(F.col("i") == i, F.col("r"))).alias(names[i]) for i in ranks])
            out = out.join(back, ["code", "date"], "left")
        for i, n in enumerate(names):
            if order[n].kind == "median":
                own, end = ranked.where(F.col("i") == i), F.col("below") + F.col("k")
                middle = own.groupBy("date").agg((F.min(F.when(2 * end >= F.col("n"), F.col("v"))) / 2 + F.max(F.when(2 * F.col("below") <= F.col("n"), F.col("v"))) / 2).alias(n))
                out = _joined(out, middle, ["date"])
    return out.select(*columns, *defs)


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with a row of their group each; groups are broadcast if they are few. A missing key has no group."""
    few = groups.count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(groups) if few else groups, keys, "left")
