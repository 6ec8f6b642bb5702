"""Exponential smoothing as an associative scan over windows.

One row of a smoothing is an affine map y -> a y + b of the value before it, and maps compose: step k of the
scan joins every row's map with those 1, 2 and 3 strides of ``RADIX ** k`` rows before it, so after k steps a row
holds the composition of its last ``RADIX ** k`` rows. The adjusted mean is a quotient of two such recurrences that
share their factor; the other kind is one recurrence whose factor depends on the gap since the last value.
Steps end where what lies further back has lost all but ``LEAST`` of its weight. Everything is ``lag`` in one
sorted window: no Python, and no shuffle beyond the one by code that the rows already have.

Histories that are cut into parts (``keys`` of code and part) are scanned part by part. The map of a whole part is
the one of its last row; these summaries are scanned in their turn, a row a part, and give every part the
value it starts from.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RADIX, LEAST = 4, 2.0**-100


@dataclass(frozen=True)
class Smoothing:
    """A smoothing of the SQL text ``x`` with weight ``alpha`` of the newest value."""

    x: str
    alpha: float
    adjust: bool

    def rows(self) -> int:
        """Rows that hold all weight but ``LEAST``, whatever values are missing among them."""
        keep, far = 1 - self.alpha, -math.log(LEAST)
        if keep <= 0:
            return 1
        if self.adjust:
            return math.ceil(far / -math.log(keep)) + 1
        # Of g rows with one value the factor is w / (w + alpha), which may fade more slowly a row than keep.
        gaps = (keep**g for g in range(1, 1 + min(100_000, math.ceil(far / -math.log(keep)))))
        return math.ceil(max(g * far / -math.log(w / (w + self.alpha)) for g, w in enumerate(gaps, 1) if w > 0)) + 1


def _steps(rows: float) -> int:
    return max(0, math.ceil(math.log(max(1.0, rows), RADIX) - 1e-9))


def scanned(rows: DataFrame, keys: list[str], order: str, maps: dict[str, list[str]], steps: dict[str, int]) -> DataFrame:
    """``rows`` with every map (factor ``a``, offsets ``b`` that share it) composed with those before it in its
    group, ``RADIX ** steps[a]`` rows deep."""
    over = Window.partitionBy(*keys).orderBy(order)
    for k in range(max(steps.values(), default=0)):
        now = {a: bs for a, bs in maps.items() if k < steps[a]}
        lags = {f"{c}__{j}": F.lag(c, j * RADIX**k, default).over(over) for a, bs in now.items() for c, default in [(a, 1.0), *((b, 0.0) for b in bs)] for j in range(1, RADIX)}
        ahead = rows.withColumns(lags)
        new = {}
        for a, bs in now.items():
            factors = [F.col(a)] + [F.col(f"{a}__{j}") for j in range(1, RADIX)]
            for b in bs:
                value: Column = F.col(f"{b}__{RADIX - 1}")
                for j in range(RADIX - 2, -1, -1):
                    value = (F.col(f"{b}__{j}") if j else F.col(b)) + factors[j] * value
                new[b] = value
            new[a] = math.prod(factors[1:], start=factors[0])
        rows = ahead.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])
    return rows


def smoothed(rows: DataFrame, helpers: dict[str, Smoothing], part: str | None = None, size: int = 0) -> DataFrame:
    """``rows`` (code, date, seq, and the columns of the texts) with one new column a smoothing. With ``part``,
    a column that cuts every code's history into runs of ``size`` rows, no task holds more than a run."""
    columns = rows.columns
    keys = ["code"] + ([part] if part else [])
    order = Window.partitionBy(*keys).orderBy("date")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    at = {n: F.col(f"{n}__x").isNotNull() for n in helpers}
    out = rows.withColumns({f"{n}__x": F.expr(h.x).cast("double") for n, h in helpers.items()})
    last = {n: F.when(at[n], F.col("seq")) for n in helpers}
    if part:
        out = _with_totals(out, {f"{n}__{k}": v for n in helpers for k, v in (("n0", F.count(f"{n}__x")), ("s0", F.max(last[n])))}, {"n0": F.sum, "s0": F.max}, part)
    held = {f"{n}__n": F.count(f"{n}__x").over(upto) for n in helpers}
    gone = {f"{n}__g": F.max(last[n]).over(before) for n, h in helpers.items() if not h.adjust}
    out = out.withColumns(held | gone)
    maps, made = {}, {}
    for n, h in helpers.items():
        keep, x = F.lit(1 - h.alpha), F.col(f"{n}__x")
        if h.adjust:
            made |= {f"{n}__a": keep, f"{n}__b": F.coalesce(x, F.lit(0.0)), f"{n}__c": at[n].cast("double")}
            maps[f"{n}__a"] = [f"{n}__b", f"{n}__c"]
        else:
            seen = F.coalesce(F.col(f"{n}__g"), F.col(f"{n}__s0")) if part else F.col(f"{n}__g")
            old = F.pow(keep, F.col("seq") - seen)
            first = seen.isNull()
            made[f"{n}__a"] = F.when(~at[n], 1.0).when(first, 0.0).otherwise(old / (old + h.alpha))
            made[f"{n}__b"] = F.when(~at[n], 0.0).when(first, x).otherwise(h.alpha * x / (old + h.alpha))
            maps[f"{n}__a"] = [f"{n}__b"]
    out = scanned(out.withColumns(made), keys, "date", maps, {f"{n}__a": _steps(h.rows()) for n, h in helpers.items()})
    if part:
        out = _with_starts(out, helpers, part, size)
    now = {n: (F.try_divide(f"{n}__b", f"{n}__c") if h.adjust else F.col(f"{n}__b")) for n, h in helpers.items()}
    enough = {n: F.col(f"{n}__n") + (F.coalesce(f"{n}__n0", F.lit(0)) if part else 0) >= (2 if h.adjust else 1) for n, h in helpers.items()}
    out = out.withColumns({n: F.last(F.when(at[n], now[n]), True).over(upto) for n in helpers})
    kept = {n: F.coalesce(F.col(n), F.col(f"{n}__y0")) if part else F.col(n) for n in helpers}
    return out.select(*columns, *[F.when(enough[n], kept[n]).alias(n) for n in helpers])


def _with_totals(rows: DataFrame, totals: dict[str, Column], join: dict, part: str) -> DataFrame:
    """``rows`` with ``totals`` of all parts of the code before their own, put together by ``join``."""
    over = Window.partitionBy("code").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("code", part).agg(*[v.alias(n) for n, v in totals.items()])
    ahead = sums.select("code", part, *[join[n.rsplit("__", 1)[1]](n).over(over).alias(n) for n in totals])
    return rows.join(ahead, ["code", part])


def _with_starts(rows: DataFrame, helpers: dict[str, Smoothing], part: str, size: int) -> DataFrame:
    """``rows`` with their maps joined with those of all parts before; ``y0`` is the last value before the part."""
    names = {n: [f"{n}__a", f"{n}__b"] + ([f"{n}__c"] if h.adjust else []) for n, h in helpers.items()}
    ends = rows.groupBy("code", part).agg(
        # Where values are missing at the end, a plain recurrence stands as after the last one.
        *[F.max_by(F.struct(*cs), "date" if helpers[n].adjust else F.when(F.col(f"{n}__x").isNotNull(), F.col("date"))).alias(n) for n, cs in names.items()],
        *[F.count(f"{n}__x").alias(f"{n}__k") for n in helpers],
    ).select("code", part, *[F.col(f"{n}.{c}").alias(c) for n, cs in names.items() for c in cs], *[f"{n}__k" for n in helpers])
    for n, h in helpers.items():
        a, *bs = names[n]
        # A part without values changes nothing but the age of what came before.
        keys = ["code"] if h.adjust else ["code", f"{n}__some"]
        own = ends.withColumn(f"{n}__some", F.col(f"{n}__k") > 0)
        ends = scanned(own, keys, part, {a: bs}, {a: _steps(2 * math.ceil(h.rows() / size) + 2)})
    over = Window.partitionBy("code").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    start = {}
    for n, h in helpers.items():
        a, *bs = names[n]
        y = F.try_divide(*bs) if h.adjust else F.col(bs[0])
        start[f"{n}__y0"] = F.last(F.when(F.col(f"{n}__k") > 0, y), True).over(over)
        if h.adjust:
            start |= {f"{c}0": F.lag(c, 1, 0.0).over(Window.partitionBy("code").orderBy(part)) for c in bs}
    out = rows.join(ends.select("code", part, *[v.alias(c) for c, v in start.items()]), ["code", part])
    new = {}
    for n, h in helpers.items():
        a, *bs = names[n]
        new |= {c: F.col(c) + F.col(a) * (F.col(f"{c}0") if h.adjust else F.coalesce(F.col(f"{n}__y0"), F.lit(0.0))) for c in bs}
    return out.withColumns(new)
