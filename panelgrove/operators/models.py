"""Linear models over an expanding window: refitted for every period from sums that add up.

What least squares needs of any set of rows are counts, sums and products, so each period is summed once, with
partial sums before the shuffle, and the window up to a period is the running total of those sums: n periods cost
one pass over the rows, not n. The equations of all periods are solved at once, one row a period, by
elimination in column expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A pivot below this share of its column's own sum of squares counts as dependent on the columns before.
SINGULAR = 1e-10
#: Periods whose coefficients are broadcast at most.
BROADCAST_PERIODS = 100_000


def moments(rows: DataFrame, features: list[str], label: str, period: str) -> DataFrame:
    """(period, n, sums and products) of the rows that have every feature and the label."""
    names = [*features, label]
    full = rows.dropna("any", subset=[*names, period])
    sums = [F.sum(a).alias(f"s_{a}") for a in names]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return full.groupBy(period).agg(F.count("*").alias("n"), *sums, *products)


def expanding_fits(rows: DataFrame, features: list[str], label: str, known: str, periods: DataFrame) -> DataFrame:
    """For each of ``periods`` (period): ``n``, ``intercept`` and ``b_`` of every feature, fitted by least squares on the
    rows whose label was known (period ``known``) before it; null where there are too few rows, or features
    depend on each other."""
    sums = moments(rows, features, label, known).withColumnRenamed(known, "period")
    cells = [c for c in sums.columns if c != "period"]
    both = periods.select("period").distinct().join(sums, "period", "full")
    before = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    out = both.select("period", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in cells])
    names = [*features, label]

    def centred(a: str, b: str):
        return F.col(f"p_{a}_{b}") - F.try_divide(F.col(f"s_{a}") * F.col(f"s_{b}"), F.col("n"))

    d = len(features)
    m = {(i, j): f"m_{i}_{j}" for i in range(d) for j in range(d + 1)}
    out = out.withColumns({m[i, j]: centred(*[names[k] for k in sorted((i, j))]) for i, j in m})
    out = out.withColumns({f"own_{i}": F.col(m[i, i]) for i in range(d)})
    for k in range(d):
        pivot = F.when(F.col(m[k, k]) > SINGULAR * F.col(f"own_{k}"), F.col(m[k, k]))
        out = out.withColumns({m[k, j]: F.try_divide(F.col(m[k, j]), pivot) for j in range(k, d + 1)})
        out = out.withColumns({m[i, j]: F.col(m[i, j]) - F.col(m[i, k]) * F.col(m[k, j]) for i in range(d) if i != k for j in range(k, d + 1)})
    slopes = {f: F.when(F.col("n") > d + 1, F.col(m[i, d])) for i, f in enumerate(features)}
    mean = {a: F.try_divide(F.col(f"s_{a}"), F.col("n")) for a in names}
    intercept = mean[label]
    for f, b in slopes.items():
        intercept = intercept - b * mean[f]
    fits = out.select("period", "n", intercept.alias("intercept"), *[b.alias(f"b_{f}") for f, b in slopes.items()])
    return periods.select("period").distinct().join(fits, "period")


def walk_forward(rows: DataFrame, features: list[str], label: str, known: str, period: str) -> DataFrame:
    """``rows`` with ``prediction`` of ``label`` by the model of their ``period``; null before there is one."""
    fits = expanding_fits(rows, features, label, known, rows.select(F.col(period).alias("period")))
    out = F.col("intercept")
    for f in features:
        out = out + F.col(f"b_{f}") * F.col(f)
    few = fits.count() <= BROADCAST_PERIODS
    joined = rows.join(F.broadcast(fits) if few else fits, rows[period] == fits["period"], "left")
    return joined.select(*[rows[c] for c in rows.columns], out.alias("prediction"))
