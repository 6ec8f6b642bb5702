"""Features, target and time-based split of a bar table."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _over(n: int | None = None):
    w = Window.partitionBy("code").orderBy("date")
    return w if n is None else w.rowsBetween(1 - n, 0)


def _full(x, agg, n: int):
    """``agg`` over n rows, only where all have a value."""
    return F.when(F.count(x).over(_over(n)) == n, agg(x).over(_over(n)))


def features(bars: DataFrame) -> DataFrame:
    """``bars`` with ``feat_`` columns: returns, gaps to moving averages, volatility, volume ratio, RSI."""
    c, v = F.col("close"), F.col("volume")

    def back(n: int):
        return F.try_divide(c, F.lag(c, n).over(_over())) - 1

    out = bars.withColumns({f"feat_ret_{n}": back(n) for n in (1, 5, 20)} | {f"feat_ma{n}_gap": F.try_divide(c, _full(c, F.avg, n)) - 1 for n in (5, 20, 60)})
    delta = c - F.lag(c, 1).over(_over())
    out = out.withColumns(
        {
            "feat_vol_ratio": F.try_divide(v, _full(v, F.avg, 20)),
            "__gain": F.when(delta.isNotNull(), F.greatest(delta, F.lit(0.0))),
            "__loss": F.when(delta.isNotNull(), F.greatest(-delta, F.lit(0.0))),
        }
    )
    rs = F.try_divide(_full(F.col("__gain"), F.avg, 14), _full(F.col("__loss"), F.avg, 14))
    out = out.withColumns({"feat_vol_20": _full(F.col("feat_ret_1"), F.stddev_samp, 20), "feat_rsi_14": 100 - F.try_divide(F.lit(100.0), 1 + rs)})
    return out.drop("__gain", "__loss")


def with_target(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """``target`` 1 where the close is higher after ``horizon`` bars; each code's last bars go."""
    whole = Window.partitionBy("code")
    return (
        bars.withColumn("__left", F.count("*").over(whole) - F.row_number().over(_over()))
        .withColumn("target", F.coalesce((F.lead("close", horizon).over(_over()) > F.col("close")).cast("int"), F.lit(0)))
        .where(F.col("__left") >= horizon)
        .drop("__left")
    )


def with_split(rows: DataFrame, at: str | None = None, share: float = 0.8) -> DataFrame:
    """``split``: train before the border and test from it on. Where ``at`` does not lie strictly
    inside a code's range, the border is the code's ``share`` quantile of time. Codes with an
    empty side are left out."""
    whole = dict(rows.dtypes)["date"] == "date"

    def time(c):
        return F.unix_date(c.cast("date")) if whole else F.unix_micros(c.cast("timestamp"))

    t = time(F.col("date"))
    border = F.percentile(t, F.lit(share))
    if at is not None:
        day = time(F.lit(at))
        border = F.when((F.min(t) < day) & (day < F.max(t)), day.cast("double")).otherwise(border)
    borders = rows.groupBy("code").agg(border.alias("__border"))
    out = rows.join(borders, "code").withColumn("split", F.when(t < F.col("__border"), "train").otherwise("test")).drop("__border")
    both = out.groupBy("code").agg(F.count_distinct("split").alias("n")).where("n = 2").select("code")
    return out.join(both, "code", "left_semi")


def dataset(bars: DataFrame, horizon: int = 5, at: str | None = None) -> DataFrame:
    """Rows ready for training: no missing feature, target, split."""
    made = with_target(features(bars), horizon)
    return with_split(made.dropna("any", subset=[c for c in made.columns if c.startswith("feat_")] + ["target"]), at)


def complete(rows: DataFrame) -> DataFrame:
    """Rows without a missing value in any column."""
    return rows.dropna("any")


def between(rows: DataFrame, start=None, end=None, codes: list | None = None) -> DataFrame:
    """Rows from ``start`` on and before ``end``, of the codes of a list."""
    out = rows if start is None else rows.where(F.col("date") >= F.lit(start))
    out = out if end is None else out.where(F.col("date") < F.lit(end))
    return out if codes is None else out.where(F.col("code").isin(list(codes)))


def matrix(made: DataFrame) -> DataFrame:
    """``made`` with its ``feat_`` columns, by name, as one vector ``features``."""
    return VectorAssembler(inputCols=sorted(c for c in made.columns if c.startswith("feat_")), outputCol="features").transform(made)


def report(made: DataFrame, codes: DataFrame) -> DataFrame:
    """Per code: rows and share of rising targets by split; ``ok`` or ``skipped``."""
    sums = made.groupBy("code").agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
        F.avg(F.when(F.col("split") == "train", F.col("target"))).alias("up_train"),
        F.avg(F.when(F.col("split") == "test", F.col("target"))).alias("up_test"),
    )
    return codes.select("code").distinct().join(sums, "code", "left").withColumn("status", F.when(F.col("n_train") > 0, "ok").otherwise("skipped"))
