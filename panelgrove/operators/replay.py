"""Signals to trades, equity and metrics.

Bars need (run_id, code, date, open, close, action), ``date`` being a date or a timestamp and codes of any
type; actions are BUY, SELL and HOLD. An account is
all in or all out, and the number of shares depends on the cash so far, so fills are folded in time
order per (run, code): in one expression over the few orders that can fill. Everything else is windows and aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CASH, FEE, PERIODS = 10_000_000.0, 0.00015, 252
ACTIONS = ("BUY", "SELL", "HOLD")
_KEY = ("run_id", "code")


def _w():
    return Window.partitionBy(*_KEY).orderBy("date")


def ma_cross(short: int = 3, long: int = 6) -> Column:
    """BUY while the short mean is above the long one, SELL below; HOLD until ``long`` bars are there."""
    w = Window.partitionBy("code").orderBy("date")
    a, b = F.avg("close").over(w.rowsBetween(1 - short, 0)), F.avg("close").over(w.rowsBetween(1 - long, 0))
    ready = F.row_number().over(w) >= long
    return F.when(ready & (a > b), "BUY").when(ready & (a < b), "SELL").otherwise("HOLD")


def buy_and_hold() -> Column:
    return F.when(F.row_number().over(Window.partitionBy("code").orderBy("date")) == 1, "BUY").otherwise("HOLD")


def from_probability(p: Column, buy: float = 0.55, sell: float = 0.45) -> Column:
    return F.when(p >= buy, "BUY").when(p <= sell, "SELL").otherwise("HOLD")


def traded(orders: Iterable[tuple], money: float, shares: float, paid: float, fee: float) -> tuple[list[tuple], float, float, float]:
    """The fills of orders (date, act, price) in time order, and the account after them: cash, shares, and
    what was paid for these. For streams; tables are folded by :func:`fills`."""
    out = []
    for date, act, price in orders:
        if act == "BUY" and not shares:
            n = float(math.floor(money / (price * (1 + fee))))
            if n > 0:
                money -= n * price * (1 + fee)
                shares, paid = n, n * price * (1 + fee)
                out.append((date, act, price, n, None, money, shares))
        elif act == "SELL" and shares:
            got = shares * price * (1 - fee)
            money += got
            out.append((date, act, price, shares, got - paid, money, 0.0))
            shares = 0.0
    return out, money, shares, paid


def orders_of(bars: DataFrame, fill: str = "next_open") -> DataFrame:
    """What can fill: (run_id, code, date, act, price) of orders at a price. Of orders of one kind in a row, only the first
    SELL can, and those BUYs that are cheaper than all before them in the row (the others could not be paid
    either), so a position held for long is two orders, however many bars wish for it."""
    known = F.when(F.col("action").isin(*ACTIONS), F.col("action")).otherwise(F.raise_error(F.concat(F.lit("unknown action: "), F.coalesce("action", F.lit("null")))))
    bars = bars.withColumn("action", known)
    if fill == "next_open":
        bars = bars.withColumns({"act": F.lag("action", 1).over(_w()), "price": F.coalesce("open", "close")})
    elif fill == "same_close":
        bars = bars.withColumns({"act": F.col("action"), "price": F.col("close")})
    else:
        raise ValueError(fill)
    orders = bars.where("act in ('BUY', 'SELL') and price > 0").select(*_KEY, "date", "act", "price")
    turn = (F.col("act") != F.lag("act", 1, "").over(_w())).cast("long")
    islands = orders.withColumn("__turn", turn).withColumn("__island", F.sum("__turn").over(_w().rowsBetween(Window.unboundedPreceding, 0)))
    least = F.min("price").over(Window.partitionBy(*_KEY, "__island").orderBy("date").rowsBetween(Window.unboundedPreceding, -1))
    cheaper = islands.withColumn("__least", least)
    return cheaper.where("__least is null or (act = 'BUY' and price < __least)").select(*_KEY, "date", "act", "price")


#: Orders that are folded into one array of fills; arrays grow by copying, so long histories are folded in such runs.
RUN = 128


def fills(bars: DataFrame, fill: str = "next_open", cash: float = CASH, fee: float = FEE) -> DataFrame:
    """The trades: one row per fill with price, quantity, profit (missing for BUY), and the account after it."""
    orders = orders_of(bars, fill)
    kinds = dict(orders.dtypes)
    numbers = "price: double, qty: double, pnl: double, cash: double, shares: double"
    made = f"array<struct<date: {kinds['date']}, action: string, {numbers}>>"
    state = f"struct<cash: double, shares: double, paid: double, out: {made}, done: array<{made}>>"

    def step(s: Column, x: Column) -> Column:
        price, money, held = x["price"], s["cash"], s["shares"]
        n = money / (price * (1 + fee))
        n = F.when(n < 2.0**53, F.floor(n).cast("double")).otherwise(n)  # larger ones are whole
        buys, sells = (x["act"] == "BUY") & (held == 0) & (n > 0), (x["act"] == "SELL") & (held > 0)
        cost, got = n * price * (1 + fee), held * price * (1 - fee)
        left = F.when(buys, money - cost).otherwise(money + got)
        row = F.struct(
            x["date"].alias("date"), x["act"].alias("action"), price.alias("price"), F.when(buys, n).otherwise(held).alias("qty"), F.when(sells, got - s["paid"]).alias("pnl"),
            left.alias("cash"), F.when(buys, n).otherwise(0.0).alias("shares"),
        )
        after = F.struct(left.alias("cash"), F.when(buys, n).otherwise(0.0).alias("shares"), F.when(buys, cost).otherwise(s["paid"]).alias("paid"), F.concat(s["out"], F.array(row)).alias("out"), s["done"].alias("done"))
        return F.when(buys | sells, after.cast(state)).otherwise(s)

    def run(s: Column, orders: Column) -> Column:
        end = F.aggregate(orders, s, step)
        return F.struct(end["cash"].alias("cash"), end["shares"].alias("shares"), end["paid"].alias("paid"), F.array().cast(made).alias("out"), F.concat(end["done"], F.array(end["out"])).alias("done")).cast(state)

    start = F.struct(F.lit(cash).alias("cash"), F.lit(0.0).alias("shares"), F.lit(0.0).alias("paid"), F.array().cast(made).alias("out"), F.array().cast(f"array<{made}>").alias("done")).cast(state)
    each = orders.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("date", "act", "price"))).alias("o"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("o") - 1) / RUN)), lambda i: F.slice(F.col("o"), (i * RUN + 1).cast("int"), RUN))
    return each.select(*_KEY, F.inline(F.flatten(F.aggregate(runs, start, run)["done"])))


def equity(bars: DataFrame, trades: DataFrame, cash: float = CASH) -> DataFrame:
    """Each bar's worth: the cash and shares after the last fill, at the close."""
    after = trades.select(*_KEY, "date", "cash", "shares")
    w = _w().rowsBetween(Window.unboundedPreceding, 0)
    last = [F.coalesce(F.last(c, True).over(w), F.lit(d)).alias(c) for c, d in (("cash", cash), ("shares", 0.0))]
    return bars.join(after, [*_KEY, "date"], "left").select(*_KEY, "date", "close", *last).withColumn("equity", F.col("cash") + F.col("shares") * F.col("close"))


def metrics(curve: DataFrame, trades: DataFrame, periods: int = PERIODS) -> DataFrame:
    """Per run and code: total return, largest drawdown, Sharpe ratio, trades, share of winning sales."""
    w = _w()
    rows = curve.withColumns({"peak": F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)), "step": F.try_divide("equity", F.lag("equity", 1).over(w)) - 1})
    sums = rows.groupBy(*_KEY).agg(
        F.count("*").alias("n"),
        (F.try_divide(F.max_by("equity", "date"), F.min_by("equity", "date")) - 1).alias("r"),
        F.max(F.try_divide(F.col("peak") - F.col("equity"), F.col("peak"))).alias("d"),
        F.avg("step").alias("m"),
        F.stddev_samp("step").alias("s"),
    )
    log = trades.groupBy(*_KEY).agg(F.count("*").alias("k"), F.avg(F.when(F.col("action") == "SELL", (F.col("pnl") > 0).cast("double"))).alias("won"))
    return sums.join(log, list(_KEY), "left").select(
        *_KEY,
        F.when(F.col("n") < 2, 0.0).otherwise(F.col("r")).alias("total_return"),
        F.when(F.col("n") < 2, 0.0).otherwise(F.col("d")).alias("mdd"),
        F.when((F.col("n") < 3) | (F.col("s") == 0), 0.0).otherwise(F.col("m") / F.col("s") * periods**0.5).alias("sharpe"),
        F.coalesce("k", F.lit(0)).alias("n_trades"),
        F.coalesce("won", F.lit(0.0)).alias("win_rate"),
    )
