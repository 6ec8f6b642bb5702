"""Fills folded over the orders that can fill, against the fold over every order."""

import datetime

import numpy as np
import pytest

from panelgrove.operators import replay


@pytest.mark.parametrize("fill", ["next_open", "same_close"])
@pytest.mark.parametrize("cash", [1e7, 70.0])
def test_fills(spark, fill, cash):
    rng = np.random.default_rng(int(cash))
    rows = []
    for code in ("a", "b", "c"):
        for i in range(700):
            price = float(np.round(60 + 15 * np.sin(i / 9) + rng.normal(), 2))
            action = str(rng.choice(["BUY", "SELL", "HOLD"], p=[0.5, 0.3, 0.2] if code != "c" else [0.02, 0.02, 0.96]))
            rows.append(("r", code, datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=i), None if i % 50 == 3 else price, 0.0 if i % 90 == 5 else price + 0.5, action))
    df = spark.createDataFrame(rows, "run_id string, code string, date timestamp, open double, close double, action string").repartition(5)
    got = sorted(map(tuple, replay.fills(df, fill, cash=cash).collect()))
    want = []
    for code in ("a", "b", "c"):
        own = [r for r in rows if r[1] == code]
        if fill == "next_open":
            orders = [(b[2], a[5], b[4] if b[3] is None else b[3]) for a, b in zip(own, own[1:])]
        else:
            orders = [(r[2], r[5], r[4]) for r in own]
        made, *_ = replay.traded([o for o in orders if o[1] != "HOLD" and o[2] > 0], cash, 0.0, 0.0, replay.FEE)
        want += [("r", code, *m) for m in made]
    assert len(want) > 100 and len(got) == len(want)
    for x, y in zip(got, sorted(want)):
        assert x[:4] == y[:4] and x[4:] == pytest.approx(y[4:])


def test_few_orders_are_folded(spark):
    rows = [("r", 1, datetime.date(2026, 1, 1) + datetime.timedelta(days=i), 10.0, 10.0, "BUY" if i < 300 else "SELL") for i in range(600)]
    df = spark.createDataFrame(rows, "run_id string, code int, date date, open double, close double, action string")
    assert replay.orders_of(df).count() == 2
    plan = replay.fills(df)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan
