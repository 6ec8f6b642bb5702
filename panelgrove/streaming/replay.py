"""Trade replay on a stream of bars: the same fills as :func:`panelgrove.operators.replay.fills` gives at once.

Bars of a (run, code) must arrive in time order from one micro-batch to the next; inside a batch they are
sorted. The state of a (run, code) is its account and the wish of its last bar, which fills at the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.replay import ACTIONS, CASH, FEE, traded

_KEY = ("run_id", "code")
_STATE = "cash double, shares double, paid double, act string"


def stream_fills(bars: DataFrame, cash: float = CASH, fee: float = FEE) -> DataFrame:
    """Trades at the next bar's opening price (its closing price where there is none), as they fill."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        money, shares, paid, act = state.get if state.exists else (cash, 0.0, 0.0, None)
        rows = pd.concat(list(frames)).sort_values("date", kind="stable")
        if not rows["action"].isin(ACTIONS).all():
            raise ValueError(f"unknown action: {sorted(set(rows['action'].map(str)) - set(ACTIONS))}")
        wishes = [act, *rows["action"].tolist()]
        prices = rows["open"].fillna(rows["close"]).tolist()
        orders = [(d, a, p) for d, a, p in zip(rows["date"], wishes, prices) if a in ("BUY", "SELL") and p > 0]
        out, money, shares, paid = traded(orders, money, shares, paid, fee)
        state.update((money, shares, paid, wishes[-1]))
        made = pd.DataFrame(out, columns=["date", "action", "price", "qty", "pnl", "cash", "shares"])
        made.insert(0, "code", key[1])
        made.insert(0, "run_id", key[0])
        yield made

    kinds = dict(bars.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in (*_KEY, "date")] + ["action string", "price double", "qty double", "pnl double", "cash double", "shares double"])
    return bars.groupBy(*_KEY).applyInPandasWithState(fold, schema, _STATE, "append", GroupStateTimeout.NoTimeout)
