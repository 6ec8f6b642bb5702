"""Trade replay on a stream whose bars may come late and in any order.

Bars wait in state until the watermark has passed them; a timer at the earliest of them then replays all that are final, in
time order. So the fills are those of :func:`panelgrove.operators.replay.fills` over the bars that are no later than the
watermark allows, whatever the order of arrival. Bars behind the watermark are dropped, as are bars not after the last
one replayed. With ``idle``, an account without bars for so long is closed and its state removed; bars that
come later open a new one. The session needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.replay import ACTIONS, CASH, FEE, traded

_KEY = ("run_id", "code")
_OUT = ["date", "action", "price", "qty", "pnl", "cash", "shares"]


def _ms(t) -> int:
    """Milliseconds, rounded up: a timer must not fire before its bar is final."""
    return -(-pd.Timestamp(t).value // 1_000_000)


class Replay(StatefulProcessor):
    def __init__(self, cash: float, fee: float, idle_ms: int | None):
        self.cash, self.fee, self.idle = cash, fee, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getValueState("account", "cash double, shares double, paid double, act string, last timestamp")
        self.waiting = handle.getListState("waiting", "date timestamp, open double, close double, action string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        if not new["action"].isin(ACTIONS).all():
            raise ValueError(f"unknown action: {sorted(set(new['action'].map(str)) - set(ACTIONS))}")
        self.waiting.appendList([(d.to_pydatetime(), _number(o), _number(c), a) for d, o, c, a in zip(new["date"], new["open"], new["close"], new["action"])])
        self.handle.registerTimer(_ms(new["date"].min()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        money, shares, paid, act, last = self.account.get() if self.account.exists() else (self.cash, 0.0, 0.0, None, None)
        bars = sorted(self.waiting.get(), key=lambda b: b[0]) if self.waiting.exists() else []
        due = [b for b in bars if _ms(b[0]) <= now and (last is None or b[0] > last)]
        left = [b for b in bars if _ms(b[0]) > now]
        if not bars:
            if self.idle is not None and last is not None and _ms(last) + self.idle <= now:
                self.account.clear()
            return
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(_ms(left[0][0]))
        else:
            self.waiting.clear()
        if not due:
            return
        wishes = [act, *(b[3] for b in due)]
        prices = [c if o is None else o for _, o, c, _ in due]
        orders = [(b[0], w, p) for b, w, p in zip(due, wishes, prices) if w in ("BUY", "SELL") and p is not None and p > 0]
        out, money, shares, paid = traded(orders, money, shares, paid, self.fee)
        self.account.update((money, shares, paid, wishes[-1], due[-1][0]))
        if self.idle is not None:
            self.handle.registerTimer(_ms(due[-1][0]) + self.idle)
        if out:
            made = pd.DataFrame(out, columns=_OUT)
            made.insert(0, "code", key[1])
            made.insert(0, "run_id", key[0])
            yield made

    def close(self) -> None:
        pass


def _number(x) -> float | None:
    return None if pd.isna(x) else float(x)


def late_stream_fills(bars: DataFrame, delay: str, idle_ms: int | None = None, cash: float = CASH, fee: float = FEE) -> DataFrame:
    """Trades at the next bar's opening price of a stream (run_id, code, date: timestamp, open, close, action) whose
    bars are up to ``delay`` late."""
    kinds = dict(bars.dtypes)
    numbers = ", ".join(f"{c} double" for c in ("price", "qty", "pnl", "cash", "shares"))
    schema = f"run_id {kinds['run_id']}, code {kinds['code']}, date timestamp, action string, {numbers}"
    rows = bars.select(*_KEY, "date", "open", "close", "action").withWatermark("date", delay)
    return rows.groupBy(*_KEY).transformWithStateInPandas(Replay(cash, fee, idle_ms), schema, "Append", "EventTime")
