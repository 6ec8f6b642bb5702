"""Bars in any order of arrival give the fills of the batch; idle accounts are closed."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelgrove.operators import replay
from panelgrove.streaming.late import late_stream_fills

SCHEMA = "run_id string, code string, date timestamp, open double, close double, action string"
START = datetime.datetime(2026, 1, 1)


def streamed(spark, tmp_path, batches, **how):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        for f in (tmp_path / f"b{i}").glob("*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            f.rename(tmp_path / "in" / f"{i:03d}.parquet")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = late_stream_fills(stream, "40 minutes", **how)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).where("code <> 'end'").collect()))


def bars(rng, code, n):
    return [("r", code, START + datetime.timedelta(minutes=i), float(p) if i % 7 else None, float(p) + 1, str(a)) for i, (p, a) in enumerate(zip(rng.uniform(50, 150, n), rng.choice(["BUY", "SELL", "HOLD"], n)))]


def test_shuffled_bars(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [b for c in ("a", "b") for b in bars(rng, c, 90)]
    at = [(b[2] - START).seconds / 60 + rng.uniform(0, 30) for b in rows]
    order = [rows[i] for i in np.argsort(at)]
    end = [("r", "end", START + datetime.timedelta(days=1), 1.0, 1.0, "HOLD")]
    batches = [order[i::1][k * 45 : (k + 1) * 45] for i in (0,) for k in range(4)] + [end, [(*end[0][:2], START + datetime.timedelta(days=2), *end[0][3:])]]
    assert any(x[2] > y[2] for x, y in zip(order, order[1:]))
    want = sorted(map(tuple, replay.fills(spark.createDataFrame(rows, SCHEMA)).collect()))
    got = streamed(spark, tmp_path, batches)
    assert len(want) > 20 and [x[:4] for x in got] == [x[:4] for x in want]
    for x, y in zip(got, want):
        assert x[4:] == pytest.approx(y[4:])


def test_idle_accounts_are_closed(spark, tmp_path):
    one = lambda code, minute, action: ("r", code, START + datetime.timedelta(minutes=minute), 100.0, 100.0, action)
    # Bought at once; two days later the account is gone, so the sale has nothing to sell.
    batches = [[one("a", 0, "BUY"), one("a", 1, "HOLD")], [one("end", 100, "HOLD")], [one("end", 2000, "HOLD")], [one("end", 2001, "HOLD")], [one("a", 2880, "SELL"), one("a", 2881, "HOLD")], [one("end", 4000, "HOLD")], [one("end", 5000, "HOLD")]]
    got = streamed(spark, tmp_path, batches, idle_ms=12 * 3_600_000)
    assert [(x[1], x[3]) for x in got] == [("a", "BUY")]


def test_depends_on_known_actions(spark, tmp_path):
    with pytest.raises(Exception, match="unknown action"):
        streamed(spark, tmp_path, [[("r", "a", START, 1.0, 1.0, "JUMP")]])
