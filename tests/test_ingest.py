"""What the gate rejects and why, files of differing columns, results that are there whole or not at all."""

import datetime
import math
import os

import pytest
from pyspark.sql import functions as F

from panelgrove.operators import ingest
from panelgrove.sources import bars
from panelgrove.sources.written import publish

D = datetime.date(2026, 1, 1)
SCHEMA = "code string, date date, open double, high double, low double, close double, volume double, name string"


def row(code="a", date=D, o=1.0, h=2.0, low=1.0, c=1.5, v=10.0, name="x"):
    return code, date, o, h, low, c, v, name


@pytest.mark.parametrize(
    "bad, reason",
    [
        (row(code=None), "no key"),
        (row(date=None), "no key"),
        (row(h=0.5), "high below low"),
        (row(o=0.0), "open not positive"),
        (row(c=-1.0), "close not positive"),
        (row(v=-1.0), "negative volume"),
    ],
)
def test_reasons(spark, bad, reason):
    panel, rejects = ingest.gate(spark.createDataFrame([row(code="good"), bad, bad], SCHEMA))
    assert [r["code"] for r in panel.collect()] == ["good"]
    got = rejects.collect()
    assert [(r["reason"], r["n"]) for r in got] == [(reason, 2)] and tuple(got[0])[:8] == bad


def test_missing_numbers_become_null(spark):
    panel, rejects = ingest.gate(spark.createDataFrame([row(o=math.nan, c=math.inf, v=None), row(code="b", h=-math.inf)], SCHEMA))
    got = {r["code"]: r for r in panel.collect()}
    assert got["a"]["open"] is None and got["a"]["close"] is None and got["a"]["volume"] is None and got["b"]["high"] is None
    assert rejects.count() == 0


def test_repeated_keys(spark):
    rows = [row()] * 1000 + [row(c=1.25), row(c=1.25, name=None), row(code="b")]
    panel, rejects = ingest.gate(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert {(r["code"], r["close"], r["name"]) for r in panel.collect()} == {("a", 1.25, None), ("b", 1.5, "x")}
    assert {(r["close"], r["name"], r["n"], r["reason"]) for r in rejects.collect()} == {(1.5, "x", 1000, "repeated key"), (1.25, "x", 1, "repeated key")}
    empty, none = ingest.gate(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 == none.count() and empty.columns == panel.columns


def test_files_of_differing_columns(spark, tmp_path):
    (tmp_path / "000660.csv").write_text("datetime,open,high,low,close,volume\n2026-01-01 09:00:00,1,2,1,1.5,10\n2026-01-01 09:01:00,1,nan,x,inf,\n")
    (tmp_path / "005930.csv").write_text('﻿"close","datetime",name\r\n7.5,2026-01-02,abc\r\n\r\n8.5,2026-01-03,abc\r\n')
    (tmp_path / "empty.csv").write_text("datetime,close\n")
    got = {(r["code"], r["datetime"]): r for r in bars.read_csv_folder(spark, str(tmp_path)).collect()}
    assert len(got) == 4
    first = got["000660", datetime.datetime(2026, 1, 1, 9)]
    assert (first["open"], first["close"], first["volume"]) == (1.0, 1.5, 10.0)
    second = got["000660", datetime.datetime(2026, 1, 1, 9, 1)]
    assert second["high"] is None and second["low"] is None and second["close"] is None and second["volume"] is None
    other = got["005930", datetime.datetime(2026, 1, 2)]
    assert other["close"] == 7.5 and other["open"] is None
    assert {r["code"] for r in bars.read_csv_folder(spark, str(tmp_path), ["005930"]).collect()} == {"005930"}


@pytest.mark.parametrize("kind, options", [("parquet", {}), ("csv", {"header": True}), ("json", {})])
def test_results_are_whole_or_not_there(spark, tmp_path, kind, options):
    path = str(tmp_path / "census")
    rows = spark.range(100).withColumn("op", F.lit("x"))
    broken = rows.repartition(4).withColumn("op", F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("op")))
    with pytest.raises(Exception, match="broken"):
        publish(broken, path, kind, **options)
    assert os.listdir(tmp_path) == []
    publish(rows, path, kind, **options)
    assert spark.read.format(kind).options(**options).load(path).count() == 100 and os.listdir(tmp_path) == ["census"]
    with pytest.raises(FileExistsError):
        publish(rows, path, kind, **options)
    assert spark.read.format(kind).options(**options).load(path).count() == 100
