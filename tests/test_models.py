"""Expanding fits against least squares on the rows known by then; the logistic model against Newton's method."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelgrove.operators import models
from panelgrove.plans import studies


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for i in range(600):
        day = datetime.date(2026, 1, 1) + datetime.timedelta(days=i % 200)
        x = rng.normal(size=3)
        y = float(0.5 + x @ [1.0, -2.0, 0.1] + rng.normal()) if i % 17 else None
        out.append((i, day, float(x[0]), float(x[1]) if i % 29 else None, float(x[2]), y, day + datetime.timedelta(days=3)))
    df = spark.createDataFrame(out, "code int, date date, a double, b double, c double, y double, later date")
    return df.withColumns({"period": F.date_trunc("month", "date").cast("date"), "known": F.date_trunc("month", "later").cast("date")})


def test_every_period_is_fitted_on_what_was_known(rows):
    got = {r["period"]: r for r in models.expanding_fits(rows, ["a", "b", "c"], "y", "known", rows.select("period")).collect()}
    full = rows.toPandas()
    assert set(got) == set(full["period"])
    for p, r in got.items():
        part = full[(full["known"] < p)].dropna(subset=["a", "b", "c", "y"])
        assert r["n"] == len(part)
        if len(part) > 4:
            want = np.linalg.lstsq(np.column_stack([np.ones(len(part)), part[["a", "b", "c"]]]), part["y"], rcond=None)[0]
            np.testing.assert_allclose([r["intercept"], r["b_a"], r["b_b"], r["b_c"]], want, rtol=1e-9)
        else:
            assert r["b_a"] is None


def test_predictions(rows):
    out = models.walk_forward(rows, ["a", "b", "c"], "y", "known", "period")
    assert out.count() == rows.count() and out.columns == [*rows.columns, "prediction"]
    fits = {r["period"]: r for r in models.expanding_fits(rows, ["a", "b", "c"], "y", "known", rows.select("period")).collect()}
    for r in out.limit(50).collect():
        f = fits[r["period"]]
        if f["b_a"] is None or r["b"] is None:
            assert r["prediction"] is None
        else:
            assert r["prediction"] == pytest.approx(f["intercept"] + f["b_a"] * r["a"] + f["b_b"] * r["b"] + f["b_c"] * r["c"])


def test_dependent_features_have_no_model(rows):
    both = rows.withColumn("twice", F.col("a") * 2)
    fits = models.expanding_fits(both, ["a", "twice"], "y", "known", both.select("period")).collect()
    assert fits and all(r["b_a"] is None and r["intercept"] is None for r in fits)
    assert models.expanding_fits(rows.limit(0), ["a"], "y", "known", rows.limit(0).select("period")).count() == 0


def test_logistic_model(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 2)) * [1, 20] + [0, 5]
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.05])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(t), "train" if i < 400 else "test") for i, ((a, b), t) in enumerate(zip(x, y))], "feat_a double, feat_b double, target int, split string")
    scored = studies.trained(df).transform(df)
    got = scored.select(studies.vector_to_array("probability")[1].alias("p")).toPandas()["p"].to_numpy()
    z, w = np.column_stack([np.ones(400), x[:400]]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (y[:400] - p))
    np.testing.assert_allclose(got, 1 / (1 + np.exp(-np.column_stack([np.ones(500), x]) @ w)), atol=1e-4)
