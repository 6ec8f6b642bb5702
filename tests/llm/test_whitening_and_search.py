"""Whitening against a plain eigendecomposition, reversed search against scoring every pair."""

import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from panelgrove.llm import lexical, whitening


def plainly(rows, k=32):
    """{row number: (deviation, whitened)}, eigenvalues, explained: by an eigendecomposition."""
    x = np.floor(64 * np.array(rows, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(axis=1), c @ u / np.sqrt(e), e / np.trace(c.T @ c / n)


@pytest.mark.parametrize("n, d", [(400, 64), (300, 7), (50, 1)])
def test_whitening(spark, n, d):
    rng = np.random.default_rng(n)
    rows = (rng.normal(size=(n, d)) * np.linspace(2, 0.3, d)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, r.tolist(), 1.0) for i, r in enumerate(rows)], "vec_id long, embedding array<float>, whitened double").repartition(5)
    got = whitening.whiten(df).toPandas()
    deviation, white, share = plainly(rows)
    k = min(32, d)
    assert len(got) == n * k and set(got["n"]) == {n} and got["identity_error"].max() < 1e-10
    assert (got[got["component"] == 1].set_index("vec_id")["deviation"].loc[range(n)].to_numpy() == deviation).all()
    own = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(n), range(1, k + 1)].to_numpy()
    sign = np.sign((own * white).sum(axis=0))
    np.testing.assert_allclose(own, white * sign, atol=1e-8)
    np.testing.assert_allclose(got.groupby("component")["explained"].first().loc[range(1, k + 1)], share, rtol=1e-10)


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, -1.0]), (4, [3.0, 0.0]), (5, None), (6, []), (7, [1.0, None]), (8, [1.0, math.nan]), (9, [math.inf, 1.0]), (10, [1e300, 1.0]), (11, [1.0]), (12, [2.0]), (13, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df).toPandas()
    assert sorted(got["vec_id"].fillna(-1).astype(int)) == [-1, -1, 1, 1, 1, 1, 4, 4, 11, 12, 13]
    assert set(got[got["vec_id"] == 11]["n"]) == {3} and set(got[got["vec_id"] == 4]["n"]) == {4}
    assert got["identity_error"].max() < 1e-10
    for part in (df.limit(0), df.where("vec_id = 5"), df.where("vec_id = 4")):  # nothing varies in one row
        assert whitening.whiten(part).count() == 0


def test_leading_vectors():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(60, 60)))
    for v in (np.eye(60), q @ np.diag(np.repeat([9.0, 8.0, 8.0 - 1e-9, 4.0], 15)) @ q.T, np.cov(rng.normal(size=(60, 25)))):
        e, u = whitening.leading(v, 32)
        own = np.linalg.eigvalsh(v)[::-1][:32]
        assert len(e) == (own > 1e-11 * own[0]).sum()
        np.testing.assert_allclose(e, own[: len(e)], rtol=1e-9)
        np.testing.assert_allclose(u.T @ u, np.eye(len(e)), atol=1e-12)
        np.testing.assert_allclose(v @ u, u * e, atol=1e-12)


def test_inertia_counts():
    rng = np.random.default_rng(4)
    v = np.cov(rng.normal(size=(30, 100)))
    form, own = whitening.tridiagonal(v), np.linalg.eigvalsh(v)
    for at in [-1.0, *np.linspace(own[0], own[-1], 41) + 1e-7, 99.0]:
        assert whitening.inertia(form, at) == (own > at).sum()


def test_exact_products():
    rng = np.random.default_rng(6)
    for size in (100, 2**33):
        y = rng.integers(-size, size, (40, 5)).astype(float)
        want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(5)] for i in range(5)]
        assert whitening._products(y).tolist() == want
    s = whitening.Sums(3, [1, 2], np.array([[5, 1], [1, 9]], object))
    assert s.covariance()[1, 1] == float(Fraction(3 * 9 - 4, 9))


def ranked(docs, items, k=10):
    """Every pair scored, term by term."""
    words = [(i, re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in docs]
    n, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    out = []
    for i, uses in asked.items():
        best = []
        for d, w in words:
            tf, m = Counter(w), 25 + (75 * len(w) * n) // max(1, total)
            score = sum(u * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, u in uses.items() if tf[t])
            if score > 0 and d is not None:
                best.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(best)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("postings", [500_000, 20])
def test_search(spark, monkeypatch, postings):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(lexical, "CHUNK", 64)
    rng = np.random.default_rng(9)
    vocab = ["Apfel", "b", "c3", "the", "THE", "ünder", "日本", "x-y", "z.", "q"] + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(vocab, int(rng.integers(1, 40)), p=None))) for i in range(300)]
    docs += [(7, docs[7][1]), (500, docs[8][1]), (None, "w1 w2 w3"), (501, None), (502, ""), (503, "?! -"), (504, "w5 " * 5000)]
    items = [(i, " ".join(rng.choice(vocab, 12))) for i in range(25)] + [(3, "w1 w1 the"), (None, "w9 Apfel"), (30, None), (31, "never seen"), (32, "")]
    d = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, score int, item string").repartition(6)
    q = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id int, text string, id int")
    got = sorted((tuple(r) for r in lexical.search(d, q).collect()), key=repr)
    assert got == ranked(docs, items)
    few = sorted((tuple(r) for r in lexical.search(d, q, k=2).collect()), key=repr)
    assert few == ranked(docs, items, 2)


def test_search_in_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0
    assert lexical.search(d.where("false"), q.where("false")).columns == ["item_id", "rank", "doc_id", "score"]
    assert [tuple(r) for r in lexical.search(d, q).collect()] == [("i", 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 8 * 100)))]
