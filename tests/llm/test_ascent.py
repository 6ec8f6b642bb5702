"""Where queries of clustered vectors are answered, and how well."""

from collections import Counter

import numpy as np
import pytest

from panelgrove.llm import nearest


@pytest.mark.parametrize("size, noise, seed", [(100, 0.3, 501), (250, 0.38, 502)])
def test_clustered_queries_stay_in_the_trees(spark, monkeypatch, size, noise, seed):
    monkeypatch.setattr(nearest, "ROW_BLOCK", 64)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 5)
    rng, n, k = np.random.default_rng(seed), 6000, 10
    c = rng.normal(size=(n // size, 64))
    c /= np.linalg.norm(c, axis=1)[:, None]
    x = (np.repeat(c, size, axis=0) + rng.normal(size=(n, 64)) * noise / 8)[rng.permutation(n)]
    x[20], x[33] = x[7], x[7]  # equal vectors
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    out = nearest.search(df, df.where("vec_id % 60 = 0 or vec_id = 7"), k=k).toPandas()
    where = Counter(out.drop_duplicates("query_id")["reached"])
    assert where["root"] <= 0.1 * sum(where.values()) and where["ascent"] > 0
    recall = []
    for q, part in out.groupby("query_id"):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        assert part.sort_values("rank")["rank"].tolist() == list(range(1, k + 1)) and part["vec_id"].is_unique
        np.testing.assert_array_equal(part["score"], nearest.scores(x[part["vec_id"]], x[[q] * k]))
        recall.append(len(set(part["vec_id"]) & set(np.argsort(-s, kind="stable")[:k])) / k)
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.5
    assert out[(out["query_id"] == 7) & (out["rank"] <= 2)].sort_values("rank")["vec_id"].tolist() == [20, 33]
