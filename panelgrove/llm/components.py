"""Connected components of a graph given as an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every vertex of ``edges`` (a, b), ``comp`` being the smallest id reachable.

    Each round takes the smallest label among a vertex and its neighbours and then the label of
    that label, so labels travel twice as far with every round. Minima are pre-aggregated before
    the shuffle, so a vertex with very many neighbours is no hot group. Rounds go on until no
    label changes: the result is exact.
    """
    both = settle(
        edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select("b", "a")).where("src <> dst").distinct(), "edges"
    )
    labels = settle(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("near")).select("id", F.least("id", "near").alias("comp")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("dst"), F.col("comp").alias("theirs")), "dst")
            .groupBy(F.col("src").alias("id"))
            .agg(F.min("theirs").alias("theirs"))
        )
        step = labels.join(near, "id").select("id", "comp", F.least("comp", "theirs").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("comp").alias("far"))
        moved = settle(step.join(jump, "next").select("id", F.least("next", "far").alias("comp"), (F.least("next", "far") < F.col("comp")).alias("changed")), "labels")
        labels = moved.select("id", "comp")
        if not moved.filter("changed").limit(1).count():
            return labels


def merge(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Labels (id, comp) after adding ``edges`` to a graph whose components are ``labels``."""
    if labels is None:
        return components(edges)
    known_a = labels.select(F.col("id").alias("a"), F.col("comp").alias("ca"))
    known_b = labels.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    between = edges.join(known_a, "a", "left").join(known_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    fresh = components(between.where("a <> b").distinct())
    old = labels.join(fresh.select(F.col("id").alias("comp"), F.col("comp").alias("new")), "comp", "left").select("id", F.coalesce("new", "comp").alias("comp"))
    lone = fresh.join(labels, "id", "left_anti")
    return settle(old.unionByName(lone), "labels")
