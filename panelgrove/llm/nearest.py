"""Nearest vectors by a hash-prefix forest.

Each of ``TREES`` trees hashes every vector to a string of ``BITS`` random-hyperplane bits and sorts the
strings; trees hold ids only. Vectors that share a prefix with a query stand next to it, so descending to
the query's own place meets its longest-prefix matches, however long these are there, and walking up to
``REACH`` rows to both sides, in all trees at once, ascends to shorter prefixes. All rows met are scored
on the original vectors. How far each tree has been seen (every row that shares a prefix of so many bits
has been met) gives the probability that a vector as near as the k-th best would have been missed by
all trees; a query is done where that is at most ``1 - RECALL``.

The others ascend, in all trees at once, to the longest prefix at which that probability suffices for a vector as near as
their k-th best so far: its length follows from the angle, and every row that shares such a prefix in any tree is scored, a
prefix's rows and queries in blocks. Prefixes so short that all trees together would hold more than ``SHARE`` of the
rows are no saving: those queries go to the root, the empty prefix, meet all rows in blocks of at most ``QUERY_BLOCK`` queries
and ``ROW_BLOCK`` rows, and so are exact. ``reached`` says which of the three it was. Clustered queries are done in
the trees; among vectors without near neighbours (cosines below 0.5 in 64 dimensions) no prefix is long
enough to tell them from the rest at this recall, and all go to the root: work in proportion to
queries times rows, data moved in proportion to that divided by the block sizes.

For the largest inner product, vectors are lifted to the unit sphere by the largest norm first.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows without id; only vectors of equal length are compared; a query never finds its own
id; of rows that share an id the smallest vector counts; scores are summed in one order, so equal
vectors score equal and ties go to the smaller id; of equal vectors only the ``k + 1`` with the
smallest ids can be answers; with fewer than k candidates all are returned; empty tables give none;
other columns of the tables are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, short_batches, table

TREES, BITS, REACH, RECALL = 16, 48, 16, 0.99
QUERY_BLOCK, ROW_BLOCK = 4096, 8192
#: Rows of all trees' prefixes together, as a share of all rows, up to which a query ascends to a prefix; prefix lengths
#: that it may ascend to.
SHARE, LEVELS = 0.5, (5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 32, 40, 48)
#: Queries are broadcast if all together hold so many numbers at most (32 MB), and shuffled otherwise.
BROADCAST_NUMBERS = 4_000_000
#: Rows of a sorted order that are looked at together.
CHUNK = 8192
#: Scores of matrix products closer than this share of the largest possible one may tie.
CLOSE = 1e-12


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products row by row, each summed in the same order."""
    return np.ascontiguousarray(x * y).sum(axis=1)


def _hashes(x: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(rows, TREES) hash strings as numbers of unit vectors (x, last)."""
    p = np.random.Generator(np.random.PCG64(97 + x.shape[1])).standard_normal((TREES * BITS, x.shape[1] + 1))
    bits = (x @ p[:, :-1].T + last[:, None] * p[:, -1] > 0).reshape(len(x), TREES, BITS)
    return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _by_length(v: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) for each vector length of a batch."""
    sizes = v.value_lengths().to_numpy()
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


def _hashed(vectors: DataFrame, top: float, asked: bool) -> DataFrame:
    """(tree, hash, asked, id) for each row and tree; trees of vectors of length d are numbered from
    d * TREES. Rows are lifted by ``top``, the largest norm; queries (``asked``) are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            for rows, x in _by_length(b.column("v")):
                norm = np.linalg.norm(x, axis=1)
                h = _hashes(x / norm[:, None], np.zeros(len(x))) if asked else _hashes(x / top, np.sqrt(np.maximum(0, 1 - (norm / top) ** 2)))
                tree = np.broadcast_to(x.shape[1] * TREES + np.arange(TREES), h.shape)
                cols = [tree.ravel(), h.ravel(), np.full(h.size, asked), np.repeat(ids[rows], TREES)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["tree", "hash", "asked", "id"])

    return vectors.mapInArrow(run, "tree long, hash long, asked boolean, id long")


def _common_prefix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal leading bits of hash strings."""
    return BITS - np.frexp((x ^ y).astype(np.float64))[1]


def _met(entries: DataFrame) -> DataFrame:
    """(id, vec_id, tree, seen): the rows that each query meets in each tree; all rows that share a
    prefix of ``seen`` bits with it are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "hash", "asked", "id"]
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
        waiting: list[list[np.ndarray]] = [[] for _ in names]
        n = first = 0  # rows of held before ``first`` are answered queries, or rows of the data

        def look(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting, n, first
            tree, h, asked, ids = held = [np.concatenate([x, *w]) for x, w in zip(held, waiting)]
            waiting, n = [[] for _ in names], 0
            data = np.flatnonzero(~asked)
            q = first + np.flatnonzero(asked[first:])
            rank = np.searchsorted(data, q)
            ready = np.full(len(q), True) if final else rank + REACH <= len(data)
            left = q[~ready]
            first = int(left[0]) if len(left) else len(asked)
            q, rank = q[ready], rank[ready]
            if len(q) and len(data):
                at = rank[:, None] + np.arange(-REACH, REACH)
                inside = (at >= 0) & (at < len(data))
                row = data[np.clip(at, 0, len(data) - 1)]
                inside &= tree[row] == tree[q][:, None]
                shared = _common_prefix(h[row], h[q][:, None])
                # The outermost rows met bound what is unseen; where a side is empty nothing is known.
                before, after = np.where(inside, shared, BITS)[:, :REACH].min(axis=1), np.where(inside, shared, BITS)[:, REACH:].min(axis=1)
                before[~inside[:, :REACH].any(axis=1)] = BITS
                after[~inside[:, REACH:].any(axis=1)] = BITS
                seen = 1 + np.maximum(before, after)
                inside &= ids[row] != ids[q][:, None]
                who, which = np.nonzero(inside)
                cols = [ids[q][who], ids[row[who, which]], tree[q][who], seen[who]]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["id", "vec_id", "tree", "seen"])
            keep = data[max(0, int(np.searchsorted(data, first)) - REACH)] if len(data) > REACH else 0
            held, first = [x[keep:] for x in held], first - int(keep)

        for b in batches:
            for w, c in zip(waiting, names):
                w.append(b.column(c).to_numpy(zero_copy_only=False))
            n += b.num_rows
            if n >= CHUNK:
                yield from look(False)
        yield from look(True)

    ordered = entries.repartitionByRange("tree", "hash", "id").sortWithinPartitions("tree", "hash", "asked", "id")
    return ordered.mapInArrow(run, "id long, vec_id long, tree long, seen long")


def _rescored(met: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Scores of pairs (id, vec_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _by_length(b.column("v")):
                y = b.column("q").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(x.shape)
                cols = [b.column(c).take(pa.array(at)) for c in ("id", "vec_id")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(scores(x, y))], names=["id", "vec_id", "score"])

    pairs, asked = met.select("id", "vec_id").distinct(), asked.select("id", F.col("v").alias("q"))
    if asked.agg(F.coalesce(F.sum(F.size("q")), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_NUMBERS:
        asked = F.broadcast(asked)
    both = pairs.join(rows.select(F.col("id").alias("vec_id"), "v"), "vec_id").join(asked, "id")
    return both.mapInArrow(run, "id long, vec_id long, score double")


def _packed(vectors: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Blocks (dim, part, ids, data) of about ``size`` vectors of one length; parts are numbered from 0."""
    parts = max(1, -(-vectors.count() // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), {}
        for b in batches:
            ids = b.column("id").to_numpy()
            for rows, x in _by_length(b.column("v")):
                held.setdefault(x.shape[1], []).append((ids[rows], x))
        for d, own in held.items():
            row = (d, part, np.concatenate([i for i, _ in own]).tobytes(), np.concatenate([x for _, x in own]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in row], names=["dim", "part", "ids", "data"])

    dealt = vectors.repartition(parts)
    return settle(dealt.mapInArrow(run, "dim long, part long, ids binary, data binary"), "blocks"), parts


def _best_of(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Each query's k best rows, and what may tie with the last."""
    close = CLOSE * np.linalg.norm(x, axis=1).max()
    for at in range(0, len(q), 256):
        part, who = q[at : at + 256], own[at : at + 256]
        s = part @ x.T
        s[who[:, None] == ids[None, :]] = -np.inf
        least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(part), -np.inf)
        i, j = np.nonzero((s >= (least - close * np.linalg.norm(part, axis=1))[:, None]) & (s > -np.inf))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(who[i]), pa.array(ids[j]), pa.array(scores(x[j], part[i]))], names=["id", "vec_id", "score"])


def _all_rows(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Each query's k best rows of each block of rows (and what may tie with the last)."""
    blocks, n = _packed(rows, ROW_BLOCK)
    queries, m = _packed(asked, QUERY_BLOCK)
    spread = blocks.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select("dim", "part", "asked", "ids", "data")
    whole = queries.select("dim", F.col("part").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"), F.col("ids").alias("own"), F.col("data").alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, own = (np.frombuffer(b.column(c)[r].as_buffer(), np.int64) for c in ("ids", "own"))
                x, q = (np.frombuffer(b.column(c)[r].as_buffer(), np.float64).reshape(-1, b.column("dim")[r].as_py()) for c in ("data", "q"))
                yield from _best_of(x, ids, q, own, k)

    return spread.join(whole, ["dim", "part", "asked"]).mapInArrow(run, "id long, vec_id long, score double")


def _levels(best: DataFrame, asked: DataFrame, top: float, k: int) -> DataFrame:
    """(id, level): the prefix length that each query has to ascend to; 0 is the root."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    kth = best.where(F.col("rank") == k).select("id", "score")
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score") / (norm * top)))
    # A bit agrees with probability p; all trees miss a row with probability (1 - p^length)^TREES.
    p, enough = 1 - F.acos(cosine) / np.pi, float(np.log(1 - (1 - RECALL) ** (1 / TREES)))
    length = F.when(p >= 1, float(BITS)).otherwise(F.lit(enough) / F.log(p))
    fits = [lv for lv in LEVELS if TREES / 2**lv <= SHARE]
    level = F.coalesce(F.greatest(*[F.when(length >= lv, lv) for lv in fits]), F.lit(0))
    return asked.join(kth, "id", "left").select("id", "v", F.when(F.col("score").isNull(), 0).otherwise(level).alias("level"))


def _by_prefix(rows: DataFrame, asked: DataFrame, top: float, k: int) -> DataFrame:
    """Each query's k best (and what may tie) of every block of rows that share a prefix of its ``level`` bits with it."""
    key = ["tree", "level", "prefix"]
    used = sorted(r["level"] for r in asked.select("level").distinct().collect())

    def cut(entries: DataFrame, level) -> DataFrame:
        at = entries.withColumn("level", level)
        return at.select(*key[:2], F.expr(f"shiftright(hash, {BITS} - level)").alias("prefix"), "id")

    wanted = settle(cut(_hashed(asked.select("id", "v"), top, True).join(asked.select("id", F.col("level").alias("lv")), "id"), F.col("lv")), "wanted")
    buckets = wanted.select(*key).distinct()
    met = settle(cut(_hashed(rows, top, False), F.explode(F.array(*[F.lit(x) for x in used]))).join(buckets, key, "left_semi"), "prefixes")

    def blocks(entries: DataFrame, vectors: DataFrame, size: int, ids: str, data: str) -> DataFrame:
        parts = entries.groupBy(*key).agg(F.ceil(F.count("*") / size).alias("parts"))
        dealt = entries.join(parts, key).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).join(vectors.select("id", "v"), "id")
        return dealt.groupBy(*key, "part").agg(F.collect_list("id").alias(ids), F.flatten(F.collect_list("v")).alias(data)).drop("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, own, x, q = (b.column(c)[r].values.to_numpy() for c in ("ids", "own", "data", "q"))
                yield from _best_of(x.reshape(len(ids), -1), ids, q.reshape(len(own), -1), own, k)

    both = blocks(met, rows, ROW_BLOCK, "ids", "data").join(blocks(wanted, asked, QUERY_BLOCK, "own", "q"), key)
    return both.mapInArrow(run, "id long, vec_id long, score double").distinct()


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, reached): the k nearest of ``vectors`` found for each row of
    ``queries``; both hold ``vec_id`` and ``embedding``."""
    short_batches(vectors.sparkSession)
    v = F.col(embedding).cast("array<double>")
    usual = (d.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v"))) for d in (vectors, queries))
    rows, asked = (d.groupBy("id").agg(F.min("v").alias("v")) for d in usual)
    same = Window.partitionBy(F.xxhash64("v"), F.hash("v")).orderBy("id")
    rows = settle(rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).select("id", "v"), "vectors")
    asked = settle(asked, "asked")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    top = rows.agg(F.max(norm).alias("m")).first()["m"] or 1.0
    met = settle(_met(_hashed(rows, top, False).unionByName(_hashed(asked, top, True))), "met")
    best = settle(_first(_rescored(met, rows, asked), k), "best")
    # What all trees together miss at the angle of the k-th best.
    kth = best.where(F.col("rank") == k).select("id", "score").join(asked.select("id", norm.alias("norm")), "id")
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score") / (F.col("norm") * top)))
    seen = met.groupBy("id", "tree").agg(F.max("seen").alias("seen")).join(kth, "id")
    # A bit agrees with probability 1 - angle / pi; the smallest number stands for a certain hit.
    missed = F.sum(F.log(F.greatest(F.lit(1e-300), 1 - F.pow(1 - F.acos(cosine) / np.pi, F.col("seen")))))
    done = seen.groupBy("id").agg(missed.alias("missed")).where(F.col("missed") <= F.lit(float(np.log(1 - RECALL)))).select("id")
    left = settle(_levels(best, asked.join(done, "id", "left_anti"), top, k), "left")
    best = best.select("id", "vec_id", "score", F.lit("descent").alias("reached"))
    for name, part, find in (("ascent", left.where("level > 0"), lambda x: _by_prefix(rows, x, top, k)), ("root", left.where("level = 0"), lambda x: _all_rows(rows, x.select("id", "v"), k))):
        if part.limit(1).count():
            # An ascent adds to what the descent met; the root meets it again.
            before = best.join(part.select("id"), "id", "left_semi") if name == "ascent" else best.limit(0)
            found = before.select("id", "vec_id", "score").unionByName(find(part)).distinct()
            best = best.join(part.select("id"), "id", "left_anti").unionByName(found.withColumn("reached", F.lit(name)))
    return _first(best, k).select(F.col("id").alias("query_id"), "rank", "vec_id", "score", "reached")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.filter("vec_id % 20 = 0"))
