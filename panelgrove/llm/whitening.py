"""Whitening of embeddings on the leading eigenvectors of their covariance, found by contour integration.

Entries are quantised to integers, so the sums over all rows are exact: tasks add up integer outer products
(in doubles where a batch's products stay below 2^53, in Python integers beyond) and Spark adds the tasks'
cells as decimals. The covariance comes from these by one correctly rounded division a cell, which is what
centring first would give without any rounding. Only this matrix (size: dimensions squared) comes to the driver.

There its spectrum is cut into intervals of few eigenvalues by inertia counts (signs of the pivots of the
shifted matrix, in tridiagonal form). For each interval a random block is projected on the eigenvectors
inside by quadrature of complex shifted solves on a circle through the interval's ends; Rayleigh-Ritz takes
the pairs out of the projected block, which goes round again until their residuals are at rounding level
and their number is the interval's inertia count, so that none is missed. Vectors of all intervals then share one last
Rayleigh-Ritz step, which makes them orthogonal across the borders.

Projected rows are written to the shared folder and the deviation of their covariance from the identity is
measured on what was written.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, as are empty vectors
and those with an entry of 2^34 or more in size, whose squares could not be summed exactly; vectors of
each length are whitened for themselves, as a table of their own; repeated rows and rows without an id count
and come back as often as they occur; a component whose variance is below ``NOTHING`` of the largest one (as
with fewer rows than dimensions, or a constant table) can't be scaled to 1 and has no rows; of equal
eigenvalues any orthonormal vectors of their space are taken; a deviation beyond 64 bits is null; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, short_batches, table

STEP, OFFSET, LARGEST = 64, 1_000_000, 2.0**34
#: Eigenvalues of an interval at most, quadrature nodes on half a circle, and rounds before the block grows.
WIDTH, NODES, ROUNDS = 8, 8, 6
#: Share of the largest variance from which a component counts.
NOTHING = 1e-11


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    return v.isNotNull() & (F.size(v) > 0) & ~bad


def _by_length(v: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, quantised vectors less ``OFFSET``) for each vector length of a batch."""
    sizes = v.value_lengths().to_numpy()
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        x = v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
        yield rows, np.floor(STEP * x)


def _products(y: np.ndarray) -> np.ndarray:
    """Exact sums of outer products of integer rows, as Python integers where doubles can't hold them."""
    if len(y) * max(1.0, np.abs(y).max()) ** 2 < 2**53:
        return (y.T @ y).astype(np.int64).astype(object)
    z = y.astype(np.int64).astype(object)
    return z.T @ z


class Sums:
    """Exact sums of the vectors of one length: rows, entries, and products of entries."""

    def __init__(self, n: int, s: list[int], g: np.ndarray):
        self.n, self.s, self.g = n, s, g

    @property
    def d(self) -> int:
        return len(self.s)

    def covariance(self) -> np.ndarray:
        n = self.n
        return np.array([[(n * int(self.g[i, j]) - self.s[i] * self.s[j]) / (n * n) for j in range(self.d)] for i in range(self.d)])


def sums_of(rows: DataFrame) -> list[Sums]:
    """Sums by vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for _, y in _by_length(b.column("v")):
                own = held.setdefault(y.shape[1], [0, 0, 0])
                own[0] += len(y)
                own[1] = own[1] + y.astype(np.int64).sum(axis=0).astype(object)
                own[2] = own[2] + _products(y)
        for d, (n, s, g) in held.items():
            i, j = np.triu_indices(d)
            cells = [(-1, -1, n), *((-1, k, v) for k, v in enumerate(s)), *zip(i.tolist(), j.tolist(), g[i, j])]
            cols = [pa.array([d] * len(cells)), *(pa.array([c[k] for c in cells]) for k in (0, 1)), pa.array([Decimal(int(c[2])) for c in cells], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(cols, names=["d", "i", "j", "v"])

    cells = rows.select("v").mapInArrow(run, "d long, i long, j long, v decimal(38,0)").groupBy("d", "i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v"))
    found: dict[int, Sums] = {}
    for d, i, j, v in sorted(map(tuple, cells.toLocalIterator())):
        own = found.setdefault(d, Sums(0, [0] * d, np.zeros((d, d), object)))
        if i >= 0:
            own.g[i, j] = own.g[j, i] = int(v)
        elif j >= 0:
            own.s[j] = int(v)
        else:
            own.n = int(v)
    return list(found.values())


# Eigenvectors.


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of a tridiagonal matrix with the eigenvalues of ``v`` (reflections)."""
    a, d = v.copy(), len(v)
    for k in range(d - 2):
        x = a[k + 1 :, k]
        u = x.copy()
        u[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(u)
        if size == 0:
            continue
        u /= size
        a[k + 1 :, :] -= 2 * np.outer(u, u @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def inertia(form: tuple[np.ndarray, np.ndarray], at: float) -> int:
    """Eigenvalues above ``at``: the positive pivots of the shifted matrix."""
    n, pivot = 0, 1.0
    least = np.finfo(float).tiny * 1e8
    for a, b in zip(form[0], [0.0, *form[1]]):
        pivot = a - at - b * b / pivot
        if abs(pivot) < least:
            pivot = -least
        n += pivot > 0
    return n


def intervals(form: tuple[np.ndarray, np.ndarray], k: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) that hold the k largest eigenvalues, few in each."""
    side = np.abs(np.concatenate([[0.0], form[1], [0.0]]))
    reach = side[:-1] + side[1:]
    low, high = (form[0] - reach).min(), (form[0] + reach).max()
    size = max(abs(low), abs(high))
    pad = 1e-3 * (high - low) + 1e-9 * size
    todo, out = [(low - pad, high + pad, len(form[0]), 0)], []
    while todo:
        a, b, na, nb = todo.pop()  # na eigenvalues lie above a, nb above b
        if na == nb or nb >= k:
            continue
        if na - nb <= WIDTH or b - a < 1e-9 * size:
            out.append((a, b, na - nb))
            continue
        # Of several cuts near the middle the one that stays farthest from eigenvalues: its count is the same around it.
        cuts = a + (b - a) * np.linspace(0.35, 0.65, 9)
        counts = [inertia(form, c) for c in cuts]
        gap = max(range(len(cuts)), key=lambda i: (sum(counts[j] == counts[i] for j in range(len(cuts))), -abs(i - 4)))
        todo += [(a, cuts[gap], na, counts[gap]), (cuts[gap], b, counts[gap], nb)]
    return out


def _ritz(v: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, _ = np.linalg.qr(block)
    values, inner = np.linalg.eigh(q.T @ v @ q)
    return values, q @ inner


def inside(v: np.ndarray, low: float, high: float, count: int, rng: np.random.Generator) -> np.ndarray:
    """The ``count`` eigenvectors with eigenvalues from ``low`` to ``high``."""
    d, close = len(v), 4e-15 * np.linalg.norm(v)
    middle, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 - points))
    shifted = (middle + radius * turn)[:, None, None] * np.eye(d) - v
    for more in (2, 4, 8, d):
        size = min(d, more * count + 8)
        block = rng.standard_normal((d, size))
        for _ in range(ROUNDS):
            if size < d:
                solved = np.linalg.solve(shifted, np.broadcast_to(block, (NODES, d, size)))
                block = (weights[:, None, None] * (radius * turn[:, None, None] * solved).real).sum(axis=0)
            values, vectors = _ritz(v, block)
            off = np.linalg.norm(v @ vectors - vectors * values, axis=0)
            good = (values >= low) & (values <= high) & (off <= close)
            if good.sum() == count:
                return vectors[:, good]
            block = vectors
            if size == d:
                break
    # The whole space: the count can differ only by values at the very border.
    nearest = np.argsort(np.maximum(low - values, values - high), kind="stable")[:count]
    return vectors[:, nearest]


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of ``v``, falling, and their unit eigenvectors as columns."""
    scale = np.abs(v).max() if v.size else 0.0
    if scale == 0:
        return np.zeros(0), np.zeros((len(v), 0))
    form, rng = tridiagonal(v / scale), np.random.Generator(np.random.PCG64(41))
    blocks = [inside(v / scale, a, b, n, rng) for a, b, n in intervals(form, min(k, len(v)))]
    values, vectors = _ritz(v / scale, np.concatenate(blocks, axis=1))
    order = np.argsort(-values, kind="stable")[:k]
    order = order[values[order] > NOTHING * values.max()]
    return values[order] * scale, vectors[:, order]


# Rows.


class Whitening:
    """What whitens vectors of one length."""

    def __init__(self, sums: Sums, k: int):
        v = sums.covariance()
        self.n, self.s = sums.n, np.array(sums.s, object)
        self.values, self.vectors = leading(v, k)
        trace = float(np.trace(v))
        self.explained = [float(e) / trace for e in self.values]

    def apply(self, y: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """Deviations and whitened values of quantised vectors."""
        if self.n * max(1.0, np.abs(y).max()) + max(map(abs, self.s)) < 2**62:
            off = self.n * y.astype(np.int64) - self.s.astype(np.int64)
        else:
            off = self.n * y.astype(np.int64).astype(object) - self.s
        if len(self.s) * float(np.abs(off).max()) ** 2 >= 2**62:
            off = off.astype(object)
        squares = (off * off).sum(axis=1)
        return [int(q) if q < 2**63 else None for q in squares], (off.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values)


def whiten(vectors: DataFrame, k: int = 32, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and component."""
    spark = vectors.sparkSession
    short_batches(spark)
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    fits = {s.d: Whitening(s, k) for s in sums_of(rows)}
    kind = rows.schema["id"].dataType
    shared = spark.sparkContext.broadcast(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, y in _by_length(b.column("v")):
                deviation, w = shared.value[y.shape[1]].apply(y)
                cut = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
                cols = [b.column("id").take(pa.array(at)), pa.array([y.shape[1]] * len(w), pa.int32()), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(cut, pa.array(w.ravel()))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "d", "deviation", "w"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("d", T.IntegerType()), T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    made = settle(rows.mapInArrow(run, schema), "whitened")
    errors = identity_errors(made)
    about = [(d, f.n, [float(x) for x in f.explained], errors.get(d)) for d, f in fits.items()]
    known = spark.createDataFrame(about, "d int, n long, share array<double>, identity_error double")
    each = made.join(F.broadcast(known), "d").select("id", "n", "deviation", "share", "identity_error", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.col("share")[F.col("at")].alias("explained"), "identity_error"
    )


def identity_errors(made: DataFrame) -> dict[int, float]:
    """For each vector length of ``made`` (d, w), the largest absolute entry of the covariance of its
    whitened values less the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            kinds = b.column("d").to_numpy()
            for d in np.unique(kinds).tolist():
                at = np.flatnonzero(kinds == d)
                w = b.column("w").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                own = held.setdefault(d, [0, 0.0, 0.0])
                own[0], own[1], own[2] = own[0] + len(w), own[1] + w.sum(axis=0), own[2] + w.T @ w
        for d, (n, s, g) in held.items():
            cells = np.concatenate([[n], s, g.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(cells), pa.int32()), pa.array(np.arange(len(cells))), pa.array(cells)], names=["d", "at", "v"])

    sums: dict[int, list] = {}
    for d, _, v in made.select("d", "w").mapInArrow(run, "d int, at long, v double").groupBy("d", "at").agg(F.sum("v")).orderBy("d", "at").collect():
        sums.setdefault(d, []).append(v)
    out = {}
    for d, cells in sums.items():
        k = round((len(cells) - 0.75) ** 0.5 - 0.5)
        n, s, g = cells[0], np.array(cells[1 : k + 1]), np.array(cells[k + 1 :]).reshape(k, k)
        out[d] = float(np.abs(g / n - np.outer(s, s) / n**2 - np.eye(k)).max()) if k else 0.0
    return out


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
