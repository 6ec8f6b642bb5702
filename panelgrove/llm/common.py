"""What the operators of this subpackage share: Arrow mapping, written tables, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of an Arrow batch handed to Python at most (but for one longer row).
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20
#: At most so many 8-byte keys are broadcast (about 64 MB as a hash relation); beyond, tables are shuffled.
BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``. Where that is unset, a local master gets a new folder of
    its own and a cluster gets one below the warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            folder = tempfile.mkdtemp(prefix="panelgrove-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_panelgrove"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a lost
    executor costs nothing that was computed before."""
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches within ``BATCH_ROWS`` and ``BATCH_BYTES``. These are settings of the session; smaller
    ones of the user stay. Frames are lazy, so they can't be set back here."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if not spark.conf.get(size).rstrip("b").isdigit() or int(spark.conf.get(size).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")


def map_arrow(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], list]],
    new: list[tuple[str, T.DataType]],
    keep: list[str],
) -> DataFrame:
    """``df`` with columns computed a batch at a time; of its own columns only ``keep`` stay.

    ``make`` runs once in each task and returns a function from a batch to the new columns.
    New columns take the place of kept ones of the same name.
    """
    short_batches(df.sparkSession)
    names = {n for n, _ in new}
    keep = [c for c in keep if c not in names]
    out = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in new])
    arrow = [(n, _arrow(t)) for n, t in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            made = [v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, (_, t) in zip(work(b), arrow)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + made, names=keep + [n for n, _ in arrow])

    return df.mapInArrow(run, out)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def raw_texts(b: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return b.column(name).cast(pa.binary()).to_pylist()


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal ``key`` from batches that are sorted by it. A group is held only as a
    whole, so the caller bounds its size."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[0].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for c in cuts:
            held.append(b.slice(start, c - start))
            yield pa.Table.from_batches(held)
            held, start = [], c
        held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)


class WordHash(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    LIMIT = 200_000

    def __missing__(self, w: bytes) -> int:
        v = xxhash.xxh3_64_intdigest(w)
        if len(self) >= self.LIMIT:
            self.clear()
        self[w] = v
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def odd_constants(n: int, seed: int, bits: int = 64) -> np.ndarray:
    kind = np.uint64 if bits == 64 else np.uint32
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**bits, n, dtype=kind) | kind(1)


def shingle_hashes(w: np.ndarray, width: int, consts: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole sequence if it is shorter."""
    n = len(w)
    if n == 0:
        return w
    if n < width:
        return mixed((w * consts[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    s = w[: n - width + 1] * consts[0]
    for j in range(1, width):
        s += w[j : n - width + 1 + j] * consts[j]
    return mixed(s + np.uint64(width))


def among(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` is in ``keys`` (one column, distinct). The keys are
    broadcast if their count allows it, and both sides are shuffled otherwise."""
    k = keys.select(F.col(keys.columns[0]).alias("__key"))
    if k.count() <= BROADCAST_KEYS:
        k = F.broadcast(k)
    return df.join(k, df[column] == k["__key"], "left_semi")


def one_text_each(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text) with one row an id: of rows that share an id the smallest text stays. Only these
    are shuffled."""
    repeated = settle(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    if not repeated.limit(1).count():
        return rows
    once = rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    return rows.join(repeated, "id", "left_anti").unionByName(once)
