"""Best-fit-decreasing packing into fixed windows, as binary id matrices.

Each task gathers documents up to ``CHUNK`` tokens, cuts whole windows off overlong ones, sorts
what is left by size and puts each piece into the window with the least room that still fits,
which a segment tree over capacities finds in a few steps. No token is lost: a document's pieces
carry where they begin in it. A row is one window: ids as little-endian unsigned integers, the
cumulative segment lengths, where positions start again, and each segment's document.

Defined cases: a null text counts as empty and holds the end id alone; equal rows are packed each
for itself; of windows with equal room the one filled last is taken; a very long text is cut into whole
windows; a table without rows gives no windows; other columns are not read. A chunk's last windows may stay partly empty;
they are stored without padding, and ``matrix`` pads them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import short_batches, table
from .packing import END_ID, TASK_STEP, WINDOW
from .tokens import default_paths, encoder

#: Tokens packed together: what a task holds at most, but for a single longer document.
CHUNK = 2_000_000
#: Vocabularies up to this size are stored in two bytes an id, others in four.
SHORT = 1 << 16


class Capacities:
    """Counts of windows by room left; finds the smallest room that fits."""

    def __init__(self, top: int):
        self.leaves = 1 << (top + 1).bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += n
            at >>= 1

    def fit(self, size: int) -> int:
        """The smallest room of at least ``size`` that a window has, or -1."""
        tree, at = self.tree, size + self.leaves
        if tree[at]:
            return size
        while at > 1:
            if not at & 1 and tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit_decreasing(sizes: list[int], window: int) -> list[list[int]]:
    """Items (by number) of each window; every size is between 1 and ``window``."""
    rooms, held, by_room = Capacities(window), [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = rooms.fit(sizes[i])
        if room < 0:
            at, room = len(held), window
            held.append([])
        else:
            at = by_room[room].pop()
            rooms.add(room, -1)
        held[at].append(i)
        if left := room - sizes[i]:
            by_room.setdefault(left, []).append(at)
            rooms.add(left, 1)
    return held


def pack_binary(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, tokenizer: tuple[str, str] | None = None, vocabulary: int = 50_257
) -> DataFrame:
    """One row a window: ``sequence_id``, ``n_tokens``, ``ids`` (binary), ``cu_seqlens`` (from 0 to
    ``n_tokens``), ``position_resets`` (where positions start again from 0), ``doc_ids`` and
    ``doc_starts`` (each segment's document, and the ids of that document before it), ``ids_crc32``."""
    short_batches(docs.sparkSession)
    own, ranks = tokenizer or default_paths()
    kind = "<u2" if vocabulary <= SHORT else "<u4"
    schema = T.StructType(
        [
            T.StructField("sequence_id", T.LongType()),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
            T.StructField("position_resets", T.ArrayType(T.IntegerType())),
            T.StructField("doc_ids", T.ArrayType(docs.schema[doc_id].dataType)),
            T.StructField("doc_starts", T.ArrayType(T.LongType())),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(own, ranks)
        number, pieces, held = TaskContext.get().partitionId() * TASK_STEP, [], 0
        id_type = pa.int64()

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal number
            full = [[i] for i, p in enumerate(pieces) if len(p[2]) == window]
            rest = [i for i, p in enumerate(pieces) if len(p[2]) < window]
            packed = full + [[rest[j] for j in w] for w in best_fit_decreasing([len(pieces[i][2]) for i in rest], window)]
            for at in range(0, len(packed), 500):
                cols: list[list] = [[] for _ in schema.names]
                for w in packed[at : at + 500]:
                    ids = np.concatenate([pieces[i][2] for i in w])
                    cuts = np.cumsum([0, *(len(pieces[i][2]) for i in w)]).tolist()
                    row = (number, len(ids), ids.astype(kind).tobytes(), cuts, cuts[:-1], [pieces[i][0] for i in w], [pieces[i][1] for i in w], zlib.crc32(ids.astype("<u4").tobytes()))
                    for c, v in zip(cols, row):
                        c.append(v)
                    number += 1
                types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(id_type), pa.list_(pa.int64()), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=schema.names)

        for b in batches:
            id_type = b.column(doc_id).type
            for i, t in zip(b.column(doc_id).to_pylist(), b.column(text)):
                ids = np.append(encode(t.as_py()), np.uint32(end_id))
                pieces.extend((i, at, ids[at : at + window]) for at in range(0, len(ids), window))
                held += len(ids)
                if held >= CHUNK:
                    yield from out()
                    pieces, held = [], 0
        yield from out()

    return docs.select(doc_id, text).mapInArrow(run, schema)


def matrix(rows: list, window: int = WINDOW, pad_id: int = 0, kind: str = "<u2") -> tuple[np.ndarray, np.ndarray]:
    """(ids, positions) of some windows as padded matrices."""
    ids, pos = np.full((len(rows), window), pad_id, np.uint32), np.zeros((len(rows), window), np.int32)
    for r, row in enumerate(rows):
        own = np.frombuffer(row["ids"], kind)
        ids[r, : len(own)] = own
        for at, end in zip(row["cu_seqlens"], row["cu_seqlens"][1:]):
            pos[r, at:end] = np.arange(end - at)
    return ids, pos


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_binary(table(spark, sf_dir, "documents"))
