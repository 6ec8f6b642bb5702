"""Sum-of-squares packing: documents into training windows, online, with next to no padding.

Each task packs the documents it reads, in the order it reads them. Whole windows are cut off a
long document; what remains goes to the fill level that minimises the sum of squared counts of
partly filled windows over all levels, which a level array tracks; of equally good levels the lowest
is taken. A window leaves memory once it is full. Remainders that don't fit together would stay open
without a bound: whenever open windows hold more than ``OPEN_TOKENS`` tokens, and at the end of a
task, the emptiest are cut up to fill the gaps of the fullest, and one is left over. At the end that one
is divided into windows whose lengths are powers of two.

Defined cases: a null text counts as empty and holds the end id alone; equal rows are packed each
for itself; a very long text is cut into whole windows; a table without rows gives no pieces; other
columns of ``docs`` are not read. Sequence ids are the task's number and a count within it: unique, and
the same again when a task that reads files is run anew.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import short_batches, table
from .tokens import default_paths, encoder

#: Tokens of a full window, and the id put behind each document.
WINDOW, END_ID = 2048, 1
#: Tokens that the open windows of a task hold at most, but for those of one more document.
OPEN_TOKENS = 2_000_000
#: Sequence ids of a task start at its number times this.
TASK_STEP = 1 << 40


class SumOfSquares:
    """Open windows by fill level. A piece is (document, start, length); ``closed`` gets full
    windows as lists of pieces."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.closed: list[list] = []
        self.held = 0  # tokens in open windows

    def place(self, piece: tuple) -> int:
        """Put a piece shorter than the window; gives the level it was added to (0: a new window)."""
        size, n = piece[2], self.count
        top = self.window - size
        # Change of the sum of squares: one window fewer at the level, one more at the level it
        # reaches. New and full windows count nothing.
        change = 2 * (n[size : self.window + 1] - n[: top + 1]) + 2
        change[0] = 2 * n[size] + 1
        change[top] = 1 - 2 * n[top] if top else 0
        usable = n[: top + 1] > 0
        usable[0] = True
        level = int(np.argmin(np.where(usable, change, np.iinfo(np.int64).max)))
        held = self.open[level].pop() if level else []
        n[level] -= level > 0
        held.append(piece)
        self.held += size
        if level + size == self.window:
            self.closed.append(held)
            self.held -= self.window
        else:
            self.open[level + size].append(held)
            n[level + size] += 1
        return level

    def _fill(self) -> list[tuple]:
        """Close all but one open window: cut the emptiest windows' pieces into the gaps of the fullest.
        Gives the pieces of the one that is left, last first."""
        left = deque((level, w) for level in range(1, self.window) for w in self.open[level])
        self.open = [[] for _ in range(self.window + 1)]
        self.count[:] = 0
        self.held = 0
        loose: list[tuple] = []
        while left:
            level, held = left.pop()
            gap = self.window - level
            while gap and (loose or left):
                if not loose:
                    loose = left.popleft()[1][::-1]
                doc, start, size = loose.pop()
                take = min(size, gap)
                held.append((doc, start, take))
                gap -= take
                if take < size:
                    loose.append((doc, start + take, size - take))
            if gap == 0:
                self.closed.append(held)
            else:
                loose = held[::-1]
        return loose

    def compact(self) -> None:
        """Leave one open window at most."""
        if loose := self._fill():
            level = sum(p[2] for p in loose)
            self.open[level].append(loose[::-1])
            self.count[level] += 1
            self.held = level

    def finish(self) -> None:
        """Close all."""
        loose = self._fill()
        size = sum(p[2] for p in loose)
        while size:
            gap = 1 << (size.bit_length() - 1)
            size -= gap
            held = []
            while gap:
                doc, start, n = loose.pop()
                take = min(n, gap)
                held.append((doc, start, take))
                gap -= take
                if take < n:
                    loose.append((doc, start + take, n - take))
            self.closed.append(held)


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    tokenizer: tuple[str, str] | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: the document's id, ``start`` (ids of the document before it), ``length``,
    ``ids_crc32`` (over the ids as little-endian unsigned 32-bit numbers), ``doc_tokens``,
    ``sequence_id``, ``offset`` (in the sequence), and with ``with_ids`` the ids themselves
    (``ids``, binary in that form)."""
    short_batches(docs.sparkSession)
    own, ranks = tokenizer or default_paths()
    fields = [docs.schema[doc_id]] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(own, ranks)
        base = TaskContext.get().partitionId() * TASK_STEP
        packer, made = SumOfSquares(window), 0
        kind = None
        stored: dict[int, list] = {}  # number of a document: id, its ids from ``from`` on, from, size, pieces open

        def out(number: int) -> Iterator[pa.RecordBatch]:
            rows, ids = [], []
            for held in packer.closed:
                offset = 0
                for doc, start, size in held:
                    d = stored[doc]
                    own_ids = d[1][start - d[2] : start - d[2] + size]
                    data = own_ids.tobytes()
                    rows.append((d[0], start, size, zlib.crc32(data), d[3], base + number, offset))
                    if with_ids:
                        ids.append(data)
                    offset += size
                    d[4] -= size
                    if not d[4]:
                        del stored[doc]
                number += 1
            packer.closed.clear()
            if rows:
                cols = [pa.array(c, kind if i == 0 else pa.int64()) for i, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.binary())] if with_ids else []), names=schema.names)

        seen = 0
        for b in batches:
            kind = b.column(doc_id).type
            for i, t in zip(b.column(doc_id).to_pylist(), b.column(text)):
                ids = np.append(encode(t.as_py()), np.uint32(end_id)).astype("<u4")
                rest = len(ids) % window
                cut = len(ids) - rest
                stored[seen] = [i, ids, 0, len(ids), len(ids)]
                for at in range(0, cut, window):
                    packer.closed.append([(seen, at, window)])
                if rest:
                    packer.place((seen, cut, rest))
                if packer.held > OPEN_TOKENS:
                    packer.compact()
                n = len(packer.closed)
                if n > 200:
                    yield from out(made)
                    made += n
                if cut and seen in stored and stored[seen][4] == rest:  # only the rest is still open
                    stored[seen][1:3] = [ids[cut:].copy(), cut]
                seen += 1
            n = len(packer.closed)
            yield from out(made)
            made += n
            for d in stored.values():
                if len(d[1]) > d[4]:
                    d[1:3] = [d[1][-d[4] :].copy(), d[3] - d[4]]
        packer.finish()
        yield from out(made)

    return docs.select(doc_id, text).mapInArrow(run, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
