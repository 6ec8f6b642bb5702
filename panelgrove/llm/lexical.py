"""Ranked lexical search, reversed: the items are the index and the documents are the stream.

The items' terms form an inverted index (term -> items, uses), written in blocks of at most
``BLOCK_POSTINGS`` postings and one item more, and broadcast a block at a time. Documents stay where they
are: a first pass counts how many hold each term of the block, a second one runs each document's term
counts through the index, adds up its score for every item met, and offers it to that item's heap of the k
best. A task puts out its heaps only, and a window merges the heaps of all tasks. Nothing of a document but
(item, document, score) is ever shuffled, and no pair below a task's k best leaves it.

Defined cases: a null or empty text has no terms, does not count as a document with terms, and is never an
answer; rows that repeat a document's id are ranked one by one; rows without an id count in the statistics
and are no answers; rows that share an item id make one item, their terms added up (null is an id like any
other); items without terms, or whose terms no document holds, have no rows; a term's weight of 0 adds
nothing; equal scores go by ascending id; texts are read whole; empty tables give no rows; other columns of
the tables are not read. Document ids are integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw_texts, settle, short_batches, table

#: Postings of one broadcast block: about 60 MB in each Python worker where every term is another.
BLOCK_POSTINGS = 500_000
#: Postings that are added up together.
CHUNK = 2_000_000
#: On UTF-8 bytes: A-Z become a-z, digits and everything beyond ASCII stay, the rest parts terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(_TERMS).split() if raw else []


class Block:
    """One block of the index: its items, and for each of its terms the items that use it, and how often."""

    def __init__(self, row: pa.Table):
        def flat(name: str) -> pa.Array:
            return row.column(name).combine_chunks().flatten()

        self.items = flat("items")
        self.vocab = {t: i for i, t in enumerate(flat("terms").to_pylist())}
        self.start, self.item, self.uses = (flat(c).to_numpy() for c in ("start", "item", "uses"))


def _postings(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, term, uses) of all items."""
    kind = items.schema[item_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in enumerate(raw_texts(b, "text")):
                words, uses = np.unique(np.array(terms_of(raw), dtype=object), return_counts=True) if raw else ([], [])
                if len(words):
                    own = b.column("item").take(pa.array([i] * len(words)))
                    yield pa.RecordBatch.from_arrays([own, pa.array(words, pa.binary()), pa.array(uses, pa.int64())], names=["item", "term", "uses"])

    schema = T.StructType([T.StructField("item", kind), T.StructField("term", T.BinaryType()), T.StructField("uses", T.LongType())])
    made = items.select(F.col(item_id).alias("item"), F.col(text).alias("text")).mapInArrow(run, schema)
    return made.groupBy("item", "term").agg(F.sum("uses").alias("uses"))


def index_blocks(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Blocks (part, at, items, terms, start, item, uses): the items that use term i are those from
    ``start[i]`` to ``start[i + 1]`` in ``item`` (places in ``items``) and ``uses``."""
    postings = settle(_postings(items, item_id, text), "postings")
    kind = items.schema[item_id].dataType
    schema = T.StructType(
        [T.StructField("part", T.LongType()), T.StructField("at", T.LongType()), T.StructField("items", T.ArrayType(kind)), T.StructField("terms", T.ArrayType(T.BinaryType()))]
        + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("start", "item", "uses")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, held, count = None, 0, [], 0

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            first = np.concatenate([[True], _differs(rows.column("item"))])
            item = np.cumsum(first) - 1
            names, term = np.unique(np.array(rows.column("term").to_pylist(), dtype=object), return_inverse=True)
            order = np.argsort(term, kind="stable")
            start = np.searchsorted(term[order], np.arange(len(names) + 1))
            own = rows.column("item").combine_chunks().take(pa.array(np.flatnonzero(first)))
            cols = [pa.array([part]), pa.array([at])] + [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (own, pa.array(names, pa.binary()), *map(pa.array, (start.astype(np.int64), item[order].astype(np.int64), rows.column("uses").to_numpy()[order])))]
            return pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

        for b in batches:
            cuts = [0, *(np.flatnonzero(_differs(b.column("item"))) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                own = b.column("part")[lo].as_py()
                new = bool(held) and held[-1].column("item")[-1] != b.column("item")[lo]
                if held and (own != part or new and count >= BLOCK_POSTINGS):
                    yield block()
                    at, held, count = at + 1 if own == part else 0, [], 0
                part = own
                held.append(b.select(["item", "term", "uses"]).slice(lo, hi - lo))
                count += hi - lo
        if held:
            yield block()

    n = postings.count()
    parts = 1 if n <= BLOCK_POSTINGS else math.ceil(1.5 * n / BLOCK_POSTINGS)
    numbered = postings.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)))
    dealt = numbered.repartition(parts, "part").sortWithinPartitions("part", "item", "term")
    return settle(dealt.mapInArrow(run, schema), "index")


def _differs(column) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    codes = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]


def _counted(docs: DataFrame, index) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and in how many of them each term of the block stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = index.value.vocab
        found, n, total = np.zeros(len(vocab), np.int64), 0, 0
        for b in batches:
            met: list[int] = []
            for raw in raw_texts(b, "text"):
                words = terms_of(raw)
                n += bool(words)
                total += len(words)
                met.extend(vocab[w] for w in vocab.keys() & set(words))
            found += np.bincount(np.array(met, np.int64), minlength=len(vocab))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some], pa.int64()), pa.array([n, total, *found[some]], pa.int64())], names=["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    by_term = dict(zip(sums.column("term").to_pylist(), sums.column("n").to_pylist()))
    out = np.zeros(len(index.value.vocab), np.int64)
    for t, c in by_term.items():
        if t >= 0:
            out[t] = c
    return by_term.get(-2, 0), by_term.get(-1, 0), out


class _Heaps:
    """The k best (score, document) of each item of a block."""

    def __init__(self, n: int, k: int):
        self.k, self.own = k, [[] for _ in range(n)]
        #: The least score that may still enter.
        self.floor = np.ones(n, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of documents (rows) for items (columns). Of these rows only the k best of each item, and
        those equal to the last, can enter."""
        least = self.floor
        if len(scores) > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=0)[-self.k])
        for d, i in zip(*np.nonzero(scores >= least)):
            heap, entry = self.own[i], (int(scores[d, i]), -int(ids[d]))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.floor[i] = heap[0][0]


def _scored(docs: DataFrame, index, weights, n_docs: int, n_terms: int, k: int, kind: T.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = index.value, weights.value
        get, size = block.vocab.get, np.diff(block.start)
        heaps = _Heaps(len(block.items), k)
        rows = max(1, CHUNK // max(1, len(block.items)))
        for b in batches:
            texts, ids = raw_texts(b, "text"), b.column("id").to_numpy()
            for lo in range(0, len(texts), rows):
                met, doc, spread = [], [], []
                for d, raw in enumerate(texts[lo : lo + rows]):
                    words = terms_of(raw)
                    own = [t for t in map(get, words) if t is not None]
                    met.extend(own)
                    doc.extend([d] * len(own))
                    spread.append(25 + (75 * len(words) * n_docs) // n_terms)
                if not met:
                    continue
                pair, tf = np.unique(np.array(doc, np.int64) * len(weight) + np.array(met, np.int64), return_counts=True)
                doc, term = np.divmod(pair, len(weight))
                points = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.array(spread, np.int64)[doc]))
                scores = np.zeros(len(spread) * len(block.items), np.int64)
                ends = np.cumsum(size[term])
                cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + CHUNK, CHUNK)))
                for x, y in zip(cuts, [*cuts[1:], len(term)]):
                    times = size[term[x:y]]
                    at = np.repeat(block.start[term[x:y]] - np.cumsum(times) + times, times) + np.arange(times.sum())
                    np.add.at(scores, np.repeat(doc[x:y] * len(block.items), times) + block.item[at], np.repeat(points[x:y], times) * block.uses[at])
                heaps.offer(scores.reshape(len(spread), -1), ids[lo:])
        item = [i for i, h in enumerate(heaps.own) for _ in h]
        score, found = zip(*[(s, -d) for h in heaps.own for s, d in h]) if item else ((), ())
        yield pa.RecordBatch.from_arrays([block.items.take(pa.array(item, pa.int64())), pa.array(found, pa.int64()), pa.array(score, pa.int64())], names=["item", "id", "score"])

    schema = T.StructType([T.StructField("item", kind), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])
    return docs.filter("id is not null").mapInArrow(run, schema)


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each item."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    blocks = index_blocks(items, item_id, item_text)
    kind, out = items.schema[item_id].dataType, None
    for part, at in sorted(map(tuple, blocks.select("part", "at").collect())):
        index = spark.sparkContext.broadcast(Block(blocks.where((F.col("part") == part) & (F.col("at") == at)).toArrow()))
        n, total, held = _counted(rows, index)
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in held], np.int64)
        found = _scored(rows, index, spark.sparkContext.broadcast(weight), n, max(1, total), k, kind)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], T.StructType([T.StructField("item", kind), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())]))
    best = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS w FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS nn, sum(len(w)) AS ll FROM d),
q AS (SELECT item_id, term, count(*) AS uses FROM (SELECT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
t AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3, 4),
g AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM f, s GROUP BY term, nn),
p AS (
  SELECT item_id, r, doc_id, sum(uses * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + CAST((75 * n * nn) // ll AS BIGINT))))) AS score
  FROM q JOIN f USING (term) JOIN g USING (term), s WHERE doc_id IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM b WHERE rank <= 10
"""
