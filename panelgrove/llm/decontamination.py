"""Benchmark decontamination: find the word windows of test items in training texts.

Test windows (``width`` consecutive words of an item; an item of fewer words is one window) are
held in a hash table that is broadcast in blocks of at most ``BLOCK_WINDOWS`` windows, so what is
broadcast has a fixed bound whatever the size of the test set. Training texts are scanned where
they lie, without a shuffle: words are looked up in the block's vocabulary, runs of known words
are hashed window by window, and every hit is verified word by word.

Defined cases: a null or empty text has no words and no hits; an item without an id or without
words takes no part; an item id that occurs twice counts once; rows are judged one by one, so a
repeated document is reported as often as it occurs; windows shared by several items count for each of
them; very long texts are read whole; empty tables of texts give empty ones, and without items nothing
is hit. Columns named ``n_words``, ``hit_spans`` or ``hit_items`` are replaced; all others stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, mixed, odd_constants, raw_texts, settle, table

#: Words of a lower-cased text, on UTF-8 bytes: digits, a-z and everything beyond ASCII.
WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows held by one broadcast block: about 40 MB in each Python worker.
BLOCK_WINDOWS = 500_000
#: Words that are looked up together.
CHUNK_WORDS = 200_000

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def words_of(raw: bytes | None) -> list[bytes]:
    return re.findall(WORD, raw.lower()) if raw else []


def _blocks(benchmark: DataFrame, width: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Lists of (item id, words) with a bounded number of windows; a long item is cut into
    parts that overlap by a window less one word."""
    block, held = [], 0
    for row in benchmark.toLocalIterator():
        words = words_of(row[1].encode("utf-8", "surrogatepass") if row[1] is not None else None)
        for at in range(0, max(1, len(words) - width + 1), BLOCK_WINDOWS):
            part = words[at : at + BLOCK_WINDOWS + width - 1]
            if not part:
                continue
            if block and held + len(part) > BLOCK_WINDOWS:
                yield block
                block, held = [], 0
            block.append((str(row[0]), part))
            held += len(part)
    if block:
        yield block


class _Index:
    """Windows of one block: sorted hashes by window length, and where they stand."""

    def __init__(self, block: list[tuple[str, list[bytes]]], width: int):
        self.vocab: dict[bytes, int] = {}
        self.items = [i for i, _ in block]
        known = self.vocab
        ids = [np.fromiter((known.setdefault(w, len(known) + 1) for w in words), np.int32, len(words)) for _, words in block]
        self.flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        self.value = mixed(np.arange(1, len(known) + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.consts = odd_constants(width, 11)
        by_length: dict[int, list[tuple[int, int]]] = {}
        at = 0
        for item, own in enumerate(ids):
            length = min(width, len(own))
            by_length.setdefault(length, []).extend((at + j, item) for j in range(len(own) - length + 1))
            at += len(own)
        self.tables = []
        for length, places in sorted(by_length.items()):
            where, item = np.array(places, np.int64).T
            h = self.hashes(self.flat, length)[where]
            order = np.argsort(h, kind="stable")
            self.tables.append((length, h[order], where[order], item[order]))

    def hashes(self, ids: np.ndarray, length: int) -> np.ndarray:
        v, n = self.value[ids], len(ids) - length + 1
        h = v[:n] * self.consts[0]
        for j in range(1, length):
            h += v[j : n + j] * self.consts[j]
        return mixed(h)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window length, positions in ``ids``, items) of verified hits; 0 is an unknown word."""
        gap = np.concatenate([[0], np.cumsum(ids == 0)])
        for length, table_h, where, item in self.tables:
            n = len(ids) - length + 1
            if n <= 0:
                continue
            at = np.flatnonzero(gap[length : length + n] == gap[:n])
            if not len(at):
                continue
            h = self.value[ids[at]] * self.consts[0]
            for j in range(1, length):
                h += self.value[ids[at + j]] * self.consts[j]
            h = mixed(h)
            lo, hi = np.searchsorted(table_h, h, "left"), np.searchsorted(table_h, h, "right")
            some = np.flatnonzero(hi > lo)
            if not len(some):
                continue
            times = (hi - lo)[some]
            pos = np.repeat(at[some], times)
            entry = np.repeat(lo[some], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            same = np.ones(len(pos), bool)
            for j in range(length):
                same &= ids[pos + j] == self.flat[where[entry] + j]
            yield length, pos[same], item[entry[same]]


def _scanner(block: list, width: int, text: str, first: bool, cut: bool = False):
    def make():
        index = _Index(block, width)
        get = index.vocab.get

        def scan(texts: list[bytes | None]):
            counts, spans, items = [], [], []
            start = 0
            while start < len(texts):
                ids, sizes, held = [], [], 0
                while start < len(texts) and (not sizes or held < CHUNK_WORDS):
                    words = words_of(texts[start])
                    ids.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
                    ids.append(np.zeros(1, np.int32))
                    sizes.append(len(words))
                    held += len(words) + 1
                    start += 1
                flat = np.concatenate(ids)
                begin = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)])[:-1]
                cover = np.zeros(len(flat) + 1, np.int32)
                found: dict[int, set[str]] = {}
                for length, pos, item in index.hits(flat):
                    np.add.at(cover, pos, 1)
                    np.add.at(cover, pos + length, -1)
                    doc = np.searchsorted(begin, pos, "right") - 1
                    for d, i in np.unique(np.stack([doc, item], 1), axis=0):
                        found.setdefault(int(d), set()).add(index.items[i])
                hit = np.cumsum(cover[:-1]) > 0
                for d, n in enumerate(sizes):
                    counts.append(n)
                    items.append(sorted(found.get(d, ())))
                    if d in found:
                        own = np.concatenate([[False], hit[begin[d] : begin[d] + n], [False]])
                        edge = np.flatnonzero(own[1:] != own[:-1])
                        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])])
                    else:
                        spans.append([])
            return counts, spans, items

        def work(b):
            texts = raw_texts(b, text)
            counts, spans, items = scan(texts)
            if not first:
                spans = [_union(x + y) if y else x for x, y in zip(b.column("hit_spans").to_pylist(), spans)]
                items = [sorted({*x, *y}) for x, y in zip(b.column("hit_items").to_pylist(), items)]
            return [counts, spans, items] + ([[_cut(raw, s) for raw, s in zip(texts, spans)]] if cut else [])

        return work

    return make


def _union(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def _cut(raw: bytes | None, spans: list[dict]) -> str | None:
    """The text without ``spans``, from the first letter of their first word to the last of their last."""
    if raw is None:
        return None
    parts, end = [], 0
    if spans:
        at = [m.span() for m in re.finditer(WORD, raw.lower())]
        for s in spans:
            parts.append(raw[end : at[s["start"]][0]])
            end = at[s["end"] - 1][1]
    return b"".join([*parts, raw[end:]]).decode("utf-8", "replace")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, cut: bool = False
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word positions, end exclusive, joined where they
    touch) and ``hit_items`` (ids as sorted strings). Columns of these names are replaced. With ``cut``
    the texts come without their hit spans, which saves :func:`remove_spans` a second Python worker a task."""
    new = [("n_words", T.LongType()), ("hit_spans", SPANS), ("hit_items", T.ArrayType(T.StringType()))]
    last = new + ([(text, T.StringType())] if cut else [])
    out, first = docs.drop(*[n for n, _ in new]), True
    tests = benchmark.select(item_id, item_text).filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull())
    held: list = []
    for block in _blocks(tests, width):
        if held:
            out = settle(map_arrow(out, _scanner(held, width, text, first), new, out.columns), "decontamination")
            first = False
        held = block
    return map_arrow(out, _scanner(held, width, text, first, cut), last, out.columns)


def mostly_clean(found: DataFrame, drop_share: float = 0.5) -> DataFrame:
    """Without the documents of which more than ``drop_share`` of the words were hit."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.filter(hit <= F.lit(drop_share) * F.col("n_words"))


def remove_spans(docs: DataFrame, text: str = "text", drop_share: float = 0.5) -> DataFrame:
    """Act on what :func:`find_contamination` found: cut hit spans out of the text, from the first
    letter of their first word to the last of their last, and drop a document of which more than
    ``drop_share`` of the words were hit."""

    def make():
        def work(b):
            return [[_cut(raw, spans) for raw, spans in zip(raw_texts(b, text), b.column("hit_spans").to_pylist())]]

        return work

    left = mostly_clean(docs, drop_share)
    names = left.columns
    return map_arrow(left, make, [(text, T.StringType())], names).select(*names)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


ORACLE_OP1 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, lens, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n),
hits AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
