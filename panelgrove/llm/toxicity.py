"""Toxicity by the nearest labelled examples under TF-IDF cosine, found exactly.

A bounded sample of labelled documents is kept as examples in an inverted index over all their terms.
A term weighs (1 + log of its count) x inverse document frequency x relevance frequency: document
frequencies are counted over all documents, and the relevance frequency, log2(2 + the odds of the
label among the term's documents over those of all), over all learning rows; no term is left out.
Postings are cut into blocks of examples. The few terms that very many examples hold are kept as
full rows and counted for a batch of documents at once. A block's bound is its best score by those
terms, plus the sum of the other terms' largest weights in it times the query's; blocks are scored
from the highest bound down until no bound reaches the k-th best score, which makes the neighbours exact. Of the examples with the very words of the document (cosine
1) the first has no vote, so that no row is scored by its own label alone. Neighbours vote with weights that fall
with distance; sampling rates are undone by class weights; and an isotonic fit on the examples, each
scored as any other document, turns votes into probabilities. Documents without a term of the
index have no neighbour; they get the learning rows' share of toxic ones among texts without words.

The sample is the documented bound: about ``EXAMPLES`` documents of each label, fewer if they hold
more than ``CHARACTERS`` characters, picked by a hash of the id. All else covers all rows and whole texts.

Defined cases: null and empty texts have no terms; a row without label or text teaches nothing; of
several labels of one id the highest holds; without examples of both labels all get the score 0;
rows are scored one by one, repeated ones alike. Ties between neighbours go to the smaller id. Very
long texts are scored whole. An empty table gives an empty one. Of clashing names, ``score``,
``evidence`` and ``evidence_terms`` are replaced, and all other columns stay as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_KEYS, map_arrow, settle, short_batches, table

EXAMPLES, CHARACTERS, BLOCK, NEIGHBOURS = 1000, 16_000_000, 64, 15
#: A term that so large a share of the examples holds is kept as a full row, the commonest first, up to
#: so many numbers in all rows (32 MB).
COMMON, ROWS = 1 / 16, 4_000_000
#: Documents whose common terms are counted at once.
TOGETHER = 128
#: Cosines from here on are those of equal texts.
SAME = 1 - 1e-9
PREDICT_FROM = 0.7
WORDS = re.compile(r"[^\W\d_]+").findall


def terms_of(text: str | None) -> list[str]:
    return WORDS(text.lower()) if text else []


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after another, and which range each is of."""
    size = last - first
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) + np.repeat(first - (np.cumsum(size) - size), size), which


@dataclass
class Index:
    """Postings of examples by term, cut into blocks of examples, and what turns votes into scores.

    Entry e stands for a term in a block: entries of term t are ``entries[t]`` to ``entries[t + 1]``,
    in block ``block[e]`` with largest weight ``most[e]`` and postings ``begin[e]`` to ``begin[e + 1]``."""

    number: dict[str, int]
    weights: np.ndarray  # of terms
    common: np.ndarray  # of each term its full row, or -1
    full: np.ndarray  # (common terms, examples)
    ids: np.ndarray
    labels: np.ndarray
    entries: np.ndarray
    block: np.ndarray
    most: np.ndarray
    begin: np.ndarray
    who: np.ndarray  # example and weight of each posting
    weight: np.ndarray
    rates: np.ndarray  # by label: undoes the sampling
    steps: tuple[np.ndarray, np.ndarray]  # votes and their calibrated scores
    without: float  # score of documents without terms

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a text and their weights, of length 1."""
        get = self.number.get
        t, c = np.unique(np.array([n for w in terms_of(text) if (n := get(w)) is not None], np.int64), return_counts=True)
        v = (1 + np.log(c)) * self.weights[t]
        return t, v / np.linalg.norm(v) if len(t) else v

    def shares(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms give to the scores of all examples, for some vectors."""
        own = np.zeros((len(vectors), len(self.full)))
        for row, (t, v) in zip(own, vectors):
            at = self.common[t]
            row[at[at >= 0]] = v[at >= 0]
        return own @ self.full

    def nearest(self, t: np.ndarray, v: np.ndarray, k: int = NEIGHBOURS, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest, exactly, ties by smaller id; of equal texts the first is
        left out. ``base`` is the vector's row of :meth:`shares`."""
        k += 1
        base = self.shares([(t, v)])[0] if base is None else base
        rest = self.common[t] < 0
        t, v = t[rest], v[rest]
        entry, which = _ranges(self.entries[t], self.entries[t + 1])
        held, share, n = self.block[entry], v[which], len(self.ids)
        bound = np.maximum.reduceat(base, np.arange(0, n, BLOCK))
        bound = bound + np.bincount(held, share * self.most[entry], len(bound))
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        found_i, found_s, least, done, step = [], [], 0.0, 0, 8
        # Each round scores more blocks than the last, as far as their bounds reach the k-th best.
        while done < len(order) and bound[done] > 0 and bound[done] >= least - 1e-9:
            last = min(done + step, int(np.searchsorted(-bound, -max(least - 1e-9, 1e-300), "right")))
            chosen = np.zeros(len(order), bool)
            chosen[order[done:last]] = True
            on = np.flatnonzero(chosen[held])
            at, of = _ranges(self.begin[entry[on]], self.begin[entry[on] + 1])
            total = base + np.bincount(self.who[at], share[on][of] * self.weight[at], n)
            hit = np.flatnonzero(np.repeat(chosen, BLOCK)[:n] & (total > 0))
            found_i.append(hit)
            found_s.append(total[hit])
            if sum(map(len, found_s)) >= k:
                every = np.concatenate(found_s)
                least = np.partition(every, len(every) - k)[len(every) - k]
            done, step = last, step * 4
        if not found_i:
            return np.zeros(0, np.int64), np.zeros(0)
        i, s = np.concatenate(found_i), np.concatenate(found_s)
        order = np.lexsort((self.ids[i], -np.round(s, 12)))[:k]
        i, s = i[order], s[order]
        own = 1 if len(s) and s[0] >= SAME else 0
        return i[own : own + k - 1], s[own : own + k - 1]

    def vote(self, i: np.ndarray, s: np.ndarray) -> float:
        w = self.rates[self.labels[i]] / (0.1 + 1 - np.minimum(s, 1.0))
        return float((w * self.labels[i]).sum() / w.sum())

    def score(self, i: np.ndarray, s: np.ndarray) -> float:
        if not len(i):
            return self.without
        return float(np.interp(self.vote(i, s), *self.steps))


def _vector(counts: Counter, number: dict[str, int], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known = sorted((n, c) for t, c in counts.items() if (n := number.get(t)) is not None)
    if not known:
        return np.zeros(0, np.int64), np.zeros(0)
    t, c = np.array(known).T
    v = (1 + np.log(c)) * weights[t]
    return t, v / np.linalg.norm(v)


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic fit of y on x by pooling neighbours that are out of order."""
    pools: list[list[float]] = []
    for v in np.unique(x):
        on = x == v
        pools.append([float(v), float((w[on] * y[on]).sum()), float(w[on].sum()), 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            v1, a1, w1, n1 = pools.pop()
            v0, a0, w0, n0 = pools.pop()
            pools.append([(v0 * n0 + v1 * n1) / (n0 + n1), a0 + a1, w0 + w1, n0 + n1])
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.05) / (p[2] + 0.1) for p in pools])


def _counted(docs: DataFrame, known: DataFrame, number: dict[str, int]) -> np.ndarray:
    """Documents that hold each term: all, those labelled 1, those labelled 0."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        counts = np.zeros((3, len(wanted)), np.int64)
        for b in batches:
            for text, y in zip(b.column("text"), b.column("y").to_pylist()):
                at = np.array([n for t in set(terms_of(text.as_py())) if (n := wanted.get(t)) is not None], np.int64)
                counts[0, at] += 1
                if y is not None:
                    counts[2 - y, at] += 1
        some = np.flatnonzero(counts[0])
        for i in range(0, len(some), 20_000):
            part = some[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array(c[part]) for c in counts]], names=["term", "n", "pos", "neg"])

    parts = docs.join(known, docs["doc_id"] == known["__id"], "left").select("text", "y").mapInArrow(run, "term long, n long, pos long, neg long")
    out = np.zeros((3, len(number)), np.int64)
    for r in parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n", "pos", "neg")]).collect():
        out[:, r["term"]] = r["n"], r["pos"], r["neg"]
    return out


def _index(examples: list, number: dict[str, int], weights: np.ndarray) -> Index:
    """Index of rows (doc_id, y, terms, counts)."""
    vectors = [_vector(dict(zip(r["terms"], r["counts"])), number, weights) for r in examples]
    # Neighbours in the index share their strongest term, which keeps block bounds tight.
    order = sorted(range(len(examples)), key=lambda i: (vectors[i][0][int(np.argmax(vectors[i][1]))], len(vectors[i][0]), examples[i]["doc_id"]))
    who = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
    term, weight = (np.concatenate([vectors[i][j] for i in order]) for j in (0, 1))
    by_term = np.argsort(term, kind="stable")
    who, term, weight = who[by_term], term[by_term], weight[by_term]
    ids, labels = (np.array([examples[i][c] for i in order]) for c in ("doc_id", "y"))
    held = np.bincount(term, minlength=len(number))
    often = np.argsort(-held, kind="stable")[: ROWS // len(order)]
    often = often[held[often] > COMMON * len(order)]
    common, full = np.full(len(number), -1), np.zeros((len(often), len(order)))
    common[often] = np.arange(len(often))
    inside = common[term] >= 0
    full[common[term[inside]], who[inside]] = weight[inside]
    who, term, weight = who[~inside], term[~inside], weight[~inside]
    begin = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (who[1:] // BLOCK != who[:-1] // BLOCK))[: len(term)])
    entries = np.searchsorted(term[begin], np.arange(len(number) + 1))
    most = np.maximum.reduceat(weight, begin) if len(begin) else weight
    return Index(number, weights, common, full, ids, labels, entries, who[begin] // BLOCK, most, np.append(begin, len(who)), who, weight, np.ones(2), (np.zeros(1), np.zeros(1)), 0.0)


def learn(docs: DataFrame, labels: DataFrame) -> Index | None:
    """Fit on ``docs`` (doc_id, text: all of them) and ``labels`` (doc_id, toxic 0 or 1: only
    those to learn from). Ids are whole numbers."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    known = settle(known.where("y in (0, 1)"), "toxic-labels")
    known = F.broadcast(known) if known.count() <= BROADCAST_KEYS else known
    labelled = docs.select("doc_id", "text").where("text is not null").join(known, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "y")
    some = F.rlike("text", F.lit(r"\p{L}"))
    sums = labelled.groupBy("y").agg(F.count("*").alias("n"), F.count_if(some).alias("some"), F.sum(F.when(some, F.length("text"))).alias("size"))
    sizes = {r["y"]: r for r in sums.collect()}
    if any(y not in sizes or not sizes[y]["some"] for y in (0, 1)):
        return None
    rates = np.array([min(1.0, EXAMPLES / sizes[y]["some"], CHARACTERS / sizes[y]["size"]) for y in (0, 1)])
    bound = F.when(F.col("y") == 1, int(rates[1] * (1 << 20)) + 1).otherwise(int(rates[0] * (1 << 20)) + 1)
    sample = settle(labelled.where(some & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < bound)), "toxic-examples")

    def make():
        def work(b):
            counts = [Counter(terms_of(t.as_py())) for t in b.column("text")]
            return [[list(c) for c in counts], [list(c.values()) for c in counts]]

        return work

    new = [("terms", T.ArrayType(T.StringType())), ("counts", T.ArrayType(T.LongType()))]
    rows = [r for r in map_arrow(sample, make, new, ["doc_id", "y"]).collect() if r["terms"]]
    if len({r["y"] for r in rows}) < 2:
        return None
    number = {t: i for i, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
    n, pos, neg = _counted(docs.select("doc_id", "text"), known, number)
    odds = (pos / sizes[1]["n"]) / (np.maximum(neg, 1) / sizes[0]["n"])
    index = _index(rows, number, np.log((1 + docs.count()) / (1 + n)) * np.log2(2 + odds) + 0.1)
    index.rates = 1 / rates
    none = [sizes[y]["n"] - sizes[y]["some"] for y in (0, 1)]
    index.without = (none[1] + 0.5) / (sum(none) + 10)
    votes = score(sample, index, keep=["y"], votes=True).where("vote is not null").select("vote", "y").collect()
    x, y = (np.array([r[c] for r in votes], float) for c in ("vote", "y"))
    index.steps = _isotonic(x, y, index.rates[y.astype(int)]) if len(x) else (np.zeros(1), np.array([index.without]))
    return index


def score(docs: DataFrame, index: Index | None, text: str = "text", keep: list[str] | None = None, votes: bool = False) -> DataFrame:
    """``docs`` (its columns in ``keep``) with ``score``, ``evidence`` (the nearest examples: id,
    label, cosine) and ``evidence_terms`` (its terms of the largest weights in the index); with
    ``votes``, with the uncalibrated ``vote`` alone."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        m = shared.value
        names = list(m.number) if m else []

        def vectors(texts):
            for at in range(0, len(texts), TOGETHER):
                part = [m.vector(t.as_py()) if m else (np.zeros(0, np.int64),) * 2 for t in texts.slice(at, TOGETHER)]
                yield from zip(part, m.shares(part) if m else part)

        def work(b):
            out, near, terms = [], [], []
            for vec, base in vectors(b.column(text)):
                i, s = m.nearest(*vec, base=base) if len(vec[0]) else vec
                if votes:
                    out.append(m.vote(i, s) if len(i) else None)
                    continue
                out.append(m.score(i, s) if m else 0.0)
                near.append([{"doc_id": int(m.ids[j]), "toxic": int(m.labels[j]), "cosine": float(c)} for j, c in zip(i[:3], s[:3])])
                terms.append([names[j] for j in vec[0][np.argsort(-vec[1], kind="stable")[:3]]])
            return [out] if votes else [out, near, terms]

        return work

    if votes:
        return map_arrow(docs, make, [("vote", T.DoubleType())], keep or docs.columns)
    evidence = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("cosine", T.DoubleType())])
    new = [("score", T.DoubleType()), ("evidence", T.ArrayType(evidence)), ("evidence_terms", T.ArrayType(T.StringType()))]
    return map_arrow(docs, make, new, docs.columns if keep is None else keep)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held))
    found = score(docs, index, keep=["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
