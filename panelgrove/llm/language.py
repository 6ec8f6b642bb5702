"""Language identification with a linear-chain conditional random field over words.

A word's emission scores are sums of learned weights of its character n-grams (those that touch
a word's ends are its affixes) and of the word itself (the lexicon). Transitions between the
languages of neighbouring words are learned too: beside whole documents the training data holds
sequences spliced from pieces of documents in different languages, so code-switched text is
labelled word by word. Forward-backward gives each word's probabilities; the mean over a
document's words is the document's score for each language.

The model is fitted on a bounded sample of every language: about ``PER_LANGUAGE`` documents for each
of up to ``MAX_LANGUAGES`` languages, fewer (one at least) if there are more, picked by a hash of the
id; of a longer document a piece of ``MAX_CHARS`` characters. Everything is labelled: whole texts of all documents, in the tasks that read them.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text
if there is no labelled text to learn from. Ties go to the language that sorts first. Rows are judged
one by one, repeated ones alike; very long texts are read whole; an empty table gives an empty one.
Columns named ``lang_pred`` or ``score`` are replaced; all others stay.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, mixed, odd_constants, table

PER_LANGUAGE, MAX_CHARS, MAX_LANGUAGES = 200, 20_000, 64
#: Weights are kept in so many hashed rows for up to 16 languages, and in a quarter of that beyond.
BUCKETS = 1 << 18
#: Lengths of the character n-grams; 0 stands for the whole word.
GRAMS = (0, 1, 2, 3, 4)
ROUNDS, RATE, DECAY = 16, 0.3, 1e-3
#: Words of a segment; segments of all documents of a batch are worked on side by side.
SEGMENT = 64
WORDS = re.compile(r"[^\W\d_]+").findall
_CONSTS = odd_constants(8, 5)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (buckets + 1, languages); the last row is zero
    steps: np.ndarray  # (languages, languages): log weights of transitions


def words_of(text: str | None) -> list[str]:
    if not text or next(filter(str.isalpha, text), None) is None:
        return []
    return WORDS(text.lower())


def features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, starts): for each n-gram length the weight rows of all words' characters, and where
    each word begins in them."""
    text = "".join(f"\x02{w}\x03" for w in words)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(words)), sizes)
    rows = np.full((len(GRAMS), len(cp)), buckets, np.int64)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    for g, n in enumerate(GRAMS):
        if n == 0:
            place = np.arange(len(cp)) - starts[owner]
            power = mixed((place.astype(np.uint64) + np.uint64(1)) * _CONSTS[0]) | np.uint64(1)
            rows[g, starts] = mixed(np.add.reduceat(mixed(cp * _CONSTS[1]) * power, starts)) >> shift
            continue
        m = len(cp) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64) * _CONSTS[2]
        for j in range(n):
            h += cp[j : m + j] * _CONSTS[3 + j]
        same = owner[:m] == owner[n - 1 :]
        rows[g, :m][same] = (mixed(h) >> shift)[same]
    return rows, starts


def emissions(rows: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = np.zeros((len(starts), weights.shape[1]), np.float32)
    for r in rows:
        total += np.add.reduceat(weights[r], starts, axis=0)
    return total


def forward_backward(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word probabilities for all sequences at once, and expected transition counts.

    Sequences are cut into segments of ``SEGMENT`` words. The product of each segment's step
    matrices is formed for all segments side by side, messages then pass from segment to segment,
    and a second pass inside the segments gives every word's probabilities.
    """
    k = scores.shape[1]
    move = np.exp(steps - steps.max()).astype(np.float64)
    per = -(-lengths // SEGMENT)
    n_seg = int(per.sum())
    first = np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(scores)) - begin[owner]
    seg, pos = first[owner] + at // SEGMENT, at % SEGMENT
    e = np.ones((SEGMENT, n_seg, k))
    real = np.zeros((SEGMENT, n_seg), bool)
    e[pos, seg] = np.exp(scores - scores.max(axis=1, keepdims=True))
    real[pos, seg] = True

    whole = np.broadcast_to(np.eye(k), (n_seg, k, k)).copy()
    for t in range(SEGMENT):
        on = real[t].nonzero()[0]
        if not len(on):
            break
        m = (whole[on].reshape(-1, k) @ move).reshape(-1, k, k) * e[t, on][:, None, :]
        whole[on] = m / m.max(axis=(1, 2), keepdims=True)

    left, right = np.full((n_seg, k), 1 / k), np.ones((n_seg, k))
    by_size = np.argsort(-per, kind="stable")
    ordered = per[by_size]
    top = int(per.max()) if len(per) else 0
    for j in range(1, top):
        s = first[by_size[: np.searchsorted(-ordered, -j, "left")]] + j
        v = np.einsum("nk,nkj->nj", left[s - 1], whole[s - 1])
        left[s] = v / v.sum(axis=1, keepdims=True)
    for j in range(top - 1, 0, -1):
        s = first[by_size[: np.searchsorted(-ordered, -j, "left")]] + j
        v = np.einsum("nkj,nj->nk", whole[s], right[s])
        right[s - 1] = v / v.sum(axis=1, keepdims=True)

    ahead = np.zeros((SEGMENT, n_seg, k))
    a = left
    for t in range(SEGMENT):
        v = (a @ move) * e[t]
        v /= v.sum(axis=1, keepdims=True)
        a = np.where(real[t][:, None], v, a)
        ahead[t] = a
    b = right
    prob = np.zeros((SEGMENT, n_seg, k))
    pairs = np.zeros((k, k))
    for t in range(SEGMENT - 1, -1, -1):
        p = ahead[t] * b
        prob[t] = p / p.sum(axis=1, keepdims=True)
        before = ahead[t - 1] if t else left
        back = e[t] * b
        weight = np.einsum("nk,kj,nj->n", before, move, back)
        on = real[t]
        pairs += move * np.einsum("nk,nj->kj", before[on] / weight[on][:, None], back[on])
        v = back @ move.T
        v /= v.sum(axis=1, keepdims=True)
        b = np.where(on[:, None], v, b)
    return prob[pos, seg], pairs


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """Train on (text, language) pairs by gradient ascent with per-weight rates."""
    languages = sorted({lang for _, lang in rows})
    vocab: dict[str, int] = defaultdict(count().__next__)
    docs = [(np.fromiter(map(vocab.__getitem__, w), np.int64, len(w)), languages.index(lang)) for text, lang in rows if (w := words_of(text))]
    if not docs:
        return None
    rng, k = np.random.Generator(np.random.PCG64(17)), len(languages)
    buckets = BUCKETS if k <= 16 else BUCKETS // 4
    sequences = [(ids, np.full(len(ids), y)) for ids, y in docs]
    pieces = []
    for ids, y in docs:
        at = 0
        while at < len(ids):
            n = int(rng.integers(3, 40))
            pieces.append((ids[at : at + n], np.full(len(ids[at : at + n]), y)))
            at += n
    order = rng.permutation(len(pieces))
    for i in range(0, len(order), 20):
        part = [pieces[j] for j in order[i : i + 20]]
        sequences.append((np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])))
    ids = np.concatenate([s[0] for s in sequences])
    gold = np.concatenate([s[1] for s in sequences])
    lengths = np.array([len(s[0]) for s in sequences])
    one = np.eye(k)[gold]
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(lengths)[:-1]] = False
    seen_pairs = np.zeros((k, k))
    np.add.at(seen_pairs, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    starts_at = np.bincount(gold[np.cumsum(lengths) - lengths], minlength=k)
    f_rows, f_starts = features(list(vocab), buckets)
    word_of = np.repeat(np.arange(len(vocab)), np.diff(np.append(f_starts, f_rows.shape[1])))
    w, steps = np.zeros((buckets + 1, k), np.float32), np.zeros((k, k))
    w_sum, s_sum = np.full_like(w, 1e-6), np.full((k, k), 1e-6)
    for _ in range(ROUNDS):
        prob, pairs = forward_backward(emissions(f_rows, f_starts, w)[ids], lengths, steps)
        gap = one - prob
        by_word = np.stack([np.bincount(ids, gap[:, j], len(vocab)) for j in range(k)], 1)
        grad = np.zeros_like(w)
        spread = by_word[word_of]
        for r in f_rows:
            for j in range(k):
                grad[:, j] += np.bincount(r, spread[:, j], buckets + 1)
        grad -= DECAY * w
        grad[-1] = 0
        w_sum += grad * grad
        w += RATE * grad / np.sqrt(w_sum)
        move = np.exp(steps)
        g = seen_pairs + starts_at * move / move.sum(axis=0) - pairs  # the word before the first is unknown
        s_sum += g * g
        steps += RATE * g / np.sqrt(s_sum)
    return Model(languages, w, steps)


def learn(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Fit on the documented sample of ``labelled``."""
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(F.col(doc_id)).alias("h"))
    rows = rows.filter(F.col("l").isNotNull() & F.rlike("t", F.lit(r"\p{L}")))
    sizes = rows.groupBy("l").agg(F.count("*").alias("n"), F.min("h").alias("low")).collect()
    if not sizes:
        return None
    # A word has a probability for each language, so what the fit holds grows with both.
    most = min(PER_LANGUAGE, max(1, PER_LANGUAGE * MAX_LANGUAGES**2 // len(sizes) ** 2))
    shares = [(r["l"], min(1.0, most / r["n"])) for r in sizes]
    bounds = labelled.sparkSession.createDataFrame([(x, int(s * (1 << 20)) + (s >= 1)) for x, s in shares], "l string, bound long")
    at = F.pmod("h", F.length("t") - MAX_CHARS + 1)
    pieces = rows.withColumn("t", F.when(F.length("t") > MAX_CHARS, F.substring("t", (at + 1).cast("int"), F.lit(MAX_CHARS))).otherwise(F.col("t")))
    sample = pieces.join(F.broadcast(bounds), "l").filter(F.pmod("h", F.lit(1 << 20)) < F.col("bound")).select("t", "l").limit(2 * most * len(sizes)).collect()
    seen = {r["l"] for r in sample}
    if missing := [(r["l"], r["low"]) for r in sizes if r["l"] not in seen]:
        lowest = labelled.sparkSession.createDataFrame(missing, "l string, h long")
        sample += pieces.join(F.broadcast(lowest), ["l", "h"]).dropDuplicates(["l"]).select("t", "l").collect()
    return fit(sorted((r["t"], r["l"]) for r in sample))


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns in ``keep``) with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        buckets = len(m.weights) - 1 if m else 0

        def work(b):
            texts = b.column(text)
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if m is None:
                return [pred, score]
            vocab: dict[str, int] = defaultdict(count().__next__)
            rows, ids = [], []
            for i, t in enumerate(texts):
                if words := words_of(t.as_py()):
                    rows.append(i)
                    ids.append(np.fromiter(map(vocab.__getitem__, words), np.int64, len(words)))
            if not rows:
                return [pred, score]
            lengths = np.array([len(x) for x in ids])
            scores = emissions(*features(list(vocab), buckets), m.weights)
            prob, _ = forward_backward(scores[np.concatenate(ids)], lengths, m.steps)
            mean = np.add.reduceat(prob, np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
            best = mean.argmax(axis=1)
            for i, j, s in zip(rows, best, mean.max(axis=1)):
                pred[i] = m.languages[j]
                score[i] = min(1.0, s)
            return [pred, score]

        return work

    new = [("lang_pred", T.StringType()), ("score", T.DoubleType())]
    return map_arrow(docs, make, new, docs.columns if keep is None else keep)


def label_words(model: Model, text: str) -> list[tuple[str, str]]:
    """Words of one text with their likeliest languages."""
    words = words_of(text)
    if not words:
        return []
    scores = emissions(*features(words, len(model.weights) - 1), model.weights)
    prob, _ = forward_backward(scores, np.array([len(words)]), model.steps)
    return [(w, model.languages[j]) for w, j in zip(words, prob.argmax(axis=1))]


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
