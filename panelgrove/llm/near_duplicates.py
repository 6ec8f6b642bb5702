"""Near-duplicate documents by a forest of sorted MinHash orders, links confirmed on full sets.

A document's set holds its distinct runs of ``width`` words; equal sets are joined into one class
first, so exact copies cost one aggregation. Each class gets a signature of ``HASHES`` minima.
Every tree of the forest is one order of the signature, starting at another place; documents that
agree on the first ``DEPTH`` values of an order form a region of it. Three steps follow:

1. Each tree is sorted by the whole signature, and every document meets its neighbours on both
   sides, those with the longest common prefix. The best of these links of each document are
   confirmed on full sets, then those that are still between components.
2. In regions of at most ``REGION`` documents every pair of different components whose signatures
   agree well enough is confirmed too.
3. Larger regions are joined into families. A family is compared exactly and as a whole on its full
   sets, in blocks of at most ``BLOCK`` shingles (or one document) and without putting out pairs:
   a block task counts overlaps only between documents of different components and gives the links
   that join them. Documents whose sizes alone rule a link out do not meet.

So a pair is missed only if no tree gives it a common prefix of ``DEPTH`` values: at similarity
0.85 one tree brings a pair together with probability 0.52, so 30 trees miss it with probability
2e-10 (at 0.8: 1e-7), whatever the size of the region. Step 3 is quadratic in those documents of a
family that are alike, but in no component with the rest; its memory is bounded.

Defined cases: a null or empty text, or one without words, has an empty set, links with nothing
and is its own component; with fewer words than ``width`` the whole sequence is the one element;
a null id takes no part and gets a null component; rows that share an id count as one document, and
each is reported; ties cannot occur, as components are named by their smallest id; very long texts
are hashed whole, in parts; an empty table gives an empty one; other columns of ``docs`` are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_KEYS, WordHash, among, groups, map_arrow, odd_constants, raw_texts, settle, shingle_hashes, table
from .components import components, merge

TREES, DEPTH, REGION = 30, 4, 48
HASHES = TREES * DEPTH
#: Shingles of a block of a large family; two blocks meet in a task.
BLOCK = 250_000
#: Documents of a block whose overlaps are counted at once.
STRIPE = 256
#: Shingles hashed at once for a signature.
PART = 4096


def signature(shingles: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Low 16 bits of the minima of ``HASHES`` permutations of 32-bit shingle hashes."""
    h = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    low = np.full(len(mul), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), PART):
        x = h[None, at : at + PART] ^ add[:, None]
        x *= mul[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        np.minimum(low, x.min(axis=1), out=low)
    return low.astype("<u2")


def _sets(text: str, width: int, full: bool):
    """Count and key of each set, with its signature or with the sorted hashes themselves."""

    def make():
        words, consts = WordHash(), odd_constants(max(width, 1), 3)
        mul, add = odd_constants(HASHES, 7, 32), odd_constants(HASHES, 8, 32)

        def work(b):
            n, key, data = [], [], []
            for raw in raw_texts(b, text):
                s = np.unique(shingle_hashes(words.of((raw or b"").lower().split()), width, consts))
                n.append(len(s))
                if len(s):
                    key.append(xxhash.xxh3_128_digest(s.tobytes()))
                    data.append(s.tobytes() if full else signature(s, mul, add).tobytes())
                else:
                    key.append(None)
                    data.append(None)
            return [n, key, data]

        return work

    return make


def _members(reps: DataFrame) -> DataFrame:
    """(rep, tree, key, n): the regions of more than one document, with their sizes."""
    prefix = F.col("sig2").substr(1 + 2 * DEPTH * F.col("tree"), F.lit(2 * DEPTH))
    rows = reps.select("rep", F.concat("sig", "sig").alias("sig2"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select("rep", "tree", F.xxhash64("tree", prefix).alias("key"))
    sizes = settle(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "regions")
    return settle(rows.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_KEYS else sizes, "key"), "members")


def _least_equal(percent: int) -> int:
    """Equal values of a signature that a linked pair has but for one case in 1e9."""
    j = percent / 100
    return int(HASHES * j - 6 * (HASHES * j * (1 - j)) ** 0.5)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def _pairs(a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(equal, pa.int64())], names=["a", "b", "equal"])


_PAIRS = "a long, b long, equal long"


def _neighbours(members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Neighbours in the sorted order of each tree that agree well enough. Orders are dealt by range, so
    a prefix that very many share is split."""
    least = _least_equal(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, rep, order = batch.column("tree").to_numpy(), batch.column("rep").to_numpy(), _signatures(batch.column("order"))
            if last is not None:
                tree, rep, order = np.append(last[0], tree), np.append(last[1], rep), np.concatenate([last[2], order])
            last = tree[-1:], rep[-1:], order[-1:]
            equal = (order[1:] == order[:-1]).sum(axis=1)
            keep = (tree[1:] == tree[:-1]) & (order[1:, :DEPTH] == order[:-1, :DEPTH]).all(axis=1) & (equal >= least) & (rep[1:] != rep[:-1])
            if keep.any():
                yield _pairs(rep[:-1][keep], rep[1:][keep], equal[keep])

    order = F.concat("sig", "sig").substr(1 + 2 * DEPTH * F.col("tree"), F.lit(2 * HASHES))
    rows = members.join(reps, "rep").select("tree", order.alias("order"), "rep")
    dealt = rows.repartitionByRange("tree", "order", "rep").sortWithinPartitions("tree", "order", "rep")
    return dealt.mapInArrow(run, _PAIRS).groupBy("a", "b").agg(F.max("equal").alias("equal"))


def _open_regions(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members with their component, of regions that hold more than one."""
    known = members.withColumn("comp", F.col("rep")) if labels is None else members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    return known.join(mixed, "key", "left_semi")


def _region_pairs(members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs between components in regions of at most ``REGION`` documents."""
    least = _least_equal(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "key"):
            ids, comp, sig = g.column("rep").to_numpy(), g.column("comp").to_numpy(), _signatures(g.column("sig"))
            x, y = np.triu_indices(len(ids), 1)
            apart = comp[x] != comp[y]
            x, y = x[apart], y[apart]
            equal = (sig[x] == sig[y]).sum(axis=1)
            keep = (equal >= least) & (ids[x] != ids[y])
            if keep.any():
                yield _pairs(ids[x[keep]], ids[y[keep]], equal[keep])

    rows = members.select("key", "rep", "comp").join(reps, "rep").repartition("key").sortWithinPartitions("key", "rep")
    return rows.mapInArrow(run, _PAIRS).select("a", "b").distinct()


def _links(shingles: list[np.ndarray], comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join different components among some sets, found from exact overlaps; at most one
    fewer than there are sets."""
    n = len(shingles)
    size = np.array([len(s) for s in shingles])
    flat = np.concatenate(shingles)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(n, dtype=np.int32), size)[order]
    fresh = np.append(True, flat[1:] != flat[:-1])
    del flat, order
    column = np.cumsum(fresh, dtype=np.int32) - 1
    begin = np.append(np.flatnonzero(fresh), len(owner))
    held = np.diff(begin)
    # Shingles of many documents are counted by a product of matrices, rare ones by their lists.
    common = held > max(8, n // 8)
    place = np.cumsum(common) - 1
    dense = np.zeros((n, int(common.sum())), np.float32)
    inside = common[column]
    dense[owner[inside], place[column[inside]]] = 1
    rare = ~inside & (held[column] > 1)
    by_doc = np.argsort(owner[rare], kind="stable")
    lists, starts = column[rare][by_doc], np.searchsorted(owner[rare][by_doc], np.arange(n + 1))
    parent = {int(c): int(c) for c in comp}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    found = []
    values, counts = np.unique(comp, return_counts=True)
    outside = np.flatnonzero(comp != values[np.argmax(counts)])  # pairs inside the largest need no look
    for at in range(0, len(outside), STRIPE):
        rows = outside[at : at + STRIPE]
        both = dense[rows] @ dense.T
        for r, i in enumerate(rows):
            cols = lists[starts[i] : starts[i + 1]]
            many = held[cols]
            if len(cols):
                where = np.repeat(begin[cols] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                both[r] += np.bincount(owner[where], minlength=n)
        linked = 100 * both >= percent * (size[rows][:, None] + size[None, :] - both)
        linked &= comp[rows][:, None] != comp[None, :]
        for r, j in zip(*np.nonzero(linked)):
            x, y = root(int(comp[rows[r]])), root(int(comp[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((int(rows[r]), int(j)))
    return found


def _family_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of the regions of more than ``REGION`` documents."""
    edges = members.join(members.groupBy("key").agg(F.min("rep").alias("a")), "key").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    family = components(edges).select(F.col("id").alias("rep"), F.col("comp").alias("family"))
    docs = family.join(members.select("rep", "comp").distinct(), "rep").join(sets.select("rep", (F.length("hashes") / 8).alias("n")), "rep")
    # Of a family that fills more than a block, each size band is cut into blocks of its own; a
    # link joins documents of the same band or of neighbouring ones.
    whole = docs.groupBy("family").agg(F.sum("n").alias("all"))
    band = F.when(F.col("all") <= BLOCK, 0).otherwise(F.floor(F.log(F.col("n")) / max(1e-6, -math.log(percent / 100))).cast("int"))
    docs = settle(docs.join(whole, "family").select("rep", "comp", "family", band.alias("band"), "n"), "families")
    blocks = docs.groupBy("family", "band").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    above = blocks.select("family", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = blocks.select("family", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    around = blocks.join(above, ["family", "band"], "left").join(below, ["family", "band"], "left")
    own = docs.join(around, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))

    def tasks(count: str, first, second, third, fourth):
        each = F.transform(F.sequence(F.lit(0), F.col(count) - 1), lambda j: F.xxhash64("family", first(j), second(j), third(j), fourth(j)))
        return F.when(F.col(count) > 0, each).otherwise(F.array().cast("array<bigint>"))

    b, k = F.col("band"), F.col("block")
    units = F.concat(
        tasks("blocks", lambda j: b, lambda j: F.least(j, k), lambda j: b, lambda j: F.greatest(j, k)),
        tasks("above", lambda j: b, lambda j: k, lambda j: b + 1, lambda j: j),
        tasks("below", lambda j: b - 1, lambda j: j, lambda j: b, lambda j: k),
    )
    rows = own.select("rep", "comp", F.explode(units).alias("key"))
    rows = _open_regions(rows.drop("comp"), docs.select(F.col("rep").alias("id"), "comp").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "key"):
            ids, comp = g.column("rep").to_numpy(), g.column("comp").to_numpy()
            found = _links([np.frombuffer(h, np.uint64) for h in g.column("hashes").to_pylist()], comp, percent)
            if found:
                x, y = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], names=["a", "b"])

    dealt = rows.join(sets.select("rep", "hashes"), "rep").select("key", "rep", "comp", "hashes").repartition("key").sortWithinPartitions("key", "rep")
    return dealt.mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets overlap enough."""

    def make():
        def work(b):
            out = []
            for x, y in zip(b.column("sa"), b.column("sb")):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                short, long = (p, q) if len(p) < len(q) else (q, p)
                at = np.searchsorted(long, short)
                both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
                out.append(100 * both >= percent * (len(p) + len(q) - both))
            return [out]

        return work

    left = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("sb"))
    checked = map_arrow(pairs.join(left, "a").join(right, "b"), make, [("linked", T.BooleanType())], ["a", "b"])
    return checked.filter("linked").select("a", "b").distinct()


def _added(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Components (id, comp) after adding links."""
    links = settle(links, "confirmed")
    return merge(labels, links) if links.limit(1).count() else labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles``, ``component_id`` (the smallest id
    linked to it, directly or through others) and ``kept`` (it is that document). Ids are whole
    numbers."""
    new = [("n_shingles", T.LongType()), ("key", T.BinaryType()), ("sig", T.BinaryType())]
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    first = settle(map_arrow(rows, _sets("text", width, False), new, ["id"]), "sets")
    usable = first.filter("key is not null and id is not null")
    # Rows that share an id are one document: they are linked through it.
    reps = settle(usable.groupBy("key").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")).select("rep", "sig"), "classes")
    members = _members(reps)
    candidates = settle(_neighbours(members, reps, percent), "candidates")
    ids = settle(members.select("rep").distinct(), "involved")
    involved = among(rows.withColumnRenamed("id", "rep"), "rep", ids)
    sets = settle(
        map_arrow(involved, _sets("text", width, True), [("n", T.LongType()), ("key", T.BinaryType()), ("hashes", T.BinaryType())], ["rep"])
        .filter("hashes is not null")
        .select("rep", "key", "hashes")
        .dropDuplicates(["rep", "key"]),
        "full-sets",
    )
    # Each document's best neighbour first.
    best = F.max_by(F.struct("a", "b"), F.struct("equal", -F.col("a"), -F.col("b")))
    ends = candidates.withColumn("end", F.explode(F.array("a", "b"))).groupBy("end").agg(best.alias("p"))
    labels = _added(None, _confirm(settle(ends.select("p.a", "p.b").distinct(), "best"), sets, percent))
    # Then what lies between components: other neighbours and small regions, and large regions.
    around = settle(_open_regions(members, labels), "open-regions")
    small = _region_pairs(around.where(F.col("n") <= REGION), reps, percent)
    apart = candidates.select("a", "b")
    if labels is not None:
        for end in ("a", "b"):
            apart = apart.join(labels.select(F.col("id").alias(end), F.col("comp").alias(f"c{end}")), end, "left")
        apart = apart.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    labels = _added(labels, _confirm(settle(small.union(apart).distinct(), "apart"), sets, percent))
    large = around.where(F.col("n") > REGION)
    if large.limit(1).count():
        if labels is not None:
            large = settle(_open_regions(large.drop("comp"), labels), "large-regions")
        labels = _added(labels, _family_links(large, sets, percent))
    # Back to all rows: only classes that have copies or links need a look-up.
    grouped = usable.groupBy("key").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    if labels is None:
        grouped = grouped.withColumn("comp", F.col("rep"))
    else:
        grouped = grouped.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    grouped = grouped.where("comp <> rep or rep <> last").select("key", "comp")
    out = first.select("id", "n_shingles", "key").join(grouped, "key", "left").withColumn("component_id", F.coalesce("comp", "id"))
    return out.select(F.col("id").alias(doc_id), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


ORACLE_OP2 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(v, r) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a),
m AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN m ON m.v = d.doc_id LEFT JOIN n USING (doc_id)
"""
