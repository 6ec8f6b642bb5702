"""Text operators against brute force, and on nulls, empty tables, repeats and clashing names."""

import hashlib
import itertools
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelgrove.llm import binary, decontamination, language, licenses, near_duplicates, nearest, packing, passages, pii, tokens, toxicity

DOCS = "doc_id long, text string, lang string, score double, hit_spans string"
LONG = " ".join(f"w{i}" for i in range(300))
ROWS = [
    (1, LONG, "en", 1.0, "x"),
    (2, LONG + " end", "en", 1.0, "x"),
    (3, None, "en", 1.0, "x"),
    (4, "", None, None, None),
    (5, "12 34 !!", "de", 1.0, "x"),
    (6, "Mail a@b.cd or 4111 1111 1111 1111, 1.2.3.4 and +1 (22) 333-4455 😀", "en", None, "x"),
    (7, "Licensed under the Apache License, Version 2.0.\nund der die das", "de", 1.0, "x"),
    (7, "Licensed under the Apache License, Version 2.0.\nund der die das", "de", 1.0, "x"),
    (None, "no id here", "en", 1.0, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tests_table(spark):
    return spark.createDataFrame([(10, " ".join(f"w{i}" for i in range(20, 35))), (11, "der DIE"), (12, None), (None, "no id here")], "item_id long, text string")


def test_decontamination(docs, none, tests_table):
    out = {r.doc_id: r for r in decontamination.find_contamination(docs, tests_table).collect() if r.doc_id}
    assert out[1].hit_items == ["10"] and [tuple(s) for s in out[1].hit_spans] == [(20, 35)] and out[1].n_words == 300
    assert out[7].hit_items == ["11"] and out[3].n_words == 0 and out[3].hit_spans == []
    clean = {r.doc_id: r.text for r in decontamination.remove_spans(decontamination.find_contamination(docs, tests_table)).collect()}
    assert "w20 " not in clean[1] and clean[1].startswith("w0 ") and clean[3] is None
    assert decontamination.find_contamination(none, tests_table).count() == 0
    assert decontamination.find_contamination(docs, tests_table.limit(0)).count() == len(ROWS)


def test_decontamination_in_blocks(docs, tests_table, monkeypatch):
    whole = sorted(map(str, decontamination.find_contamination(docs, tests_table).select("doc_id", "hit_spans", "hit_items").collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 4)
    assert sorted(map(str, decontamination.find_contamination(docs, tests_table).select("doc_id", "hit_spans", "hit_items").collect())) == whole


def test_near_duplicates(docs, none):
    out = {r.doc_id: r for r in near_duplicates.near_duplicates(docs).collect()}
    assert out[2].component_id == 1 and not out[2].kept and out[3].n_shingles == 0 and out[3].kept and out[7].kept and out[None].component_id is None
    assert near_duplicates.near_duplicates(none).count() == 0


def test_near_duplicates_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = [[f"t{x}" for x in rng.integers(0, 5000, 80)] for _ in range(6)]
    rows = []
    for i in range(240):
        w = list(base[i % 6])
        for j in rng.integers(0, 80, rng.integers(0, 4)):
            w[j] = f"e{rng.integers(0, 10**9)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(w.split()[j : j + 3]) for j in range(78)} for _, w in rows]
    parent = list(range(240))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(240):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    monkeypatch.setattr(near_duplicates, "REGION", 16)  # families and blocks on small data
    monkeypatch.setattr(near_duplicates, "BLOCK", 1000)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: root(i) for i in range(240)}


def test_near_duplicates_in_one_large_family(spark):
    """2,200 texts of one template, alike at 0.82 at most but for pairs alike at 0.86: production constants."""
    rng = np.random.default_rng(4)
    common, rows = [f"t{i}" for i in range(820)], []
    for i in range(2200):
        w = common + [f"p{i // 2}_{j}" for j in range(22)] + [f"o{i}_{j}" for j in range(68)]
        rows.append((i, " ".join(rng.permutation(w))))
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=1, percent=85)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i - i % 2 for i in range(2200)}


def test_links_of_a_family_are_those_of_all_pairs():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(150)]
    comp = np.arange(150)
    comp[40:60] = 40

    def joined(links):
        root = list(comp)
        for x, y in links:
            a, b = root[x], root[y]
            root = [min(a, b) if c in (a, b) else c for c in root]
        return root

    brute = [(x, y) for x in range(150) for y in range(x) if 100 * (k := len(np.intersect1d(sets[x], sets[y]))) >= 60 * (len(sets[x]) + len(sets[y]) - k)]
    found = near_duplicates._links(sets, comp, 60)
    assert joined(found) == joined(brute) and {(max(p), min(p)) for p in found} <= {*brute} and len(found) < 150


def test_language(docs, none):
    model = language.fit([("der die das und nicht ist von", "de"), ("the and that with from this have", "en")] * 20)
    out = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(docs, model, keep=["doc_id"]).collect()]
    assert ("und", 0.0) in {x[1:] for x in out if x[0] == 5} and all(x[1] == "und" for x in out if x[0] in (3, 4))
    assert [p for _, p in language.label_words(model, "the and that nicht ist von")] == ["en"] * 3 + ["de"] * 3
    assert language.learn(none) is None and language.identify(docs, None).where("lang_pred <> 'und'").count() == 0


def test_forward_backward_is_that_of_all_paths(monkeypatch):
    rng = np.random.default_rng(11)
    monkeypatch.setattr(language, "SEGMENT", 2)  # messages between segments too
    lengths = np.array([5, 1, 4])
    scores, steps = rng.normal(size=(10, 3)), rng.normal(size=(3, 3))
    prob, pairs = language.forward_backward(scores, lengths, steps)
    want, moves, at = np.zeros((10, 3)), np.zeros((3, 3)), 0
    for n in lengths:
        paths = np.array(list(itertools.product(range(3), repeat=int(n) + 1)))  # the word before the first is unknown
        w = np.exp([scores[at + np.arange(n), p[1:]].sum() + steps[p[:-1], p[1:]].sum() for p in paths])
        w /= w.sum()
        for p, x in zip(paths, w):
            want[at + np.arange(n), p[1:]] += x
            np.add.at(moves, (p[:-1], p[1:]), x)
        at += n
    np.testing.assert_allclose(prob, want, atol=1e-9)
    np.testing.assert_allclose(pairs, moves, atol=1e-9)


def test_language_learns_from_every_language(spark, monkeypatch):
    rows = [(i, f"wort{i % 70}a wort{i % 70}b", f"l{i % 70}") for i in range(2100)] + [(3000, "lang " * 5000, "long")]
    monkeypatch.setattr(language, "fit", lambda rows: rows)
    sample = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {lang for _, lang in sample} == {*(f"l{i}" for i in range(70)), "long"}
    assert max(len(t) for t, _ in sample) == language.MAX_CHARS
    monkeypatch.setattr(language, "PER_LANGUAGE", 1)
    few = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {lang for _, lang in few} == {lang for _, lang in sample} and len(few) < 250


def test_packing_round_trip(docs, none):
    out = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), window=64).collect()
    encode, texts = tokens.encoder(), {r[0]: r[1] for r in ROWS}
    for i in {r.doc_id for r in out}:
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in own])
        assert ids.tolist() == [*encode(texts[i]), 1] and own[0].doc_tokens == len(ids)
    fill = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 64 and all(n & (n - 1) == 0 for n in fill.values())
    assert packing.pack(none).count() == 0


def test_ids_are_those_of_the_own_file():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_paths()[0])
    for t in ["It's über 12 — ñandú\n\n  x", "a <|endoftext|> b", "  two  spaces ", "日本語 テスト", "  x", ROWS[5][1]]:
        assert tokens.encoder()(t).tolist() == own.encode(t, add_special_tokens=False).ids


def test_sum_of_squares_choice():
    """Each piece goes to the level that an exhaustive search finds best."""
    rng, window = np.random.default_rng(2), 23
    packer, fills = packing.SumOfSquares(window), []
    for i, size in enumerate(rng.integers(1, window, 600).tolist()):
        def after(level):
            left = list(fills)
            if level:
                left.remove(level)
            return sum(n * n for n in Counter(x for x in [*left, level + size] if x < window).values())

        costs = {level: after(level) for level in {0, *fills} if level + size <= window}
        level = packer.place((i, 0, size))
        assert costs[level] == min(costs.values()) and level == min(x for x in costs if costs[x] == costs[level])
        if level:
            fills.remove(level)
        if level + size < window:
            fills.append(level + size)
        assert packer.held == sum(fills)
        if i % 200 == 150:
            packer.compact()
            fills = [fills_left] if (fills_left := sum(fills) % window) else []
            assert packer.held == sum(fills)
    packer.finish()
    sizes = [sum(p[2] for p in w) for w in packer.closed]
    assert all(n == window or n & (n - 1) == 0 for n in sizes)
    pieces = sorted(p for w in packer.closed for p in w)
    assert all(y[1] == x[1] + x[2] if x[0] == y[0] else y[1] == 0 for x, y in zip(pieces, pieces[1:]))


def test_packing_of_remainders_that_never_fit_together(spark, monkeypatch):
    monkeypatch.setattr(packing, "OPEN_TOKENS", 500)
    most = []
    place = packing.SumOfSquares.place
    monkeypatch.setattr(packing.SumOfSquares, "place", lambda self, piece: (most.append(self.held), place(self, piece))[1])
    packer = packing.SumOfSquares(64)
    for i in range(3000):
        packer.place((i, 0, 40))
        if packer.held > packing.OPEN_TOKENS:
            packer.compact()
    packer.finish()
    assert max(most) <= 540 and sum(p[2] for w in packer.closed for p in w) == 120_000 and len(packer.closed) == 1875


def test_binary_round_trip(docs, none):
    out = binary.pack_binary(docs, window=64).collect()
    assert sum(r.n_tokens for r in out) == sum(len(tokens.encoder()(r[1])) + 1 for r in ROWS)
    pieces = {}
    for r in out:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        for d, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces.setdefault(d, []).append((start, ids[a:b]))
    for d, own in pieces.items():
        whole = [*tokens.encoder()(next(r[1] for r in ROWS if r[0] == d)).tolist(), 1]
        times = sum(r[0] == d for r in ROWS)
        assert sorted(own) == sorted((at, whole[at : at + 64]) for at in range(0, len(whole), 64) for _ in range(times))
    assert all(r.cu_seqlens[-1] == r.n_tokens <= 64 and r.position_resets == r.cu_seqlens[:-1] for r in out)
    ids, pos = binary.matrix(out, 64)
    assert ids.shape == (len(out), 64) and (pos[:, 0] == 0).all()
    assert binary.pack_binary(none).count() == 0
    sizes = [7, 5, 5, 3, 2, 2, 1]
    held = binary.best_fit_decreasing(sizes, 10)
    assert sorted(i for w in held for i in w) == list(range(7)) and all(sum(sizes[i] for i in w) <= 10 for w in held) and len(held) == 3


def test_best_fit_is_that_of_a_linear_scan():
    rng = np.random.default_rng(9)
    for _ in range(30):
        sizes = rng.integers(1, 40, rng.integers(0, 200)).tolist()
        rooms, want = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fit = min((r for r in rooms if r >= sizes[i]), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((40 if fit is None else fit) - sizes[i])
            want.append(fit)
        held = binary.best_fit_decreasing(sizes, 40)
        assert sorted(40 - sum(sizes[i] for i in w) for w in held) == sorted(rooms)
        assert sorted(i for w in held for i in w) == list(range(len(sizes))) and len(held) == want.count(None)


def test_passages(docs, none, spark):
    out = passages.shared_passages(docs).collect()
    assert [(r.doc_id, r.source_id, r.n_words, r.edits) for r in out] == [(2, 1, 300, 0)]
    assert passages.shared_passages(none).count() == 0
    own = [f"a{i}" for i in range(40)] + [f"w{i}" for i in range(100, 130)] + ["odd"] + [f"w{i}" for i in range(130, 170)] + [f"b{i}" for i in range(40)]
    fuzzy = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(20, " ".join(own))], "doc_id long, text string"))
    r = passages.shared_passages(fuzzy).where("doc_id = 20").first()
    assert (r.source_id, r.start_word, r.end_word, r.edits) == (1, 40, 111, 1)
    assert passages.edits(np.array([1, 2, 3]), np.array([1, 3, 4])) == 2


def test_passage_whose_seeds_have_other_first_holders(spark):
    rng = np.random.default_rng(1)
    fresh = lambda n: [f"x{i}" for i in rng.integers(0, 10**9, n)]
    passage = fresh(70)
    parts = {10: passage[:40], 11: passage[30:], 20: passage, 25: passage[:45], 26: passage[20:60], 30: passage}
    rows = [(i, " ".join(fresh(30) + w + fresh(30))) for i, w in parts.items()]
    out = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.source_id, r.start_word, r.end_word, r.source_start, r.edits) for r in out] == [(30, 20, 30, 100, 30, 0)]


def test_passages_in_another_order_and_twice(spark):
    rng = np.random.default_rng(2)
    fresh = lambda n: [f"x{i}" for i in rng.integers(0, 10**9, n)]
    p1, p2, p3 = fresh(100), fresh(140), fresh(95)
    parts = {10: p1 + p2 + p3, 20: p1 + p3 + p2, 30: p3 + fresh(40) + p3}
    rows = [(i, " ".join(w)) for i, w in parts.items()]
    out = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source_id, r.start_word, r.end_word, r.source_start) for r in out} == {(20, 10, 0, 100, 0), (20, 10, 100, 195, 240), (20, 10, 195, 335, 100), (30, 10, 0, 95, 240), (30, 10, 135, 230, 240)}


def test_passages_are_those_of_all_pairs_of_runs(spark):
    """Every run of 50 words that an earlier document holds word for word lies in a reported passage, and no
    other document is reported."""
    rng = np.random.default_rng(13)
    fresh = lambda n: [f"x{i}" for i in rng.integers(0, 10**9, n)]
    blocks, docs = [fresh(int(n)) for n in rng.integers(30, 120, 12)], {}
    for i in range(40):
        words = fresh(20)
        for _ in range(int(rng.integers(0, 4))):
            b = blocks[int(rng.integers(0, 12))]
            a = int(rng.integers(0, len(b) - 10))
            words += b[a : a + int(rng.integers(10, 130))] + fresh(int(rng.integers(1, 60)))
        docs[i] = words
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(39, "a second row of the last")]
    out = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    docs[39] = min([" ".join(docs[39]), "a second row of the last"]).split()
    held = {}
    for i, w in docs.items():
        for at in range(len(w) - 49):
            held.setdefault(tuple(w[at : at + 50]), []).append((i, at))
    shared = {(i, at) for own in held.values() for i, at in own if i > own[0][0]}
    covered = {(r.doc_id, at) for r in out for at in range(r.start_word, r.end_word - 49)}
    assert shared and shared <= covered and all(r.source_id < r.doc_id and r.n_words >= 50 for r in out)
    assert {r.doc_id for r in out} == {i for i, _ in shared}


def qualifies(x, y, min_words=50, min_identity=0.8):
    """Whether any run of ``x`` has any run of ``y`` like it with the same first and last words, by the edits
    between all runs."""
    d = np.arange(len(y) + 1)
    for a in range(len(x) - min_words + 1):
        t = np.where(d >= d[:, None], d - d[:, None], 10**6)
        for n in range(1, len(x) - a + 1):
            new = t + 1
            new[:, 1:] = np.minimum(new[:, 1:], t[:, :-1] + (y != x[a + n - 1]))
            t = np.minimum.accumulate(new - d, axis=1) + d
            ends = np.outer(np.append(y == x[a], False), np.append(False, y == x[a + n - 1])) & (d > d[:, None])
            if n >= min_words and (ends & (t <= (1 - min_identity) * np.maximum(n, d - d[:, None]) + 1e-9)).any():
                return True
    return False


def edited(words, share, rng):
    """Every so many words one is replaced, left out or followed by a new one."""
    out = []
    for w in words:
        kind = rng.integers(0, 3) if rng.random() < share else 3
        out += [[int(rng.integers(10**6))], [], [w, int(rng.integers(10**6))], [w]][kind]
    return out


def test_passages_with_edits_link_all_pairs_of_documents(spark):
    """Pairs by brute force, of edited versions of a passage whose runs of 8 words are mostly broken."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 10**6, 70)
    docs = {i: np.array([*rng.integers(0, 10**6, 6), *edited(base, share, rng), *rng.integers(0, 10**6, 6)]) for i, share in enumerate([0, 0.04, 0.1, 0.06, 0.12, 0.08, 0.1, 0.05, 0.12, 0.25])}
    docs[10] = np.array([w for k, w in enumerate(base) if k % 7 != 3])
    want = {(i, j) for i in docs for j in docs if j < i and qualifies(docs[i], docs[j])}
    rows = [(i, " ".join(f"x{v}" for v in w)) for i, w in docs.items()]
    out = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source_id) for r in out} == want and 12 < len(want) < 55
    for r in out:
        a, b = docs[r.doc_id][r.start_word : r.end_word], docs[r.source_id][r.source_start : r.source_end]
        assert r.n_words == len(a) >= 50 and passages.edits(a, b) <= r.edits and r.identity >= 0.8 - 1e-9


def test_edited_passages_are_those_of_brute_force():
    rng = np.random.default_rng(6)
    seen = []
    for k in range(60):
        vocabulary = int([3, 8, 30, 10**6][k % 4])
        y = rng.integers(0, vocabulary, int(rng.integers(50, 75)))
        x = np.array([*rng.integers(0, vocabulary, 5), *edited(y, [0.1, 0.2, 0.3][k % 3], rng)])
        hashed = [w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1) for w in (x, y)]
        seen.append(qualifies(x, y))
        assert bool(passages.edited_passages(*hashed, [], 50, 0.8)) == seen[-1]
    assert 10 < sum(seen) < 58


def test_copies_of_an_edited_passage_are_not_expanded(spark):
    """Copies point to the first one, which alone is compared with the edited text."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 10**6, 300).tolist()
    other = [int(rng.integers(10**6)) if k % 6 == 0 else w for k, w in enumerate(base)]
    rows = [(i, " ".join(f"x{v}" for v in (other if i == 3 else base))) for i in range(8)]
    out = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source_id) for r in out} == {(i, 0) for i in range(1, 8)} and all(r.edits == 0 for r in out if r.doc_id != 3)


def test_passages_of_a_repeated_line(spark):
    line = " ".join(f"x{i}" for i in range(12))
    out = passages.shared_passages(spark.createDataFrame([(i, " ".join([line] * 20)) for i in (1, 2)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.source_id, r.start_word, r.end_word) for r in out] == [(2, 1, 0, 240)]


def test_chain_keeps_what_lies_between_the_runs_of_a_path():
    p, q = np.array([0, 10, 20, 110, 120, 210, 220, 230]), np.array([0, 10, 20, 310, 320, 110, 120, 130])
    assert sorted(passages.chain(p, q)) == [[0, 1, 2], [3, 4], [5, 6, 7]]


def test_licenses(spark, docs, none):
    model = licenses.learn(docs)
    out = {r.doc_id: r for r in licenses.scan(docs, model).collect()}
    assert [(x.paragraph, x.line, x.family, x.confirmed) for x in out[7].licenses] == [(0, 0, "apache-2.0", True)] and out[3].n_paragraphs == 0 and not out[1].licenses
    assert licenses.scan(none, licenses.learn(none)).count() == 0
    # What the fit has not seen: parts of notices are told apart from sentences without a family.
    held = model.held_out
    assert held["family_right"] >= 0.9 * (held["family_right"] + held.get("family_missed", 0)) and held["unknown_left"] >= 0.75 * (held["unknown_left"] + held.get("unknown_taken", 0))
    wrapped = {
        1: "int x;\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software",
        2: "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.",
        3: "Prose of the general public.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.",
        4: "The company may use the following software in the documentation of the program.\n \t\n",
    }
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([*wrapped.items()], "doc_id long, text string"), model).collect()}
    found = {i: [(x.paragraph, x.family, x.confirmed) for x in r.licenses] for i, r in got.items()}
    assert found == {1: [(1, "mit", True)], 2: [(0, "apache-2.0", True)], 3: [(0, "cc-by-nc", True), (0, "mit", True)], 4: []} and got[4].n_paragraphs == 1


def test_scores_of_licences_are_those_of_the_formula(spark):
    model = licenses.Model(["a", "b", licenses.UNKNOWN], [0.1, -0.2, 0.4], {"x y": [1.0, -1.0, 0.5], "y z": [0.3, 2.0, -1.0]}, [("a", ["x y"])], 1.5, -0.3, {})
    for text in ["x y", "y z.", "x, Y z", "x z"]:
        grams = [g for g in model.weights if g in " ".join(re.findall("[a-z]+", text.lower()))]
        s = np.array(model.bias) + sum((np.array(model.weights[g]) for g in grams), np.zeros(3))
        p = np.exp(s) / np.exp(s).sum()
        best = int(np.argmax(p[:2]))
        want = 1 / (1 + np.exp(-(1.5 * np.log(p[best] / (1 - p[best])) - 0.3)))
        got = licenses.scan(spark.createDataFrame([(text,)], "text string"), model).first().licenses
        assert [(r.family, pytest.approx(r.probability)) for r in got] == ([(model.families[best], want)] if grams and want >= licenses.LEAST else [])


def test_toxicity(spark, docs, none):
    rows = [(100 + i, f"good text {'vile nasty' if i % 4 == 0 else 'fine'} number") for i in range(120)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.createDataFrame([(100 + i, int(i % 4 == 0)) for i in range(60)] + [(1, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(d, toxicity.learn(d, labels)).collect()}
    assert all((out[100 + i].score >= 0.7) == (i % 4 == 0) for i in range(120)) and out[3].score < 0.5
    assert out[100].evidence[0].toxic == 1 and out[100].evidence_terms[:2] == ["nasty", "vile"]
    assert toxicity.learn(none, labels) is None and toxicity.score(docs, None).where("score > 0").count() == 0


def test_toxic_neighbours_are_those_of_a_full_scan():
    rng = np.random.default_rng(7)
    texts = [" ".join(f"{'abcdefghij'[x % 10]}{'klmnopqrst'[x // 10]}" for x in np.minimum(99, rng.zipf(1.3, rng.integers(1, 60)))) for _ in range(700)] + ["ak bk", "ak bk"]
    examples = [{"doc_id": i, "y": i % 2, "terms": list(c), "counts": list(c.values())} for i, t in enumerate(texts) if (c := Counter(toxicity.terms_of(t)))]
    number = {t: i for i, t in enumerate(sorted({t for e in examples for t in e["terms"]}))}
    index = toxicity._index(examples, number, rng.uniform(0.1, 9, len(number)))
    dense = np.zeros((len(examples), len(number)))
    for e, i in enumerate(index.ids):
        t, v = index.vector(texts[i])
        dense[e, t] = v
    for text in [*texts[:80], texts[-1], "ak zz qq"]:
        t, v = index.vector(text)
        s = np.round(dense[:, t] @ v, 12)
        want = np.lexsort((index.ids, -s))[:16]
        want = [e for e in want[1 if s[want[0]] >= toxicity.SAME else 0 :][:15] if s[e] > 0]
        i, c = index.nearest(t, v)
        assert i.tolist() == want and np.allclose(c, s[want])
    assert len(index.nearest(np.zeros(0, np.int64), np.zeros(0))[0]) == 0


def test_nearest_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[:100] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = nearest.search(df, df.where("vec_id % 50 = 0"), k=10).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = []
    for q, ids in got.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits.append(len({*np.lexsort((np.arange(1500), -s))[:10].tolist()} & {*ids}) / 10)
    assert len(got) == 30 and np.mean(hits) >= 0.9
    assert nearest.search(df.limit(0), df.limit(0)).count() == 0
    few = nearest.search(df.where("vec_id < 3"), df.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in few] == [(1, 1), (2, 2)]


def test_nearest_of_clusters_and_equal_vectors(spark):
    """Clusters are found in the trees alone; equal vectors score equal and rank by id."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    x = np.repeat(centres, 30, axis=0) + 0.02 * rng.normal(size=(1200, 24))
    x[600:700] = x[600]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(df, df.where("vec_id % 20 = 0"), k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = []
    for q in range(0, 1200, 20):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(1200), -s))[:10].tolist()
        hits.append(len({*want} & {i for i, _ in got[q]}) / 10)
        assert all(v == s[i] for i, v in got[q])
        if 600 <= q < 700:
            assert [i for i, _ in got[q]] == [i for i in range(600, 611) if i != q][:10]
    assert np.mean(hits) >= 0.9


def base_spans(t):
    """The contract's base kinds by Python's own patterns."""
    def luhn(d):
        return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = [True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else True, 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15][k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark, docs, none):
    more = [(30, "x a@b.c_x@d.e y@z 1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1 4111-1111-1111-1111 4111111111111112 +12 (345) 678-901-2 +1 23"), (31, "a" * 2_000 + "@" + "1" * 50_000), (32, "1 " * 30_000)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    weights = pii.learn(d)
    for r in pii.find_spans(d, weights).collect():
        assert [(s.start, s.kind, s.end) for s in r.pii_spans if s.base] == base_spans(r.text)
    text = {r.doc_id: r.text for r in pii.redact(pii.find_spans(docs, weights)).collect()}
    assert text[6] == "Mail [EMAIL] or [CARD], [IP] and [PHONE] 😀" and text[3] is None
    assert pii.learn(none) == {} and pii.find_spans(none, {}).count() == 0


def test_pii_query_counts_each_kind(spark, tmp_path):
    """The query's own columns, not only the spans of the operator."""
    kinds = ["email", "ip", "card", "phone"]
    texts = ["a@b.cd 1.2.3.4 4111111111111111 +12 345 678 901", "+12 345 678 901, 1.2.3.4 4.3.2.1 x@y.z u@v.w 9.9.9.9", "4111 1111 1111 1111 x 4111-1111-1111-1111", "999.1.1.1", "", None]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.op10_pii(spark, str(tmp_path)).collect():
        spans = base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_each_added_span_stays_once(spark):
    """Of likely spans that overlap no base span, those of the earliest kind stay; none is lost or doubled."""
    text = "999.1.1.1 " * 3 + "a@b.cd " + "".join(f"deadbeef{i:024d} " for i in range(10, 13)) + "+1 23 4111111111111"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    every = pii.find_spans(d, {("kind", k): 5.0 for k in range(5)}).first().pii_spans
    found = [tuple(c)[:4] for c in d.select(pii.candidates(F.col("text")).alias("c")).first().c]
    base = [c for c in found if c[3]]
    clear = lambda c, others: all(o[2] <= c[1] or c[2] <= o[1] for o in others)
    added = [c for c in found if not c[3] and clear(c, base)]
    added = [c for c in added if clear(c, [o for o in added if o[0] < c[0]])]
    assert [(s.kind, s.start, s.end, s.base) for s in every] == sorted(base + added, key=lambda c: (c[1], c[0])) and {c[0] for c in added} >= {1, 4}


def test_pii_of_a_text_with_100_000_spans(spark):
    text = " ".join(f"10.{i % 256}.{i // 256 % 256}.7" if i % 3 else f"u{i}@x.io" for i in range(100_000))
    d = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    found = pii.find_spans(d, {("kind", 1): -5.0})
    start = time.time()
    row = pii.redact(found.where("doc_id = 1")).first()
    assert time.time() - start < 40
    assert [(s.start, s.kind, s.end) for s in row.pii_spans] == base_spans(text)
    assert row.text == " ".join("[IP]" if i % 3 else "[EMAIL]" for i in range(100_000))


def test_added_spans_overlap_no_base_span_and_no_earlier_kind(spark):
    rng = np.random.default_rng(3)
    spans = [(int(k), int(a), int(a + n), bool(b), [0] * 5, 0) for k, a, n, b in zip(rng.integers(0, 5, 900), rng.integers(0, 9000, 900), rng.integers(1, 15, 900), rng.integers(0, 2, 900))]
    d = spark.createDataFrame([([s for s in spans if not s[3]], [s for s in spans if s[3]])], f"a {pii._TYPE}, b {pii._TYPE}")
    got = d.select(pii._clear(F.col("a"), F.col("b")).alias("c")).first().c
    want = [s for s in spans if not s[3] and not any(o[3] and o[1] < s[2] and s[1] < o[2] for o in spans)]
    assert sorted(tuple(c)[:3] for c in got) == sorted(s[:3] for s in want) and len(want) > 20


def test_pipeline_stages(spark, docs, tests_table, tmp_path):
    tests_table.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = docs.withColumn("n_chars", F.length("text")).withColumn("__row", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == rows.columns
        rows = out.cache()
    kept = {r.doc_id: r for r in rows.collect()}
    assert set(kept) == {1, 6, 7, None} and rows.count() == 4 and kept[1].n_chars == len(kept[1].text) < len(LONG)
    assert corpus_pipeline.pack_windows(spark, rows, "").count() >= 4
