"""Near copies of the pipeline against all pairs of five-word shingle sets."""

from __future__ import annotations

import random

import pyarrow as pa
from subtide.llm import nearcopies, pipeline, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _words(r, n):
    return [f"{r.choice('abcdefgh')}{r.randint(0, 10**6)}" for _ in range(n)]


def _planted():
    """Texts with edited copies of many similarities, a large group of near copies, and texts that share a passage only."""
    r = random.Random(5)
    texts = []
    for n in (20, 60, 120, 300):
        base = _words(r, n)
        texts.append(base)
        for edits in (1, 1, 2, 3, 4, 6):
            copy = list(base)
            for at in r.sample(range(n), edits):
                copy[at] = f"edit{r.randint(0, 10**6)}"
            texts.append(copy)
        texts.append(base[: n * 9 // 10])
    base = _words(r, 80)
    texts += [base[:k] + ["other"] + base[k + 1 :] for k in range(0, 80, 2)]
    passage = _words(r, 55)
    texts += [_words(r, 30) + passage + _words(r, 30) for _ in range(12)]
    texts += [["one"], ["One"], ["two", "words"], []]
    return [" ".join(t) for t in texts]


def _sets(texts):
    out = []
    for t in texts:
        w = t.lower().split()
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_components(texts):
    s = _sets(texts)
    comp = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if s[i] == s[j] or 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    return comp


def test_stage_drops_planted_near_copies(spark, monkeypatch):
    texts = _planted()
    comp = brute_components(texts)
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    kept = {r["doc_id"] for r in pipeline.near_duplicate_stage(spark, rows, "").collect()}
    assert kept == set(comp)
    fingerprints = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(rows).collect()}
    assert len(set(fingerprints.values())) > len(kept)
    monkeypatch.setattr(nearcopies, "HOT", 3)
    split = {r["doc_id"]: r["component"] for r in nearcopies.near_copies(rows, cell=4).collect()}
    assert all((split[i] == split[j]) == (comp[i] == comp[j]) for i in range(len(comp)) for j in range(i))


def test_stage_needs_no_doc_ids(spark):
    """Two texts under one doc_id are not linked by it, and rows without one are linked by their texts."""
    r = random.Random(9)
    a, b, c = (_words(r, 90) for _ in range(3))
    near = c[:40] + ["other"] + c[41:]
    texts = [(1, " ".join(a)), (1, " ".join(b)), (None, " ".join(c)), (None, " ".join(near))]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], SCHEMA)
    kept = [(x["doc_id"], x["text"]) for x in pipeline.near_duplicate_stage(spark, rows, "").collect()]
    assert len(kept) == 3 and set(texts[:2]) < set(kept)


def _edited(r, base, kind):
    """``base`` with as many edits of one kind as leave a similarity of 0.8."""
    n = len(base)
    best = None
    for edits in range(1, n, max(1, n // 90)):
        copy = list(base)
        at = sorted({(k * n + n // 2) // edits for k in range(edits)})
        if kind == "spread":
            for k in at:
                copy[k] = f"edit{r.randint(0, 10**6)}"
        elif kind == "inserted":
            for k in reversed(at):
                copy.insert(k, f"new{r.randint(0, 10**6)}")
        elif kind == "deleted":
            for k in reversed(at):
                del copy[k]
        elif kind == "random":
            for k in r.sample(range(n), edits):
                copy[k] = f"edit{r.randint(0, 10**6)}"
        elif kind == "run":
            copy[n // 3 : n // 3 + edits] = [f"edit{r.randint(0, 10**6)}" for _ in range(edits)]
        elif kind == "cut":
            copy = copy[edits:]
        elif kind == "moved":
            copy = copy[-edits:] + copy[:-edits]
        else:
            copy += [f"more{r.randint(0, 10**6)}" for _ in range(edits)]
        a, b = _sets([" ".join(base), " ".join(copy)])
        if 5 * len(a & b) < 4 * len(a | b) or kind == "moved" and edits > n // 2:
            break
        best = copy
    return best


def test_recall_of_pairs_by_kind_of_edit(spark):
    """Pairs at the edge of the similarity, of every kind and size: nine in ten are found, those under 64 shingles all."""
    r = random.Random(17)
    kinds = ("spread", "inserted", "deleted", "random", "run", "cut", "moved", "added")
    pairs = []
    for kind in kinds:
        for n in (40, 70, 100, 180, 260, 400, 700, 1100, 1500):
            for _ in range(3):
                base = _words(r, n)
                copy = _edited(r, base, kind)
                if copy:
                    pairs.append((kind, n, " ".join(base), " ".join(copy)))
    rows = [(2 * i + s, p[2 + s], "en", "s", 1) for i, p in enumerate(pairs) for s in (0, 1)]
    got = {x["doc_id"]: x["component"] for x in nearcopies.near_copies(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    linked = [got[2 * i] == got[2 * i + 1] for i in range(len(pairs))]
    assert len(pairs) > 150 and len(set(got.values())) == len(pairs) * 2 - sum(linked)
    assert all(x for x, p in zip(linked, pairs) if p[1] < 64)
    print("recall", {k: (sum(x for x, p in zip(linked, pairs) if p[0] == k), sum(p[0] == k for p in pairs)) for k in kinds})
    for kind in kinds:
        own = [x for x, p in zip(linked, pairs) if p[0] == kind]
        assert sum(own) >= 0.9 * len(own), (kind, [(p[1], x) for x, p in zip(linked, pairs) if p[0] == kind])


def test_fingerprints_link_as_the_simhash_operator_does(spark):
    """Pairs to verify connect what lies within three bits, and sets of one fingerprint, and nothing else."""
    r = random.Random(11)
    base = [r.getrandbits(63) for _ in range(15)]
    prints = base + [b ^ (1 << r.randint(0, 62)) ^ (1 << r.randint(0, 62)) for b in base] + base[:4] * 2
    nodes = spark.createDataFrame(list(enumerate(prints)), "node long, fp long")
    close = [(u, v) for u in range(len(prints)) for v in range(u) if (prints[u] ^ prints[v]).bit_count() <= 3]

    def labels(edges):
        label = list(range(len(prints)))
        for _ in prints:
            for u, v in edges:
                label[u] = label[v] = min(label[u], label[v])
        return label

    assert labels([tuple(x) for x in nearcopies.fingerprint_pairs(nodes).collect()]) == labels(close)


def test_near_copies_by_fingerprint_alone(spark, monkeypatch):
    """With no cells of segments at all, the SimHash step still finds a long text with one word edited; whole sets decide."""
    r = random.Random(2)
    base = _words(r, 900)
    near, far = base[:450] + ["edit"] + base[451:], _words(r, 900)
    texts = [" ".join(t) for t in (base, near, far)]
    prints = simhash.fingerprints_of(pa.array(texts), nearcopies.WIDTH).tolist()
    assert (prints[0] ^ prints[1]).bit_count() <= 3 < (prints[0] ^ prints[2]).bit_count()
    monkeypatch.setattr(nearcopies, "cells_of", lambda nodes, similarity: spark.createDataFrame([], "node long, key long"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(x["doc_id"] for x in pipeline.near_duplicate_stage(spark, docs, "").collect()) == [0, 2]
