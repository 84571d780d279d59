"""Language-model scores, periodic runs and source divergence against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from subtide.llm import divergence, lm, periodic

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
bag = lambda rows: Counter(tuple(r) for r in rows)


# Periodic runs


def runs_of(w):
    """Every run by definition: each start and end, smallest period by trial."""
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            stretch = w[i : j + q]
            if len(stretch) >= max(6, 4 * q) and not any(all(a == b for a, b in zip(stretch, stretch[p:])) for p in range(1, q)):
                found.append((i, len(stretch), q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected_runs(doc_id, text):
    w = WORDS.findall(text or "")
    if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = runs_of(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def periodic_texts():
    r = random.Random(3)
    rows = [(None, "a a a a a a"), (None, None), (1, ""), (2, " \n"), (3, "a " * 5), (4, "a " * 6), (5, "a b " * 4), (6, "x a b a b a b a b a y"), (6, "x a b a b a b a b a y")]
    rows += [(10 + i, " ".join(r.choice("ab") for _ in range(r.randint(1, 60)))) for i in range(120)]
    rows += [(200 + i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(20, 90)))) for i in range(120)]
    block = [r.choice("abcdefghijklmnop") for _ in range(9)]
    rows += [(400, " ".join((block * 5 + ["z"]) * 4)), (401, " ".join(["u"] * 30 + block * 4 + ["u"] * 12)), (402, "ä  ü\tä ü ä ü ä ü ä")]
    return rows


def test_periodic_runs_whole_and_by_ranges_of_lags(spark, monkeypatch):
    rows = periodic_texts()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, start string").repartition(3)
    want = bag(expected_runs(*r) for r in rows)
    assert any(k[1] > 1 for k in want) and any(k[1] == 0 for k in want)
    assert bag(periodic.periodic_runs(docs).collect()) == want
    # Every text of more than twenty bytes dealt by ranges of lags.
    assert bag(periodic.periodic_runs(docs, long_bytes=20).collect()) == want
    assert periodic.periodic_runs(docs.where("false")).count() == 0


def test_ranges_of_lags_give_the_same_runs():
    r = random.Random(8)
    w = [r.choice("abc") for _ in range(120)] * 9 + [r.choice("abc") for _ in range(300)]
    ids = periodic.numbered([x.encode() for x in w])
    whole = periodic.smallest(*periodic.scan(ids, 1, len(ids) // 4 + 1))
    parts = [periodic.scan(ids, low, min(low + 7, len(ids) // 4 + 1)) for low in range(1, len(ids) // 4 + 1, 7)]
    assert (periodic.smallest(*[np.concatenate(x) for x in zip(*parts)]) == whole).all()
    assert [tuple(x) for x in whole.tolist()] == runs_of(w)
    assert (0, 1080, 120) in runs_of(w) or any(x[2] == 120 for x in runs_of(w))


def test_long_document_is_parted_into_several_ranges(spark, monkeypatch):
    r = random.Random(2)
    part = " ".join(r.choice(["ab", "cd", "ef", "gh"]) for _ in range(400))
    text = " ".join([part] * 5)
    docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
    parts = list(periodic._ranges(iter(docs.selectExpr("7L as rid", "doc_id", "text").toArrow().to_batches())))
    assert [(b["low"][0].as_py(), b["high"][0].as_py()) for b in parts] == [(1, 501)]
    monkeypatch.setattr(periodic, "WORK", 1)
    monkeypatch.setattr(periodic, "FEWEST_LAGS", 64)
    assert len(list(periodic._ranges(iter(docs.selectExpr("7L as rid", "doc_id", "text").toArrow().to_batches())))) == 8
    assert bag(periodic.periodic_runs(docs, long_bytes=100).collect()) == bag([expected_runs(5, text)])


# Source divergence


def expected_divergence(rows, least):
    groups, langs, df = {}, {}, {}
    for lang, source, text in rows:
        lang, source, terms = lang or "", source or "", TERMS.findall(lower(text))
        groups.setdefault((lang, source), Counter()).update(terms)
        df.setdefault(lang, Counter()).update(set(terms))
    out = []
    for lang, seen in df.items():
        kept = [t for t, n in seen.items() if n >= least]
        mine = {s: c for (g, s), c in groups.items() if g == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in mine.items()}
        q = share(sum((Counter(c) for c in mine.values()), Counter()))
        for s in mine:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in mine if o != s]
            terms = [(-(p[s][t] - q[t]), t.encode(), t) for t in kept if mine[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:50])):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)]
    return bag(out)


@pytest.fixture(scope="module")
def sources():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 3))) for _ in range(150)]
    rows = [(None, None, None), ("en", "b", ""), ("en", None, "Ab ab"), ("xx", "only", "word"), ("yy", "p", "1 2"), ("yy", "q", "..."), ("en", "B", "it's a b-c 3d É\nx_y")]
    for _ in range(160):
        rows.append((r.choice(["en", "en", "de"]), r.choice(["a", "a", "b", "ü", "z"]), " ".join(r.choice(vocabulary[: r.choice([20, 150])]) for _ in range(r.randint(0, 40)))))
    return rows + rows[20:25]


@pytest.mark.parametrize("cells", [1 << 18, 8])
def test_divergence_against_brute_force(spark, sources, monkeypatch, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "FEWEST", 4 if cells == 8 else divergence.FEWEST)
    docs = spark.createDataFrame([(*r, "clash") for r in sources], "lang string, source string, text string, rank string").repartition(3)
    got = divergence.divergence(docs, 6)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert bag(got.collect()) == expected_divergence(sources, 6)
    assert divergence.divergence(docs.where("false")).count() == 0


def test_shares_are_exact_for_large_counts():
    r = random.Random(1)
    for _ in range(300):
        kept, counts = r.randint(1, 10**6), [r.randint(0, 10**13) for _ in range(5)]
        total = sum(counts) + r.randint(0, 10**14)
        got = divergence.shares(np.array(counts), np.int64(total), kept)
        assert got.tolist() == [1 + 10**9 * (c + 5) // (total + 5 * kept) for c in counts]
    assert divergence.pair_part(np.array([[1, 5], [4, 4], [0, 0]])).tolist() == [[0, 4, 6], [4, 0, 8], [6, 8, 0]]


# Language model


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


@pytest.fixture(scope="module")
def prose():
    """Two languages of their own words, rare words, and the awkward rows."""
    r = random.Random(9)
    tongues = [["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(250)] for letters in ("abcdeng", "oprstuvé")]
    pick = lambda v: v[int(len(v) * r.random() ** 3)]
    rows = [(None, "Null id"), (None, None), (900, None), (901, ""), (902, " \t"), (903, "x" * 80 + " tail"), (903, "x" * 80 + " tail"), (904, "ABC abc É é")]
    for i in range(400):
        v = r.choice(tongues)
        rows.append((i, " ".join([pick(v) for _ in range(r.randint(5, 120))] + [f"Rare{r.randint(0, 300)}"])))
    return rows


def expected_base(rows):
    c = Counter()
    for i, t in rows:
        if not held_out(i):
            c.update([*WORDS.findall(lower(t)), ""])
    total = sum(c.values())
    out = []
    for i, t in rows:
        w = [*WORDS.findall(lower(t)), ""]
        out.append((i, held_out(i), len(w), sum(x in c for x in w), total, round(sum(math.log10((c[x] + 0.5) / (total + 0.5 * (len(c) + 1))) for x in w), 6)))
    return bag(out)


@pytest.mark.parametrize("frequent", [1 << 17, 40])
def test_base_scores_and_held_out_gain(spark, prose, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    docs = spark.createDataFrame([(*r, "clash") for r in prose], "doc_id long, text string, score string").repartition(3)
    got = lm.lm_scores(docs).collect()
    assert bag((r[0], r[1], r[2], r[3], r[4], round(r["base_score"], 6)) for r in got) == expected_base(prose)
    unseen = [r for r in got if r["held_out"]]
    assert unseen and sum(r["score"] for r in unseen) > 0.97 * sum(r["base_score"] for r in unseen)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm.lm_scores(docs.where("false")).count() == 0


def test_scores_do_not_depend_on_what_travels(spark, monkeypatch):
    """Words whose counts do not travel meet them in the join; the network's own words are the same."""
    r = random.Random(6)
    tokens = [f"w{i}" for i in range(3000) for _ in range(1 + (3000 - i) // 200)]
    r.shuffle(tokens)
    rows = [(k, " ".join(tokens[a : a + 40])) for k, a in enumerate(range(0, len(tokens), 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    one = {r["doc_id"]: tuple(r) for r in lm.lm_scores(docs).collect()}
    monkeypatch.setattr(lm, "FREQUENT", 2400)
    two = {r["doc_id"]: tuple(r) for r in lm.lm_scores(docs).collect()}
    assert one.keys() == two.keys() and all(two[k][:5] == one[k][:5] and two[k][5:] == pytest.approx(one[k][5:], abs=1e-6) for k in one)


def test_probabilities_sum_to_one_after_any_context():
    r = np.random.default_rng(4)
    unigram = r.random(lm.OUTPUTS) + 0.01
    model = lm.Model.initial(unigram / unigram.sum())
    model.flat[: -4 * lm.OUTPUTS - 2] += r.normal(0, 0.2, len(model.flat) - 4 * lm.OUTPUTS - 2).astype(np.float32)
    flat, w = model.flat.tobytes(), np.arange(lm.OUTPUTS)
    for u, v in ((0, 0), (3, lm.START), (lm.START, lm.START), (7, 1900)):
        p = np.exp(lm.log_probabilities(flat, np.full(lm.OUTPUTS, u), np.full(lm.OUTPUTS, v), w))
        assert p.sum() == pytest.approx(1, abs=1e-4) and (p > 0).all()
        h = model.E1[v].astype(np.float64) + model.E2[u]
        z = model.R @ h + model.b[:, 0]
        assert p == pytest.approx(np.exp(z - z.max()) / np.exp(z - z.max()).sum(), rel=1e-3)


def test_steps_lower_the_noise_contrastive_loss_and_averages_weigh_by_tokens():
    r = np.random.default_rng(2)
    unigram = np.full(lm.OUTPUTS, 1 / lm.OUTPUTS)
    model = lm.Model.initial(unigram)
    u = r.integers(0, 50, 4096).astype(np.int32)
    v = r.integers(0, 50, 4096).astype(np.int32)
    w = ((v * 7) % 50).astype(np.int32)  # the last word decides
    before = lm.log_probabilities(model.flat.tobytes(), u, v, w).mean()
    for k in range(60):
        at = slice(1024 * (k % 4), 1024 * (k % 4) + 1024)
        model.step(u[at], v[at], w[at], r.integers(0, lm.OUTPUTS, lm.NOISE).astype(np.int32), np.log(lm.NOISE * unigram).astype(np.float32))
    assert lm.log_probabilities(model.flat.tobytes(), u, v, w).mean() > before + 2
    x, y = np.arange(4, dtype=np.float32), np.ones(4, np.float32)
    tokens, flat = lm._mean([(1, x.tobytes()), (3, y.tobytes())])
    assert tokens == 4 and np.frombuffer(flat, np.float32) == pytest.approx((x + 3 * y) / 4)


def test_tree_average(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 3)
    rows = [(n, np.full(5, n, np.float32).tobytes()) for n in range(1, 21)]
    from subtide.llm.lineage import stored

    got = np.frombuffer(lm.average(stored(spark.createDataFrame(rows, "tokens long, model binary"))), np.float32)
    assert got == pytest.approx(np.full(5, sum(n * n for n in range(1, 21)) / sum(range(1, 21))), rel=1e-5)
    assert lm.average(stored(spark.createDataFrame([], "tokens long, model binary"))) is None


# Decontamination of many equal items


def test_many_equal_items_are_one_group(spark, monkeypatch):
    from subtide.llm import decontam

    words = [f"w{i}" for i in range(20)]
    equal = spark.range(20_000).selectExpr("id AS item_id", f"'{' '.join(words)}' AS text")
    more = spark.createDataFrame([(90_001, " ".join(words[:12])), (90_002, "elsewhere only here"), (None, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(words) + " y"), (2, " ".join(words[2:13])), (3, "nothing"), (4, "Elsewhere, only here!")], "doc_id long, text string")
    for rows in (150_000, 1):
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", rows)
        got = {r["doc_id"]: r for r in decontam.decontaminate(docs, equal.unionByName(more)).collect()}
        assert got[1]["n_hit"] == 20 and len(got[1]["items"]) == 20_001 and got[1]["items"] == sorted(got[1]["items"])
        assert got[2]["n_hit"] == 11 and len(got[2]["items"]) == 20_001
        assert got[3]["items"] == [] and not got[3]["contaminated"] and got[4]["items"] == ["90002"]
    assert [decontam.bits_for(n) for n in (0, 10**5, 10**7, 10**9)] == [20, 21, 28, 28]
