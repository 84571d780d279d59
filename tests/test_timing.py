"""Lag search, occupancy, fits and range joins against brute force."""

from __future__ import annotations

import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from subtide.operators import intervals, ranges, timing


def spread(r, n, top, most):
    return [(s, s + r.randint(0, most)) for s in (r.randrange(top) for _ in range(n))]


def bins(spans, step):
    return {b for s, e in spans if e > s for b in range(s // step, (e - 1) // step + 1)}


def test_overlap_join_finds_each_pair_once(spark):
    r = random.Random(1)
    left = [(r.choice("ab"), i, *x) for i, x in enumerate(spread(r, 60, 500, 30) + [(0, 5000), (-40, -10), (7, 7)])]
    right = [(r.choice("abc"), i, *x) for i, x in enumerate(spread(r, 60, 500, 9) + [(-5, 900), (30, 30)])]
    a = spark.createDataFrame(left, "k string, i int, s long, e long")
    b = spark.createDataFrame(right, "k string, j int, t long, u long")
    got = sorted((x["i"], x["j"]) for x in ranges.overlap_join(a, b, ["k"], ("s", "e"), ("t", "u")).collect())
    assert got == sorted((i, j) for k, i, s, e in left for m, j, t, u in right if k == m and s < u and t < e and s < e and t < u)
    near = sorted((x["i"], x["j"]) for x in ranges.near_join(a, b, ["k"], "s", "t", 17).collect())
    assert near == sorted((i, j) for k, i, s, _ in left for m, j, t, _ in right if k == m and abs(s - t) <= 17)


@pytest.mark.parametrize("seed", range(3))
def test_lag_curve_equals_counted_bins(spark, seed):
    r, step, most = random.Random(seed), 20, 90
    speech, cues = spread(r, 25, 4000, 300), {c: spread(r, r.randint(1, 12), 4000, 260) for c in "xyz"}
    s = spark.createDataFrame([("t", *x) for x in speech], "track string, start long, end long")
    c = spark.createDataFrame([("t", k, *x) for k, v in cues.items() for x in v] + [("alone", "x", 5, 90)], "track string, file string, start long, end long")
    on, off = timing.on_grid(s, ["track"], step), timing.on_grid(c, ["track", "file"], step)
    spoken = bins(speech, step)
    count = {k: {lag: len({b + lag for b in bins(v, step)} & spoken) for lag in range(-most, most + 1)} for k, v in cues.items()}
    for row in timing.overlap_by_lag(on, off, ["track"], ["file"], most).where("track = 't'").collect():
        end = row["next_lag"] if row["next_lag"] is not None else row["lag"]
        for lag in range(row["lag"], end + 1):
            assert count[row["file"]][lag] == row["matched"] + row["slope"] * (lag - row["lag"])
    for row in timing.best_lags(on, off, ["track"], ["file"], most, 7).collect():
        if row["track"] == "alone":
            assert (row["lag"], row["matched"], row["speech_unmatched"]) == (None, 0, 0)
            continue
        f = count[row["file"]]
        best = min(f, key=lambda lag: (-f[lag], abs(lag), lag))
        if f[best]:
            assert (row["lag"], row["matched"]) == (best, f[best])
            assert row["second"] == max(v for lag, v in f.items() if abs(lag - best) >= 7)
            assert row["cues_unmatched"] == len(bins(cues[row["file"]], step)) - f[best] and row["speech_unmatched"] == len(spoken) - f[best]


def test_work_does_not_follow_the_resolution(spark):
    """Two minutes at 20 ms are 12,001 lags; the curve has a row per meeting of edges."""
    r = random.Random(4)
    starts = sorted(r.sample(range(0, 1_400_000, 1000), 60))
    speech = spark.createDataFrame([("t", s, s + r.randint(300, 900)) for s in starts], "track string, start long, end long")
    cues = speech.select("track", F.lit("f").alias("file"), (F.col("start") - 83_460).alias("start"), (F.col("end") - 83_460).alias("end"))
    for step, most in ((20, 6000), (1, 120_000)):
        on, off = timing.on_grid(speech, ["track"], step), timing.on_grid(cues, ["track", "file"], step)
        assert timing.overlap_by_lag(on, off, ["track"], ["file"], most).count() < 4 * 60 * 60
        best = timing.best_lags(on, off, ["track"], ["file"], most, 1000 // step).first()
        assert best["lag"] == 83_460 // step and best["cues_unmatched"] == 0 and best["second"] < best["matched"]


def test_verdicts(spark):
    r = random.Random(3)
    at = sorted(r.sample(range(0, 20_000, 4), 1500))
    speech = spark.createDataFrame([("a", b, b + r.randint(1, 4)) for b in at], "track string, start long, end long")
    moved = lambda name, by: speech.select("track", F.lit(name).alias("file"), (F.col("start") - by).alias("start"), (F.col("end") - by).alias("end"))
    cues = moved("same", F.lit(0)).unionByName(moved("shifted", F.lit(30))).unionByName(moved("drifting", F.floor(F.col("start") / 500)))
    cues = cues.unionByName(spark.createDataFrame([("b", "alone", 1, 2), ("a", "far", 90_000, 90_004)], "track string, file string, start long, end long"))
    on, off = timing.on_grid(speech, ["track"], 1), timing.on_grid(cues, ["track", "file"], 1)
    fits = {x["file"]: x["verdict"] for x in timing.local_fit(on, off, ["track"], ["file"], 60, 2000, 1.0).collect()}
    assert fits == {"same": "good_match", "shifted": "constant_offset", "drifting": "possible_drift", "alone": "bad_candidate", "far": "bad_candidate"}


def test_local_fit_shuffles_spans_only(spark):
    """Speech and cues once to merge them, once by window, and one row a window for the fit: no edge, pair or lag."""
    spans = spark.range(50).select((F.col("id") % 2).alias("track"), (F.col("id") % 3).alias("file"), (F.col("id") * 7).alias("start"), (F.col("id") * 7 + 3).alias("end"))
    on, off = timing.on_grid(spans.drop("file"), ["track"], 1), timing.on_grid(spans, ["track", "file"], 1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = timing.local_fit(on, off, ["track"], ["file"], 60, 200, 1.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 5


def test_occupancy_against_every_instant(spark):
    r, layers = random.Random(6), ["vad", "srt", "ass"]
    rows = [(r.choice("pq"), r.choice([*layers, "other"]), *x) for x in spread(r, 50, 200, 25)] + [("p", "vad", 30, 30), ("p", "vad", 900, 910), ("p", "vad", 910, 920)]
    got = timing.occupancy(spark.createDataFrame(rows, "k string, layer string, start long, end long"), ["k"], "layer", layers).collect()
    want = []
    for k in "pq":
        masks = [sum(1 << i for i, n in enumerate(layers) if any(a == k and b == n and s <= t < e for a, b, s, e in rows)) for t in range(-1, 1000)]
        t = 0
        while t < len(masks):
            u = t
            while u < len(masks) and masks[u] == masks[t]:
                u += 1
            if masks[t]:
                want.append((k, t - 1, u - 1, masks[t]))
            t = u
    assert sorted(map(tuple, got)) == sorted(want)


def test_robust_line_and_grades(spark):
    r = random.Random(5)
    rows = []
    for track, slope, shift in (("good", 1.0, 20), ("late", 1.0, 2500), ("slow", 1.004, 0)):
        for i in range(120):
            x = i * 3000 + r.randint(0, 900)
            wild = i % 9 == 4
            rows.append((track, i, x, round(x * slope + shift + r.randint(-30, 30) + (r.choice([-8000, 9000]) if wild else 0))))
    rows += [("poor", i, i * 1000, None if i % 2 else i * 1000) for i in range(20)] + [("none", i, i, None) for i in range(3)] + [("one", 0, 50, 60), ("ties", 0, 5, 5), ("ties", 1, 5, 9)]
    points = spark.createDataFrame(rows, "track string, i int, x long, y long")
    got = {g["track"]: g for g in timing.timing_grade(points, ["track"], "x", "y", least=200, offset=500, drift=400).collect()}
    assert {k: g["grade"] for k, g in got.items()} == {"good": "good", "late": "offset", "slow": "drift", "poor": "poor", "none": "unaligned", "one": "good", "ties": "good"}
    assert got["slow"]["slope"] == pytest.approx(1.004, abs=2e-4) and got["late"]["offset"] == pytest.approx(2500, abs=40) and got["one"]["slope"] == 1
    line = timing.robust_line(points, ["track"], "x", "y")
    flagged = {(s["track"], s["i"]) for s in timing.suspicious_cues(points, line, ["track"], "x", "y", 200).collect()}
    assert flagged == {(t, i) for t in ("good", "late", "slow") for i in range(120) if i % 9 == 4}
    own = [(x, y) for t, _, x, y in rows if t == "late"]
    all_pairs = statistics.median((b[1] - a[1]) / (b[0] - a[0]) for k, a in enumerate(own) for b in own[k + 1 :])
    assert got["late"]["slope"] == pytest.approx(all_pairs, abs=1e-3)


def test_asof_overlap_and_cuts_of_one_large_key(spark):
    """200,000 rows of one key each: linear or by cells, none by pairs."""
    n = 200_000
    spans = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("i"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 7 + F.col("id") % 9).alias("end"))
    points = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 10 + 3).alias("at"))
    began = time.perf_counter()
    asof = intervals.asof_first_end(points, spans, ["k"], "at", "end", "i")
    assert asof.agg(F.sum((F.col("i") * 10 + 3 - F.col("at")).cast("long")), F.count("i")).first()[1] == n
    assert time.perf_counter() - began < 20
    began = time.perf_counter()
    cells = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 10).alias("end"))
    best = intervals.max_overlap(cells, spans, ["k"], "i")
    assert best.where("overlap >= 7").count() == n
    assert time.perf_counter() - began < 20
    began = time.perf_counter()
    targets = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 10 + 5).cast("double").alias("t"), (F.col("id") * 10 - 15).cast("double").alias("f"), (F.col("id") * 10 + 25).cast("double").alias("u"))
    cuts = intervals.nearest_gap_cut(targets, spans.select("k", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")), ["k"], "t", "f", "u")
    assert cuts.where("fallback").count() == 0
    assert time.perf_counter() - began < 20


def test_asof_against_brute_force(spark):
    r = random.Random(7)
    spans = [("a", r.randrange(40), i) for i in range(30)] + [("b", 3, 0)]
    points = [(r.choice("ab"), r.randrange(45), i) for i in range(80)]
    got = intervals.asof_first_end(
        spark.createDataFrame(points, "k string, at int, p int"), spark.createDataFrame(spans, "k string, end int, i int"), ["k"], "at", "end", "i"
    ).collect()
    for row in got:
        own = [(e, i) for k, e, i in spans if k == row["k"]]
        after = [x for x in own if x[0] >= row["at"]]
        assert row["i"] == (min(after) if after else max(own))[1]
    assert len(got) == 80


def test_linear_folds(spark):
    from subtide.operators.alignment import greedy_offsets

    words = [f"w{i}é" for i in range(8000)]
    d = spark.createDataFrame([(" ".join(words), words)], "t string, w array<string>")
    began = time.perf_counter()
    got = d.select(greedy_offsets(F.col("t"), F.col("w")).alias("o")).first()["o"]
    assert time.perf_counter() - began < 10
    at = 0
    for w, row in zip(words, got, strict=True):
        assert (row["word"], row["start"]) == (w, at)
        at += len(w) + 1
    t = intervals.split_targets(spark.createDataFrame([("a", 0.1, 3000.0)], "k string, lo double, hi double"), ["k"], "lo", "hi", 0.1, 1.0)
    sums, x = [], 0.1
    while True:
        x += 0.1
        if x >= 3000.0:
            break
        sums.append(x)
    assert [r["target"] for r in t.orderBy("index").collect()] == sums


def test_span_without_length_meets_a_cell_by_zero(spark):
    """As in the SQL of e19: a point inside a cell is an overlap of 0, at its edge or outside it is none; a longer one wins."""
    cells = spark.createDataFrame([(1, 0, 10), (2, 0, 10), (3, 0, 10), (4, 0, 10)], "k long, start long, end long")
    spans = spark.createDataFrame([(1, 5, 5, 7), (2, 0, 0, 8), (2, 10, 10, 9), (3, 4, 4, 1), (3, 9, 12, 2), (4, 6, 3, 5)], "k long, start long, end long, i long")
    got = {r["k"]: (r["i"], r["overlap"]) for r in intervals.max_overlap(cells, spans, ["k"], "i").collect()}
    assert got == {1: (7, 0), 2: (None, None), 3: (2, 1), 4: (5, -3)}
