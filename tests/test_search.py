"""Search over many queries and small record operators, against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from subtide.operators import ranking, records, search, upkeep


def brute_bm25(texts, queries, k=1.2, b=0.75):
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in texts}
    average = sum(map(len, words.values())) / len(words)
    out = {}
    for q, terms in queries.items():
        for i, w in words.items():
            n = Counter(w)
            score = 0.0
            for t in {t.lower() for t in terms if t is not None}:
                df = sum(t in v for v in words.values())
                score += math.log((len(words) - df + 0.5) / (df + 0.5) + 1) * n[t] * (k + 1) / (n[t] + k * (1 - b + b * len(w) / average))
            if any(n[t.lower()] for t in terms if t is not None):
                out[q, i] = score
    return out


@pytest.mark.parametrize("most_bytes", [8 << 20, 0])
def test_bulk_scores_with_terms_that_travel_or_are_joined(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(search, "MOST_BYTES", most_bytes)
    r = random.Random(3)
    vocabulary = ["ab", "Cd", "été", "x9", "the", "42"]
    texts = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 30)))) for i in range(60)] + [(60, None), (61, ""), (62, " .,! ")]
    queries = {"a": ["AB", "ab", "nowhere"], "b": ["ÉTÉ", "the", None], "c": ["missing"]}
    docs = spark.createDataFrame(texts, "id int, text string").repartition(3)
    wanted = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query_id string, term string")
    want = brute_bm25(texts, queries)
    for index in (search.postings(docs, "id", F.col("text"), wanted), search.postings(docs, "id", F.col("text"))):
        got = {(x["query_id"], x["id"]): x["score"] for x in search.bm25_bulk(index, docs, "id", F.col("text"), wanted).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = {x["term"] for x in search.postings(docs, "id", F.col("text"), wanted).select("term").collect()}
    assert kept == {"ab", "été", "the"}


def test_no_terms_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "id int, text string")
    none = spark.createDataFrame([], "query_id string, term string")
    assert search.postings(docs, "id", F.col("text"), none).count() == 0
    some = spark.createDataFrame([("q", "a")], "query_id string, term string")
    empty = docs.limit(0)
    assert search.bm25_bulk(search.postings(empty, "id", F.col("text"), some), empty, "id", F.col("text"), some).count() == 0


def test_single_query_equals_bulk(spark):
    texts = [(1, "red red fox"), (2, "Fox"), (3, None), (4, "blue")]
    docs = spark.createDataFrame(texts, "id int, text string")
    got = {x["id"]: x["score"] for x in search.bm25(docs, "id", F.col("text"), ["red", "FOX"]).collect()}
    want = {i: s for (_, i), s in brute_bm25(texts, {"q": ["red", "fox"]}).items()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_ranks_and_repeats(spark):
    rows = spark.createDataFrame([("u", 1, "a"), ("u", 2, None), ("u", 3, "a"), ("u", 4, None), ("v", 5, "a"), (None, 6, "a")], "k string, o int, x string")
    got = {r["o"]: (r["position"], r["duplicate"]) for r in ranking.repeats(rows, ["k"], "x", "o").collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (3, True), 4: (4, True), 5: (1, False), 6: (1, False)}
    got = {r["o"]: r["score"] for r in ranking.reciprocal_rank(rows, ["k"], [F.desc("o")]).collect()}
    assert got == {4: 1.0, 3: 0.5, 2: round(1 / 3, 9), 1: 0.25, 5: 1.0, 6: 1.0}


def test_batches_and_running_counts(spark):
    rows = spark.createDataFrame([("a", i, i // 2) for i in range(7)] + [("b", 0, 9)], "k string, o int, day int")
    got = Counter((r["k"], r["batch"]) for r in upkeep.insert_batches(rows, ["k"], ["o"], 3).collect())
    assert got == {("a", 0): 3, ("a", 1): 3, ("a", 2): 1, ("b", 0): 1}
    with pytest.raises(ValueError):
        upkeep.insert_batches(rows, ["k"], ["o"], 0)
    got = {(r["k"], r["day"]): r["total"] for r in upkeep.running_counts(rows, ["k"], "day").collect()}
    assert got == {("a", 0): 2, ("a", 1): 4, ("a", 2): 6, ("a", 3): 7, ("b", 9): 1}


def test_record_columns(spark):
    one = spark.createDataFrame([(1, ["z", "a", "z", "b"]), (2, None)], "id int, asked array<string>")
    known, reserved = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))
    got = {r["id"]: (r["f"]["unknown"], r["f"]["forbidden"]) for r in one.select("id", records.field_faults(F.col("asked"), known, reserved).alias("f")).collect()}
    assert got == {1: (["z"], ["b"]), 2: ([], [])}
    row = one.select(*records.insert_row({"id": F.col("id")}, {"asked": F.col("asked")}, {"n": F.lit(None).cast("int")})).collect()
    assert [tuple(r) for r in row] == [(1, '["z","a","z","b"]', 0), (2, "[]", 0)]
    shards = spark.createDataFrame([("s2", 3), ("s1", 4)], "shard string, n long")
    assert tuple(records.run_manifest(shards, "m", "shard", "n").first()) == ("m", 2, 7, "s1=4,s2=3")
    cues = spark.createDataFrame([(1, "t"), (2, None), (3, "x")], "id int, text string")
    decided = spark.createDataFrame([(1, "edit"), (2, "remove")], "id int, decision string")
    got = {r["id"]: r["payload"] for r in records.review_payloads(cues, decided, "id", "text").collect()}
    assert got == {1: '{"index":1,"text":"t","decision":"edit"}', 2: '{"index":2,"decision":"remove"}'}
