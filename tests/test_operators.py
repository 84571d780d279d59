"""Operators on small fixtures: edge cases, sinks, scans and streams."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from subtide.functions import filenames as N
from subtide.functions import scripts
from subtide.functions import text as T
from subtide.operators import alignment, cleaning, coverage, crosswalk, intervals, search, upkeep
from subtide.operators.ranking import places
from subtide.sources import files, sinks, subtitles
from subtide.streaming import debounce


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_speech_spans_merge_pad_and_drop(spark):
    s = spark.createDataFrame([("a", 0.10, 0.12), ("a", 0.50, 0.70), ("a", 0.74, 0.90), ("a", 2.70, 3.30)], "k string, start double, end double")
    out = intervals.merge_spans(s, ["k"], "start", "end", lo=F.lit(0.0), hi=F.lit(3.0), gap=0.10, pad=0.05, least=0.25)
    assert [(round(r["start"], 2), round(r["end"], 2)) for r in out.orderBy("start").collect()] == [(0.45, 0.95), (2.65, 3.0)]


def test_gaps_and_cut(spark):
    s = spark.createDataFrame([("a", 4.0, 4.6, 0.0, 10.0), ("a", 5.4, 6.0, 0.0, 10.0)], "k string, start double, end double, lo double, hi double")
    g = intervals.gaps(s, ["k"], "start", "end", "lo", "hi", 0.2)
    assert [(r["start"], r["end"]) for r in g.orderBy("start").collect()] == [(0.0, 4.0), (4.6, 5.4), (6.0, 10.0)]
    t = spark.createDataFrame([("a", 5.0, 4.0, 6.0)], "k string, target double, f double, u double")
    cut = intervals.nearest_gap_cut(t, g, ["k"], "target", "f", "u").first()
    assert (cut["cut"], cut["score"], cut["fallback"]) == (5.0, 1.0, False)
    none = intervals.nearest_gap_cut(t, g.where("start < 0"), ["k"], "target", "f", "u").first()
    assert (none["cut"], none["score"], none["fallback"]) == (5.0, 0.0, True)


def test_even_sample_positions(spark):
    r = spark.range(1).select(intervals.even_sample(F.lit(9), 3).alias("p")).first()
    assert r["p"] == [0, 4, 8]


def test_shift_rejects_and_clamps(spark):
    s, e = intervals.shift(F.lit(1.0), F.lit(3.0), -2.0)
    r, _ = intervals.shift(F.lit(1.0), F.lit(3.0), -2.0, clamp=False)
    assert tuple(spark.range(1).select(s, e, r).first()) == (0.0, 1.0, None)


def test_windows_of_five_cues(spark):
    c = spark.createDataFrame([("s", i) for i in range(1, 6)], "source string, i int")
    w = cleaning.context_windows(c, "source", "i", F.col("i"), 2, 1).orderBy("window").collect()
    assert [r["active"] for r in w] == [[1, 2], [3, 4], [5]]
    assert [r["before"] for r in w] == [[], [2], [4]]
    assert [r["after"] for r in w] == [[3], [5], []]


def test_shards_of_five_rows(spark):
    c = spark.createDataFrame([("s", i, 10) for i in range(5)] + [("s", 9, 99)], "source string, i int, n int")
    got = {r["i"]: r["shard"] for r in cleaning.greedy_shards(c, "source", "i", F.col("n"), 2, 50).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 9: None}


def test_shards_stream_past_a_short_state(spark):
    """One source of many items: no array of a source grows item by item; sources, unknown and too large sizes as a loop has them."""
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, 1, 7, 20, 51, 10])) for i in range(20_000)]
    c = cleaning.greedy_shards(spark.createDataFrame(rows, "source string, i int, n int"), "source", "i", F.col("n"), 4, 50)
    assert "collect_list" not in c._jdf.queryExecution().optimizedPlan().toString()
    want, at = {}, {}
    for source, i, n in rows:
        shard, k, total = at.get(source, (0, 0, 0))
        if n is not None and n > 50:
            want[source, i] = None
            continue
        fits = n is not None and total is not None and k < 4 and total + n <= 50
        at[source] = (shard, k + 1, total + n) if fits else (shard + 1, 1, n)
        want[source, i] = at[source][0]
    assert {(x["source"], x["i"]): x["shard"] for x in c.collect()} == want


def test_decision_faults(spark):
    w = spark.createDataFrame([("w", 2, [99, 1, 1])], "w string, n int, ids array<int>")
    assert rows(cleaning.decision_faults(w, "w", "n", "ids")) == [("w", "duplicate_decision", 1), ("w", "id_mismatch", 99), ("w", "missing_decision", 2)]


def test_coverage_classes(spark):
    whole = F.sequence(F.lit(1), F.lit(24))
    cases = {"probably_complete": F.sequence(F.lit(1), F.lit(22)), "possible_gave_up": F.sequence(F.lit(1), F.lit(5)), "partial_or_alt_span": F.sequence(F.lit(10), F.lit(24)), "one_off": F.array(F.lit(3))}
    got = spark.range(1).select(*[coverage.classify(c, whole, 0.9).alias(n) for n, c in cases.items()]).first().asDict()
    assert got == {n: n for n in cases}


def test_fuzzy_ranks_matches_first(spark):
    d = spark.createDataFrame([("english subs",), ("japanese subs",)], "h string")
    assert [r["h"] for r in search.rank_fuzzy(d, "h", "japanese").collect()] == ["japanese subs", "english subs"]
    assert search.rank_fuzzy(d, "h", " ").count() == 2


def test_names(spark):
    d = spark.createDataFrame([("[Group] TITLE.S01E16.ja[cc].srt",), ("第０７話.ass",), ("1080p.srt",), ("",)], "n string")
    got = d.select(N.episode(F.col("n")).alias("e"), N.language_hint(F.col("n")).alias("l"), N.group_hint(F.col("n")).alias("g")).collect()
    assert [(r["e"]["local"], r["e"]["confidence"], r["l"], r["g"]) for r in got] == [(16, "high", "ja", "Group"), (7, "medium", "unknown", None), (None, "none", "unknown", None), (None, "none", "unknown", None)]


def test_mechanical_normalisation(spark):
    t, r = T.mechanical_normalise(F.lit("私は求められている\n王塚真唯像を➡"))
    assert tuple(spark.range(1).select(t, r).first()) == ("私は求められている王塚真唯像を", ["join_physical_lines", "strip_trailing_arrow"])


def test_mechanical_normalisation_from_the_end(spark):
    """As the pattern of old has it, without a pattern that is tried at each character."""
    r = random.Random(3)
    texts = ["", None, "➡", " →\t", "x ➡ ", "x ➡ →", "x➡y", " \t", "x \t"] + ["".join(r.choice("a \t\r\n➡→日") for _ in range(r.randint(1, 9))) for _ in range(300)]
    t, rules = T.mechanical_normalise(F.col("t"))
    d = spark.createDataFrame([(x,) for x in texts], "t string").select("t", t.alias("s"), rules.alias("r"))
    assert "regexp" not in d._jdf.queryExecution().optimizedPlan().toString()
    for row in d.collect():
        joined = None if row["t"] is None else re.sub(r"[\r\n]+", "", row["t"])
        assert row["s"] == (None if joined is None else re.sub(rf"[ \t]*[{T.ARROWS}]+[ \t]*\Z", "", joined))
        assert row["r"] == ([] if joined is None else ["join_physical_lines"] * (joined != row["t"]) + ["strip_trailing_arrow"] * (row["s"] != joined))


def test_bulk_lookup_leaves_the_bridge_where_it_lies(spark):
    """Only the requests travel: a bridge that Spark takes for small is neither broadcast nor shuffled whole."""
    bridge = spark.range(0, 1000).selectExpr("'s' AS source", "cast(id % 10 AS string) AS external_id", "if(id % 2 = 0, 'tv', null) AS media_kind", "id AS row_id")
    asked = spark.createDataFrame([(0, "s", "4", None), (1, "s", "4", "tv"), (2, "s", "5", "tv"), (3, "t", "4", None)], "pos int, source string, external_id string, media_kind string")
    found = crosswalk.lookup_bulk(bridge, asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" not in plan and "Inner, BuildLeft" in plan
    got = {x["pos"]: (x["count"], x["results"]) for x in found.collect()}
    fours = list(range(4, 1000, 10))
    assert got == {0: (100, fours), 1: (100, fours), 2: (0, []), 3: (0, [])}


def test_language_buckets(spark):
    d = spark.createDataFrame([("これは日本語の字幕です\nとても長い行ですよね\nはいそうです",), ("This is a line of text\nAnd here is one more",), ("short",), (None,)], "t string")
    got = [r["b"] for r in scripts.metrics(d, "t").select(scripts.bucket().alias("b")).collect()]
    assert got == ["japanese", "non_japanese", "insufficient_text", "insufficient_text"]


def test_srt_oddities(spark):
    doc = "﻿1\r\n00:00:01,250 --> 00:00:03.500 position:50%\r\nhello\r\nthere\r\n\r\n00:00:05,000 --> 00:00:06,125\r\nbye\r\n\r\nnot a cue\r\n"
    d = spark.createDataFrame([("k", doc)], "k string, t string")
    got = [(r["index"], r["start_s"], r["end_s"], r["text"], r["settings"], r["malformed"]) for r in subtitles.parse_srt(d, "k", "t").orderBy("position").collect()]
    assert got[0] == (1, 1.25, 3.5, "hello\nthere", "position:50%", False)
    assert got[1] == (2, 5.0, 6.125, "bye", None, False)
    assert got[2][-1] is True
    assert spark.range(1).select(T.srt_time(F.lit(3723.045))).first()[0] == "01:02:03,045"


def test_file_scans(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 5}, {"x": 6}]')
    assert rows(files.read_json_array(spark, str(tmp_path / "a.json"), "struct<x:int>")) == [(1, 5), (2, 6)]
    (tmp_path / "b.json").write_text('{"x": 5}')
    with pytest.raises(Exception):
        files.read_json_array(spark, str(tmp_path / "b.json"), "struct<x:int>").collect()
    (tmp_path / "c.jsonl").write_text('{"x": 1}\n\nnope\n[2]\n{"x": 3}\n')
    good, bad = files.read_jsonl_split(spark, str(tmp_path / "c.jsonl"), "x int")
    assert [r["x"] for r in good.collect()] == [1, 3] and {r["line"] for r in bad.collect()} == {"nope", "[2]"}
    (tmp_path / "ids.txt").write_text("7 # seven\n\n# none\n8\n7\n")
    assert [r["id"] for r in files.read_id_list(spark, str(tmp_path / "ids.txt")).orderBy("position").collect()] == ["7", "8"]
    (tmp_path / ".dot.json").write_text("{}")
    assert files.read_texts(spark, [str(tmp_path / ".dot.json")]).first()["value"] == "{}"
    (tmp_path / "t.csv").write_text('id,name\n1,"a\nb"\n,x\n')
    assert rows(files.read_csv(spark, str(tmp_path / "t.csv"), "id string, name string")) == [("1", "a\nb")]


def test_publish_keeps_the_old_version_on_failure(spark, tmp_path):
    base = str(tmp_path / "pub")
    sinks.publish(spark.range(3), base, {"some": "count(*) > 0"})
    with pytest.raises(ValueError):
        sinks.publish(spark.range(0), base, {"some": "count(*) > 0"})
    assert sinks.current(spark, base).count() == 3
    sinks.write_jsonl(spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b"), str(tmp_path / "out"))
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))


def test_upsert_and_patch(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None)], "k int, v string")
    assert rows(upkeep.upsert(a, b, ["k"])) == [(1, "x"), (2, "z"), (3, None)]
    assert rows(upkeep.patch(a, b, ["k"], "v")) == [(1, "x"), (2, "z")]
    assert rows(upkeep.upsert(a, b.limit(0), ["k"])) == [(1, "x"), (2, "y")]


def test_streaming_debounce(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    events = [("p", t), ("p", t + dt.timedelta(seconds=2)), ("p", t + dt.timedelta(seconds=60)), ("q", t + dt.timedelta(seconds=900))]
    spark.createDataFrame(events, "path string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, ts timestamp").parquet(str(tmp_path / "in"))
    q = debounce.debounced(stream, "path", "ts", "5 seconds", "1 minute").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("bursts").where("path = 'p'").collect()) == [1, 2]


def test_visible_lines_and_backends(spark):
    from subtide.functions import unicode as U

    d = spark.createDataFrame([("<i>ＡＢ &amp; c</i>\n\n  x\ty ",), (None,)], "t string")
    assert [r["l"] for r in d.select(U.visible_lines("t").alias("l")).collect()] == [["AB & c", "x y"], []]
    U.register_backend("detector", "fixed", lambda name: U.line_detector(lambda s: s.map(lambda _: name)))
    assert d.select(U.backend("detector", "fixed", name="ja")("t").alias("n")).first()["n"] == "ja"
    with pytest.raises(KeyError):
        U.backend("detector", "none")


def test_greedy_offsets_move_on(spark):
    greedy_offsets = alignment.greedy_offsets

    d = spark.createDataFrame([("ab ab c", ["ab", "zz", "ab", "c"])], "t string, w array<string>")
    assert [tuple(x) for x in d.select(greedy_offsets(F.col("t"), F.col("w")).alias("o")).first()["o"]] == [("ab", 0), ("zz", None), ("ab", 3), ("c", 6)]


def test_projection_rejects_unknown_and_reserved(spark):
    from subtide.operators.records import project

    d = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        project(d, ["a", "c"])
    with pytest.raises(ValueError):
        project(d, ["a", "b"], reserved=["b"])


def test_speech_gap_and_overlap_nulls(spark):
    c = spark.createDataFrame([("a", 0, 0.0, 1.0)], "k string, cell int, start double, end double")
    s = spark.createDataFrame([], "k string, i int, start double, end double")
    r = intervals.max_overlap(c, s, ["k"], "i").first()
    assert r["i"] is None and r["overlap"] is None


def test_path_events_and_first_seen(spark):
    e = spark.createDataFrame([("a/.media.json", "b/.media.json", 1), (None, "x/y/.media.json", 2)], "src string, dst string, n int")
    got = debounce.path_events(e, "src", "dst", r"^[^/]+/\.media\.json$")
    assert rows(got) == [("a/.media.json", 1), ("b/.media.json", 1)]


def test_hidden_files_are_read_in_tasks(spark, tmp_path):
    from subtide.sources import files

    for name, text in ((".info.json", '{"a": 1}\n'), ("plain.txt", "x\ny")):
        (tmp_path / name).write_text(text)
    got = {r["path"].rsplit("/", 1)[-1]: r["value"] for r in files.read_texts(spark, [f"{tmp_path}/.info.json", f"{tmp_path}/plain.txt"]).collect()}
    assert got == {".info.json": '{"a": 1}\n', "plain.txt": "x\ny"} and files.read_texts(spark, []).count() == 0


def test_pointer_is_replaced_in_one_step(spark, tmp_path):
    from subtide.sources import sinks

    base = str(tmp_path / "index")
    for n in (3, 5):
        sinks.publish(spark.range(n).toDF("id"), base)
        assert sinks.current(spark, base).count() == n


def test_places_are_those_of_one_sorted_list(spark):
    rows = [(k, b, i) for i, (k, b) in enumerate([("x", 2), ("x", None), ("y", 1), ("x", 1), (None, 5), ("x", 2), (None, None), ("y", 1), ("x", 1)])]
    df = spark.createDataFrame(rows, "k string, b int, i int")
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    whole = {r[2]: n for n, r in enumerate(sorted(rows, key=order), 1)}
    assert {r["i"]: r["place"] for r in places(df, [F.col("b")], ["i"]).collect()} == whole
    for k in ("x", "y", None):
        want = {r[2]: n for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=order), 1)}
        got = places(df, [F.col("b")], ["i"], ("k",)).where(F.col("k").eqNullSafe(k))
        assert {r["i"]: r["place"] for r in got.collect()} == want
    assert places(df.limit(0), [F.col("b")], ["i"]).count() == 0
