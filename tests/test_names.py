"""File names against expectations written by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from subtide.functions import filenames as N
from subtide.functions import release_names as R

#: name, title, season, episodes, fractions, special
GRAMMAR = [
    ("[Group] Show Title - 05 [1080p].mkv", "Show Title", None, [5], [], None),
    ("Show.S01E01-E03.srt", "Show", 1, [1, 2, 3], [], None),
    ("Show S01E01-S01E03.srt", "Show", 1, [1, 2, 3], [], None),
    ("Show S01E01E02.srt", "Show", 1, [1, 2], [], None),
    ("Show S02E07v2.ass", "Show", 2, [7], [], None),
    ("Show - 01+02 [BD].ass", "Show", None, [1, 2], [], None),
    ("Show 1 & 2.ass", "Show", None, [1, 2], [], None),
    ("Show - 03,05,07.ass", "Show", None, [3, 5, 7], [], None),
    ("[G] Show - 12 ~ 14.ass", "Show", None, [12, 13, 14], [], None),
    ("Show 01-12 batch.ass", "Show", None, list(range(1, 13)), [], None),
    ("Show 05.5.srt", "Show", None, [], ["5.5"], None),
    ("Show S01E02.5.srt", "Show", 1, [], ["2.5"], None),
    ("[X] Show [01][720p].mkv", "Show", None, [1], [], None),
    ("[X] Show [01-03][720p].mkv", "Show", None, [1, 2, 3], [], None),
    ("Show 第12話.srt", "Show", None, [12], [], None),
    ("ガンダム００ 第０５話.srt", "ガンダム００", None, [5], [], None),
    ("SHOW 12話.ass", "SHOW", None, [12], [], None),
    ("Show 2nd Season - 03.mkv", "Show", 2, [3], [], None),
    ("Show Season 3 Episode 9.srt", "Show", 3, [9], [], None),
    ("Show 1x02.mkv", "Show", 1, [2], [], None),
    ("Show ep.07.srt", "Show", None, [7], [], None),
    ("Show #4.srt", "Show", None, [4], [], None),
    ("Show - OVA 2.mkv", "Show", None, [], [], "OVA 2"),
    ("Show NCOP1.mkv", "Show", None, [], [], "NCOP 1"),
    ("86 - 03.mkv", "86", None, [3], [], None),
    ("Show - 003 - The 100.mkv", "Show", None, [3], [], None),
    ("20th Century Boys 04.srt", "20th Century Boys", None, [4], [], None),
    ("Steins;Gate 0 - 23.ass", "Steins;Gate 0", None, [23], [], None),
    ("Show 2012 1080p.mkv", "Show", None, [], [], None),
    ("Show_-_07_(1280x720).ass", "Show", None, [7], [], None),
    ("Show - 05 (10bit).mkv", "Show", None, [5], [], None),
    ("Name x264 BD.srt", "Name", None, [], [], None),
    ("Show S2.srt", "Show", 2, [], [], None),
    ("folder.x/S01E001.m4a", None, 1, [1], [], None),
    ("07.srt", None, None, [7], [], None),
    ("", None, None, [], [], None),
]


@pytest.mark.parametrize(("name", "title", "season", "episodes", "fractions", "special"), GRAMMAR)
def test_grammar(name, title, season, episodes, fractions, special):
    p = R.parse(name)
    assert (p.title, p.season, p.episodes, p.fractions, p.special) == (title, season, episodes, fractions, special)


def test_grammar_in_spark(spark):
    d = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GRAMMAR)] + [(99, None)], "i int, n string")
    got = {r["i"]: r for r in d.select("i", R.parsed_name(F.col("n")).alias("p"), R.episode_numbers(F.col("n")).alias("e"), R.ordinary_episode(F.col("n")).alias("o")).collect()}
    for i, (_, title, season, episodes, fractions, special) in enumerate(GRAMMAR):
        p = got[i]["p"]
        assert (p["title"], p["season"], p["episodes"], p["fractions"], p["special"], got[i]["e"]) == (title, season, episodes, fractions, special, episodes)
        assert got[i]["o"] == (episodes[0] if len(episodes) == 1 and not fractions and special is None and "batch" not in GRAMMAR[i][0] else None)
    assert got[99]["p"]["title"] is None and got[99]["e"] == [] and got[99]["o"] is None


def test_long_and_odd_names():
    assert R.parse("Show 1-99999.srt").episodes == [] and R.parse("Show - 3-1900.srt").episodes == [3] and len(R.parse("Show - 1-1899.srt").episodes) == 1899
    assert R.parse("Show - 1500-1.srt").episodes == [1500]
    assert R.parse("[" * 500 + "-" * 500).episodes == []
    assert R.parse("Show S01E" + "1" * 400).episodes == []


#: name, local, raw, confidence
EPISODES = [
    ("Show S01E02.srt", 2, "S01E02", "high"), ("show.s1e0123.srt", 123, "s1e0123", "high"), ("Show_S01E02.srt", None, None, "none"), ("xS01E02 7.srt", 7, "7", "medium"),
    ("Show S01E02b ep 4.srt", 4, "ep 4", "medium"), ("Show Ｓ０１E０２.srt", None, None, "none"), ("Show S０１E０２.srt", 2, "S０１E０２", "high"), ("Show Episode - 12.srt", 12, "Episode - 12", "medium"),
    ("Show ep.._3.srt", 3, "3", "medium"), ("Show episodes 12.srt", 12, "12", "medium"), ("Show eps.12345.srt", 1234, "eps.1234", "medium"), ("番組 第7話.srt", 7, "第7", "medium"),
    ("Show 300.srt", 300, "300", "low"), ("Show 1080 2012 44.srt", 44, "44", "medium"), ("Show x264 12v2.srt", None, None, "none"), ("Show 720 1999 1501.srt", None, None, "none"), ("", None, None, "none"),
]


def test_episode_tokens(spark):
    d = spark.createDataFrame([(i, e[0]) for i, e in enumerate(EPISODES)], "i int, n string")
    got = {r["i"]: tuple(r["e"]) for r in d.select("i", N.episode(F.col("n")).alias("e")).collect()}
    assert [got[i] for i in range(len(EPISODES))] == [e[1:] for e in EPISODES]


def test_tags_groups_and_languages(spark):
    cases = [
        ("[A  b] x [C][] [d[e] f].srt", ["A  b", "C", "d[e"], "A b", "unknown"), ("x.ja.srt", [], None, "ja"), ("x.pt-BR[cc].ass", ["cc"], None, "pt-br"), ("x.jap1.srt", [], None, "unknown"),
        ("[JPN] x.mkv", ["JPN"], "JPN", "jpn"), ("x [a ja b].ass", ["a ja b"], None, "ja"), ("x [CHT].ass", ["CHT"], None, "zh"), ("x [Eng subs][jp].ass", ["Eng subs", "jp"], None, "en"),
        ("[ ] x.en.mkv", [" "], None, "unknown"), ("[open.srt", [], None, "unknown"), ("srt", [], None, "unknown"), ("x [ja_1].ssa", ["ja_1"], None, "unknown"),
    ]
    d = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, n string")
    n = F.col("n")
    got = {r["i"]: (r["t"], r["g"], r["l"]) for r in d.select("i", N.tags(n).alias("t"), N.group_hint(n).alias("g"), N.language_hint(n).alias("l")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1:] for c in cases]


def test_names_are_dealt_to_all_cores(spark, sf_dir):
    """A table of parts is one file of few bytes, yet its names are read by as many tasks as there are cores, or more."""
    from subtide.plans import parsing, reach

    for names in (parsing.names(spark, sf_dir), reach.names(spark, sf_dir)):
        assert names.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
