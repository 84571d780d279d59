"""Parsing queries: file names and subtitle documents are made by rule from the tables, so the oracle knows the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.functions import filenames as N
from subtide.functions.text import ass_to_text
from subtide.operators.cleaning import srt_documents
from subtide.plans.registry import query
from subtide.session import dealt, table
from subtide.sources import subtitles as S


def names(spark: SparkSession, sf: str) -> DataFrame:
    """One file name a part, in eight styles."""
    k, e = F.col("p_partkey"), (F.col("p_partkey") % 120 + 1)
    style = k % 8
    two, n = F.format_string("%02d", e), e.cast("string")
    name = (
        F.when(style == 0, F.concat(F.lit("[Group  "), k.cast("string"), F.lit("] Name.S01E"), two, F.lit(".ja[cc].srt")))
        .when(style == 1, F.concat(F.lit("Name Episode "), n, F.lit(" 1080p [JPN].ass")))
        .when(style == 2, F.concat(F.lit("[X] Name - "), two, F.lit(" [720][Eng subs].srt")))
        .when(style == 3, F.concat(F.lit("Name 1080 2012 "), n, F.lit(".en.srt")))
        .when(style == 4, F.lit("Name x264 BD.srt")).when(style == 5, F.concat(F.lit("Name "), (e + 300).cast("string"), F.lit(" [CHS].ssa")))
        .when(style == 6, F.concat(F.lit("[ ] Name S2E"), n, F.lit(" [jp].ass"))).otherwise(F.lit("2048.ass"))
    )
    return dealt(table(spark, sf, "part").select("p_partkey"), "p_partkey").select("p_partkey", name.alias("name"))


_N = "n AS (SELECT p_partkey, p_partkey % 8 AS style, p_partkey % 120 + 1 AS e FROM part)"


@query(
    "j07_episode_parser",
    f"""WITH {_N} SELECT p_partkey, (CASE WHEN style IN (0, 1, 2, 6) THEN e WHEN style = 3 THEN CASE WHEN e IN (264, 265) THEN NULL ELSE e END WHEN style = 5 THEN e + 300 END)::INT AS local,
        CASE style WHEN 0 THEN 'high' WHEN 6 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'medium' WHEN 3 THEN 'medium' WHEN 5 THEN 'low' ELSE 'none' END AS confidence FROM n""",
)
def episodes(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select("p_partkey", N.episode(F.col("name")).alias("e")).select("p_partkey", "e.local", "e.confidence")


@query("j09_group_hint", f"WITH {_N} SELECT p_partkey, CASE style WHEN 0 THEN 'Group ' || p_partkey WHEN 2 THEN 'X' END AS grp FROM n")
def groups(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select("p_partkey", N.group_hint(F.col("name")).alias("grp"))


@query("j10_language_hint", f"WITH {_N} SELECT p_partkey, CASE style WHEN 0 THEN 'ja' WHEN 1 THEN 'jpn' WHEN 2 THEN 'en' WHEN 3 THEN 'en' WHEN 5 THEN 'zh' WHEN 6 THEN 'ja' ELSE 'unknown' END AS lang FROM n")
def languages(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select("p_partkey", N.language_hint(F.col("name")).alias("lang"))


@query("j11_bracket_tags", f"WITH {_N} SELECT p_partkey, CASE style WHEN 0 THEN 'Group  ' || p_partkey || '|cc' WHEN 1 THEN 'JPN' WHEN 2 THEN 'X|720|Eng subs' WHEN 5 THEN 'CHS' WHEN 6 THEN ' |jp' ELSE '' END AS tags FROM n")
def tags(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select("p_partkey", F.array_join(N.tags(F.col("name")), "|").alias("tags"))


@query("j14_trailing_episode", "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN (p_partkey % 120)::INT END AS number FROM part")
def trailing(spark: SparkSession, sf: str) -> DataFrame:
    n = F.format_string("%02d", F.col("p_partkey") % 120)
    t = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Title - "), n)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Title - "), n, F.lit("v2"))).otherwise(F.concat(F.lit("Title-"), n))
    return table(spark, sf, "part").select("p_partkey", N.trailing_episode(t).alias("number"))


@query("e17_nearest_ancestor_id", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_partkey % 3 = 1 THEN p_partkey + 1 END::BIGINT AS id FROM part")
def ancestor(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("/a/anilist-9/anilist-"), F.col("p_size").cast("string"), F.lit("/x.mkv"))).when(
        k % 3 == 1, F.concat(F.lit("/a/anilist-"), (k + 1).cast("string"), F.lit("/b/anilist-x/x.mkv"))).otherwise("/a/anilist-0/x.mkv")
    return table(spark, sf, "part").select("p_partkey", N.nearest_anilist(path).alias("id"))


@query("j36_season_directory", "SELECT p_partkey, p_partkey % 4 IN (0, 1, 3) AS season FROM part")
def season(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    return table(spark, sf, "part").select("p_partkey", N.is_season_directory(F.when(k == 0, "Season 2").when(k == 1, "S02").when(k == 3, "specials").otherwise("Season of x")).alias("season"))


@query("j37_artifact_names", "SELECT p_partkey, CASE WHEN p_size - 10 > 0 THEN printf('S01E%03d.m4a', p_size - 10) END AS name FROM part")
def artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", N.artifact_name(F.col("p_size") - 10).alias("name"))


@query("j48_manifest_identity", "SELECT p_partkey, p_partkey % 3 = 0 AS manifest FROM part")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    return table(spark, sf, "part").select("p_partkey", N.is_manifest(F.when(k == 0, "dir/.media.json").when(k == 1, "a/b/.media.json").otherwise("dir/xmedia.json")).alias("manifest"))


@query("d08_extension_of_path", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'srt' ELSE '' END AS ext FROM pages")
def extensions(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(F.col("page_id") % 2 == 0, "a.b/c.SRT").otherwise("a.b/c")
    return table(spark, sf, "pages").select("page_id", N.extension(p).alias("ext"))


_CUES = "c AS (SELECT conv_id, turn, regexp_replace(min(text), '\\n+', ' ', 'g') AS text FROM conversations GROUP BY conv_id, turn), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM c)"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    from subtide.operators.cleaning import renumber

    c = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.regexp_replace(F.min("text"), "\n+", " ").alias("text"))
    n = renumber(c, "conv_id", "turn")
    return srt_documents(n, "conv_id", "number", F.col("number") * 61.25, F.col("number") * 61.25 + 1.5, "text")


@query("a12_srt_parse", f"WITH {_CUES} SELECT conv_id, k AS index, k * 61.25e0 AS start_s, k * 61.25e0 + 1.5e0 AS end_s, md5(trim(text)) AS digest, false AS malformed FROM n")
def srt(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).withColumn("document", F.concat(F.lit("﻿"), F.replace("document", F.lit("\n"), F.lit("\r\n"))))
    p = S.parse_srt(d, "conv_id", "document")
    return p.select("conv_id", F.col("index").cast("long").alias("index"), "start_s", "end_s", F.md5(F.trim("text")).alias("digest"), "malformed")


@query("a13_ass_parse", f"WITH {_CUES} SELECT conv_id, k * 1e0 AS start_s, k + 0.5e0 AS end_s, md5(trim(text) || ', x') AS digest FROM n")
def ass(spark: SparkSession, sf: str) -> DataFrame:
    from subtide.operators.cleaning import renumber

    c = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.regexp_replace(F.min("text"), "\n+", " ").alias("text"))
    n = renumber(c, "conv_id", "turn")
    stamp = lambda cs: F.format_string("%d:%02d:%02d.%s", F.floor(F.col("number") / 3600), F.floor(F.col("number") / 60) % 60, F.col("number") % 60, F.lit(cs))
    line = F.concat(F.lit("Dialogue: 0,"), stamp("00"), F.lit(","), stamp("50"), F.lit(",Default,{\\i1}"), F.trim("text"), F.lit("{\\i0}, x"))
    d = n.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", line.alias("l")))), lambda x: x["l"]), "\n").alias("b"))
    head = "[Script Info]\nTitle: t\n\n[Events]\nFormat: Layer, Start, End, Style, Text\n"
    return S.parse_ass(d.select("conv_id", F.concat(F.lit(head), "b", F.lit("\nDialogue: bad\n")).alias("doc")), "conv_id", "doc").select("conv_id", "start_s", "end_s", F.md5("text").alias("digest"))


@query("j25_ass_cleanup", "SELECT conv_id, turn, md5('a b' || chr(10) || 'c ' || trim(text)) AS digest FROM conversations")
def ass_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("{\\b1}a\\hb\\N}c "), F.trim("text"), F.lit("{\\open"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(ass_to_text(raw)).alias("digest"))


@query("a14_format_dispatch", f"WITH {_CUES} SELECT conv_id, conv_id % 2 = 0 AS supported, CASE WHEN conv_id % 2 = 0 THEN count(*) ELSE 0 END AS cues FROM n GROUP BY conv_id")
def dispatch(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).withColumn("path", F.when(F.col("conv_id") % 2 == 0, "x.SRT").otherwise("x.vtt"))
    cues, bad = S.parse_by_extension(d, "conv_id", F.col("path"), "document")
    good = cues.groupBy("conv_id").agg(F.count(F.lit(1)).alias("cues")).select("conv_id", F.lit(True).alias("supported"), "cues")
    return good.unionByName(bad.select("conv_id", F.lit(False).alias("supported"), F.lit(0).cast("long").alias("cues")))


@query("a25_locator_kinds", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 's3' WHEN page_id % 3 = 1 THEN 'local' ELSE 'unsupported' END AS kind, CASE WHEN page_id % 3 = 0 THEN 'bucket' END AS bucket FROM pages")
def locators(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id") % 3
    uri = F.when(k == 0, "s3://bucket/a/b").when(k == 1, "/media/a").otherwise("ftp://host/x")
    scheme = F.regexp_extract(uri, r"^([a-z0-9]+)://", 1)
    kind = F.when(scheme == "s3", "s3").when(scheme.isin("", "file"), "local").otherwise("unsupported")
    return table(spark, sf, "pages").select("page_id", kind.alias("kind"), F.when(scheme == "s3", F.regexp_extract(uri, r"^s3://([^/]+)", 1)).alias("bucket"))


@query("j39_byte_ranges", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id WHEN event_id % 4 = 1 THEN event_id WHEN event_id % 4 = 2 THEN 100000 - 50 END AS first, CASE WHEN event_id % 4 = 0 THEN event_id + 9 WHEN event_id % 4 IN (1, 2) THEN 99999 END AS last FROM events")
def byte_ranges(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("event_id"), 100_000
    header = F.when(k % 4 == 0, F.format_string("bytes=%d-%d", k, k + 9)).when(k % 4 == 1, F.format_string("bytes=%d-", k)).when(k % 4 == 2, "bytes=-50").otherwise("items=1-2")
    p = r"^bytes=(\d*)-(\d*)$"
    a, b = (F.regexp_extract(header, p, i).try_cast("bigint") for i in (1, 2))
    ok = header.rlike(p) & (a.isNotNull() | b.isNotNull())
    return table(spark, sf, "events").select("event_id", F.when(ok, F.coalesce(a, n - b)).alias("first"), F.when(ok, F.when(a.isNull(), n - 1).otherwise(F.coalesce(b, F.lit(n - 1)))).alias("last"))
