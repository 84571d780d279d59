"""Text queries over documents, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.functions import scripts, text as T
from subtide.plans.registry import query
from subtide.session import table

_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"

_METRICS = r"""
l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS l FROM documents),
t AS (SELECT doc_id, l, array_to_string(l, chr(10)) AS t FROM l),
m AS (SELECT doc_id, len(l)::INT AS substantive_lines,
  length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g'))::INT AS visible, length(regexp_replace(t, '[^\p{Latin}]', '', 'g'))::INT AS latin,
  length(regexp_replace(t, '[^\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}]', '', 'g'))::INT AS kana,
  length(regexp_replace(t, '[^\p{Cyrillic}]', '', 'g'))::INT AS cyrillic, length(regexp_replace(t, '[^\p{Hangul}]', '', 'g'))::INT AS hangul FROM t)
"""


@query(
    "f11_script_metrics",
    f"WITH {_METRICS} SELECT doc_id, substantive_lines, visible, latin, kana, round(coalesce(latin / nullif(visible, 0), 0), 6) AS latin_ratio FROM m",
)
def script_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = scripts.metrics(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return m.select("doc_id", "substantive_lines", "visible", "latin", "kana", F.round("latin_ratio", 6).alias("latin_ratio"))


@query(
    "l01_language_bucket",
    f"""WITH {_METRICS} SELECT doc_id, CASE WHEN substantive_lines < 2 OR visible < 20 THEN 'insufficient_text'
        WHEN (latin + cyrillic + hangul) / nullif(visible, 0) >= 0.5 AND kana / nullif(visible, 0) < 0.1 THEN 'non_japanese' ELSE 'ambiguous' END AS bucket FROM m""",
)
def language_bucket(spark: SparkSession, sf: str) -> DataFrame:
    m = scripts.metrics(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return m.select("doc_id", F.coalesce(scripts.bucket(), F.lit("ambiguous")).alias("bucket"))


#: Endings put behind the texts, so that every case is met.
_ENDS = ("", "➡", " →\t", "➝➞ ", "➾", "▶", "⇒ ", "➡ x", "\t➜\n")


@query(
    "j21_mechanical_normalise",
    f"""WITH e AS (SELECT doc_id, text || [{", ".join("'" + e + "'" for e in _ENDS)}][doc_id % {len(_ENDS)} + 1] AS text FROM documents),
        j AS (SELECT doc_id, text, replace(replace(text, chr(13), ''), chr(10), '') AS j FROM e),
        s AS (SELECT *, regexp_replace(j, '[ \\t]*[{T.ARROWS}]+[ \\t]*$', '') AS s FROM j)
        SELECT doc_id, md5(s) AS digest, concat_ws(',', CASE WHEN j <> text THEN 'join_physical_lines' END, CASE WHEN s <> j THEN 'strip_trailing_arrow' END) AS rules FROM s""",
)
def normalise(spark: SparkSession, sf: str) -> DataFrame:
    ends = F.array(*[F.lit(e) for e in _ENDS])
    d = table(spark, sf, "documents").select("doc_id", F.concat("text", F.get(ends, (F.col("doc_id") % len(_ENDS)).cast("int"))).alias("text"))
    t, rules = T.mechanical_normalise(F.col("text"))
    return d.select("doc_id", F.md5(t).alias("digest"), F.array_join(rules, ",").alias("rules"))


@query("j42_clean_lines", "SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS digest FROM documents")
def clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.clean_lines(F.col("text"))).alias("digest"))


@query(
    "j23_html_to_text",
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)<br\s*/?>|</p>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM pages),
        b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM a)
        SELECT page_id, md5(trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'))) AS digest FROM b""",
)
def html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(T.html_to_text(F.col("html"))).alias("digest"))


@query("j49_blank_to_null", "SELECT conv_id, turn, nullif(trim(CASE WHEN turn % 3 = 0 THEN '  ' ELSE role END), '') AS role FROM conversations")
def blank(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.blank_to_null(F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("role"))).alias("role"))


@query(
    "c08_preferred_title",
    "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN p_name END), ''), nullif(trim(CASE WHEN p_size % 3 = 1 THEN p_brand ELSE ' ' END), ''), 'AniList ' || p_partkey) AS title FROM part",
)
def preferred(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size") % 3
    title = T.first_of(F.when(s == 0, F.col("p_name")), F.when(s == 1, F.col("p_brand")).otherwise(" "), F.concat(F.lit("AniList "), F.col("p_partkey").cast("string")))
    return table(spark, sf, "part").select("p_partkey", title.alias("title"))


@query(
    "j26_srt_timestamps",
    """WITH m AS (SELECT event_id, value, round_even(value * 1000, 0)::BIGINT AS ms FROM events)
       SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp, round(ms / 1000.0, 3) AS seconds FROM m""",
)
def srt(spark: SparkSession, sf: str) -> DataFrame:
    stamp = T.srt_time(F.col("value"))
    return table(spark, sf, "events").select("event_id", stamp.alias("stamp")).withColumn("seconds", F.round(T.srt_seconds(F.col("stamp")), 3))


@query("j27_clock_display", "SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS shown FROM (SELECT event_id, floor(value * 30)::BIGINT AS s FROM events)")
def clock(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", T.clock(F.col("value") * 30).alias("shown"))


@query(
    "j29_date_parts",
    """SELECT event_id, CAST(CASE WHEN d <= 28 OR (d <= 30 AND m <> 2) OR (d = 31 AND m IN (1, 3, 5, 7, 8, 10, 12)) THEN make_date(2023, m, d) END AS VARCHAR) AS date
       FROM (SELECT event_id, (event_id % 12 + 1)::INT AS m, (event_id % 31 + 1)::INT AS d FROM events)""",
)
def dates(spark: SparkSession, sf: str) -> DataFrame:
    m, d = (F.col("event_id") % 12 + 1).cast("int"), (F.col("event_id") % 31 + 1).cast("int")
    return table(spark, sf, "events").select("event_id", T.date_of(F.lit(2023), m, d).cast("string").alias("date"))


_NS = "6ba7b8119dad11d180b400c04fd430c8"


@query(
    "j17_uuid5",
    f"""WITH h AS (SELECT page_id, sha1(unhex('{_NS}') || encode(url)) AS h FROM pages)
        SELECT page_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:17])::INT % 4) + 1, 1) || h[18:20] || '-' || h[21:32] AS id FROM h""",
)
def uuids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.uuid5(_NS, F.col("url")).alias("id"))


@query(
    "j19_window_ids",
    r"""SELECT conv_id, turn, printf('%s-w%05d-%s', regexp_replace('conv:' || conv_id || '/x', '[^\p{L}\p{N}]+', '-', 'g'), turn, sha256(text)[1:12]) AS window_id FROM conversations""",
)
def window_ids(spark: SparkSession, sf: str) -> DataFrame:
    src = F.concat(F.lit("conv:"), F.col("conv_id").cast("string"), F.lit("/x"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.window_id(src, F.col("turn"), F.col("text")).alias("window_id"))


@query("j18_sha256_cache_key", """SELECT c_custkey, sha256('{"flags": [' || c_nationkey || '], "query": "' || c_name || '"}') AS cache_key FROM customer""")
def cache_key(spark: SparkSession, sf: str) -> DataFrame:
    body = F.format_string('{"flags": [%d], "query": "%s"}', "c_nationkey", "c_name")
    return table(spark, sf, "customer").select("c_custkey", F.sha2(body, 256).alias("cache_key"))


@query("j20_source_key", "SELECT DISTINCT concat_ws(':', lang, source) AS source_key FROM documents")
def source_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(T.source_key(F.col("lang"), F.col("source")).alias("source_key")).distinct()


@query(
    "c17_cue_prompt",
    """SELECT conv_id, md5(string_agg('<cue id="' || k || '">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</cue>', chr(10) ORDER BY k)) AS digest
       FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM (SELECT DISTINCT conv_id, turn, text FROM conversations)) GROUP BY conv_id""",
)
def cue_prompt(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "text"))).alias("t"))
    return c.select("conv_id", F.md5(T.cue_tags(F.transform("t", lambda x: x["text"]))).alias("digest"))


@query("j35_token_estimate", "SELECT conv_id, turn, (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4)) END)::BIGINT AS tokens FROM conversations")
def estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"))


@query("j31_json_fields", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query(
    "j32_genres_list_or_scalar",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || '|' || o_orderpriority ELSE o_orderpriority END AS genres FROM orders",
)
def genres(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.array("o_orderstatus", "o_orderpriority"))).otherwise(F.col("o_orderpriority"))
    listed = F.when(raw.rlike(r"^\s*\["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(F.filter(listed, lambda x: F.trim(x) != ""), "|").alias("genres"))


@query("j33_message_content", "SELECT conv_id, turn, text AS content FROM conversations")
def message_content(spark: SparkSession, sf: str) -> DataFrame:
    """Content given as a string or as a list of parts."""
    body = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("content")))).otherwise(
        F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")))
    )
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.get_json_object(body, "$.content").alias("raw"))
    parts = F.from_json("raw", "array<struct<type:string,text:string>>")
    text = F.when(F.col("raw").rlike(r'^\[\{"type"'), F.array_join(F.transform(parts, lambda p: p["text"]), "\n")).otherwise(F.col("raw"))
    return c.select("conv_id", "turn", text.alias("content"))


@query("j52_padded_names", "SELECT event_id, printf('%s_%03d_%09dms', event_type, event_id % 1000, round_even(value * 1000, 0)::BIGINT) AS name FROM events")
def padded(spark: SparkSession, sf: str) -> DataFrame:
    name = F.format_string("%s_%03d_%09dms", "event_type", F.col("event_id") % 1000, F.bround(F.col("value") * 1000).cast("long"))
    return table(spark, sf, "events").select("event_id", name.alias("name"))


@query("j50_retry_after", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN greatest(value - 20e0, 0e0) END AS wait FROM events")
def retry_after(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, (F.col("value") - 20).cast("string")).when(F.col("event_id") % 3 == 1, "soon")
    return table(spark, sf, "events").select("event_id", F.greatest(raw.try_cast("double"), F.when(raw.try_cast("double").isNotNull(), 0.0)).alias("wait"))
