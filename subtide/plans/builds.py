"""Index builds, detectors and other compositions of several operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.functions import filenames as N
from subtide.functions import release_names as R
from subtide.operators import alignment as A
from subtide.operators import crosswalk as X
from subtide.operators import intervals as I
from subtide.operators import language as L
from subtide.operators.ranking import places
from subtide.plans import crosswalk as bridge_source
from subtide.plans.intervals import spans
from subtide.plans.parsing import names
from subtide.plans.registry import query
from subtide.session import table

_N = "n AS (SELECT p_partkey, p_partkey % 8 AS style, p_partkey % 120 + 1 AS e FROM part)"
_EP = "(CASE WHEN style IN (0, 1, 2, 6) THEN e WHEN style = 3 THEN CASE WHEN e IN (264, 265) THEN NULL ELSE e END WHEN style = 5 THEN e + 300 END)::INT"


@query("j08_episode_with_method", f"WITH {_N} SELECT p_partkey, {_EP} AS episode, CASE style WHEN 0 THEN 'sxxeyy' WHEN 6 THEN 'sxxeyy' WHEN 1 THEN 'episode_word' WHEN 2 THEN 'bare_number' WHEN 3 THEN 'bare_number' WHEN 5 THEN 'bare_number' ELSE 'none' END AS method FROM n")
def methods(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select("p_partkey", N.episode_with_method(F.col("name")).alias("e")).select("p_partkey", "e.episode", "e.method")


@query("j13_episode_suggestion", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 90 + 1)::INT END AS episode FROM part")
def suggestion(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 90 + 1
    name = F.when(F.col("p_partkey") % 3 == 0, F.format_string("Name - %02d.srt", k)).when(F.col("p_partkey") % 3 == 1, F.format_string("Name %02d-%02d.srt", k, k + 3)).otherwise("Name batch 07.srt")
    return table(spark, sf, "part").select("p_partkey", R.ordinary_episode(name).alias("episode"))


@query(
    "b13_subtitle_index_build",
    f"""WITH {_N} SELECT p_partkey, {_EP} AS episode, CASE style WHEN 0 THEN 'ja' WHEN 1 THEN 'jpn' WHEN 2 THEN 'en' WHEN 3 THEN 'en' WHEN 5 THEN 'zh' WHEN 6 THEN 'ja' ELSE 'unknown' END AS lang,
        CASE WHEN style IN (0, 2, 3, 4) THEN 'srt' WHEN style = 5 THEN 'ssa' ELSE 'ass' END AS ext FROM n""",
)
def subtitle_index(spark: SparkSession, sf: str) -> DataFrame:
    """File names to the rows of a subtitle index."""
    n = F.col("name")
    return names(spark, sf).select("p_partkey", N.episode(n)["local"].alias("episode"), N.language_hint(n).alias("lang"), N.extension(n).alias("ext"))


@query("b11_crosswalk_build_summary", f"WITH {bridge_source._ROWS} SELECT count(*) AS lookup_count, count(DISTINCT row_id) AS anime_count, count(*) > count(DISTINCT row_id) AS valid FROM g")
def crosswalk_build(spark: SparkSession, sf: str) -> DataFrame:
    """The whole build and the checks before promotion."""
    rows = bridge_source.bridge(spark, sf)
    a = rows.agg(F.count(F.lit(1)).alias("lookup_count"), F.countDistinct("row_id").alias("anime_count"))
    return a.withColumn("valid", F.col("lookup_count") > F.col("anime_count"))


@query("b24_report_rows", "SELECT 'status' AS report, o_orderstatus AS name, count(*)::VARCHAR AS value FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'priority', o_orderpriority, count(*)::VARCHAR FROM orders GROUP BY o_orderpriority")
def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of several small reports in one table, to be written as CSV parted by report."""
    o = table(spark, sf, "orders")
    part = lambda report, c: o.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(report).alias("report"), "name", "value")
    return part("status", "o_orderstatus").unionByName(part("priority", "o_orderpriority"))


@query("b28_manifest_serialisation", """SELECT o_custkey, '{"series":{"id":' || o_custkey || '},"episodes":[' || string_agg('{"key":"' || o_orderkey || '"}', ',' ORDER BY o_orderkey) || ']}' AS manifest FROM orders GROUP BY o_custkey""")
def manifests(spark: SparkSession, sf: str) -> DataFrame:
    ep = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: F.struct(k.cast("string").alias("key")))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(ep.alias("e")).select("o_custkey", F.to_json(F.struct(F.struct(F.col("o_custkey").alias("id")).alias("series"), F.col("e").alias("episodes"))).alias("manifest"))


@query("c27_client_decoding", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 7 ELSE 2 END AS count, s_name AS first FROM supplier")
def decoding(spark: SparkSession, sf: str) -> DataFrame:
    results = F.array("s_name", F.lit("x")).alias("results")
    j = F.when(F.col("s_suppkey") % 2 == 0, F.to_json(F.struct(F.lit(7).alias("count"), results))).otherwise(F.to_json(F.struct(results)))
    r = table(spark, sf, "supplier").select("s_suppkey", F.from_json(j, "count int, results array<string>").alias("r"))
    return r.select("s_suppkey", F.coalesce("r.count", F.size("r.results")).alias("count"), F.get("r.results", 0).alias("first"))


@query("c30_request_of_chunks", "SELECT l_orderkey, count(*) AS chunks, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS places FROM lineitem GROUP BY l_orderkey")
def chunk_request(spark: SparkSession, sf: str) -> DataFrame:
    c = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(c.alias("c"))
    return g.select("l_orderkey", F.size("c").cast("long").alias("chunks"), F.array_join(F.transform("c", lambda x: x["l_linenumber"].cast("string")), ",").alias("places"))


@query("h12_window_order_in_source", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS place FROM documents")
def window_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return places(rows, [F.floor(F.col("n_chars") / 64)], ["n_chars", "doc_id"], ("source",)).select("source", "doc_id", "place")


@query("j41_metadata_merge", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS parts FROM part")
def merged(spark: SparkSession, sf: str) -> DataFrame:
    a = F.create_map(F.lit("k"), F.col("p_name"))
    b = F.when(F.col("p_size") % 2 == 0, a).otherwise(F.create_map(F.lit("k"), F.lit("other")))
    a, b = F.map_entries(a), F.map_entries(b)
    return table(spark, sf, "part").select("p_partkey", F.size(A.merge_metadata(a, b)).alias("parts"))


@query("k04_speech_chunks", 'WITH s AS (SELECT user_id, epoch_us(ts) AS start, epoch_us(ts) + round(value * 100)::BIGINT * 30000000 AS "end" FROM events) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start, "end") - 1 AS index, start FROM s')
def speech_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = A.speech_chunks(spans(spark, sf).select("user_id", "start", "end"), "user_id")
    return c.select("user_id", F.col("lineage.place").cast("long").alias("index"), "start")


@query("k10_playback_range", "SELECT event_id, round_even(value * 1000, 0)::BIGINT AS first, greatest(round_even((value - 1e0) * 1000, 0)::BIGINT, round_even(value * 1000, 0)::BIGINT + 1) AS last FROM events")
def playback(spark: SparkSession, sf: str) -> DataFrame:
    a, b = A.playback_range(F.col("value"), F.col("value") - 1)
    return table(spark, sf, "events").select("event_id", a.alias("first"), b.alias("last"))


def _halves(chunks: pd.DataFrame) -> pd.DataFrame:
    """A stand-in detector: speech in the second half of each chunk."""
    out = chunks[["event_id", "user_id"]].copy()
    out["start"] = chunks["start"] + (chunks["end"] - chunks["start"]) // 2
    out["end"] = chunks["end"]
    return out


@query(
    "k15_detect_normalise",
    """WITH s AS (SELECT event_id, user_id, epoch_us(ts) AS a, epoch_us(ts) + round(value * 100)::BIGINT * 30000000 AS e FROM events), h AS (SELECT user_id, a + (e - a) // 2 AS a, e FROM s),
       f AS (SELECT *, coalesce(a > max(e) OVER (PARTITION BY user_id ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM h WHERE e > a),
       i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a, e ROWS UNBOUNDED PRECEDING) AS k FROM f)
       SELECT user_id, min(a) AS start, max(e) AS "end", count(*) AS n FROM i GROUP BY user_id, k""",
)
def detect_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """A detector over chunks, then its spans merged per source."""
    found = A.detect(spans(spark, sf).select("event_id", "user_id", "start", "end"), _halves, "event_id long, user_id long, start long, end long")
    return I.merge_spans(found, ["user_id"], "start", "end")


@query(
    "n06_tokens_without_punctuation",
    "SELECT p_partkey, k - 1 AS index, w[k] AS token, (CASE WHEN k = 1 THEN 0 ELSE len(array_to_string(w[1:k - 1], '')) + 2 * (k = 2)::INT + 2 * (k > 2)::INT END)::INT AS start FROM (SELECT p_partkey, string_split(p_name, ' ') AS w, unnest(range(1, len(string_split(p_name, ' ')) + 1))::INT AS k FROM part)",
)
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts without their spaces, a mark after the first word, cut by a lexicon of all names' words."""
    part = table(spark, sf, "part")
    known = L.lexicon(part.select(F.explode(F.split("p_name", " ")).alias("w")), "w")
    joined = F.concat(F.substring_index("p_name", " ", 1), F.lit("。!"), F.replace(F.substr("p_name", F.instr("p_name", " ") + 1), F.lit(" "), F.lit("")))
    return L.segment(part.select("p_partkey", joined.alias("text")), known, "p_partkey", "text").select("p_partkey", "index", "token", "start")


_GRAMS = r"""ln AS (SELECT doc_id, lang, line_no, ' ' || trim(regexp_replace(regexp_replace(lower(line), '\p{Nd}', '0', 'g'), '\s+', ' ', 'g')) || ' ' AS p
  FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents) WHERE trim(line) <> ''),
g AS (SELECT doc_id, lang, line_no, unnest([p[i:i + 2] FOR i IN range(1, len(p) - 1)]) AS gram FROM ln),
c AS (SELECT gram, lang, count(*) AS c FROM g WHERE doc_id % 5 <> 1 GROUP BY ALL),
k AS (SELECT gram FROM c GROUP BY gram HAVING sum(c) >= 3), v AS (SELECT count(*) AS v FROM k),
t AS (SELECT lang, sum(c) AS total FROM c JOIN k USING (gram) GROUP BY lang),
m AS (SELECT k.gram, t.lang, ln((coalesce(c.c, 0) + 0.5::DOUBLE) / (t.total + 0.5::DOUBLE * v.v)) AS weight FROM k CROSS JOIN t CROSS JOIN v LEFT JOIN c ON c.gram = k.gram AND c.lang = t.lang),
s AS (SELECT doc_id, line_no, m.lang, round(sum(n * weight), 6) AS score FROM (SELECT doc_id, line_no, gram, count(*) AS n FROM g GROUP BY ALL) JOIN m USING (gram) GROUP BY ALL),
b AS (SELECT doc_id, line_no, lang FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY score DESC, lang) = 1)"""


@query(
    "n01_language_of_line",
    f"WITH {_GRAMS} SELECT ln.doc_id, ln.lang, ln.doc_id % 5 = 1 AS held_out, count(*) AS lines, count(*) FILTER (b.lang = ln.lang) AS agreed FROM ln LEFT JOIN b USING (doc_id, line_no) GROUP BY ALL",
)
def line_languages(spark: SparkSession, sf: str) -> DataFrame:
    """The language of every line of the documents, by a model of four fifths of them."""
    d = table(spark, sf, "documents")
    lines = d.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    model = L.train_languages(lines.where("doc_id % 5 <> 1"), "line", "lang")
    told = L.detect_language(lines, model, ["doc_id", "line_no"], "line")
    whole = lines.select("doc_id", "lang", "line_no").join(told, ["doc_id", "line_no"])
    return whole.groupBy("doc_id", "lang", (F.col("doc_id") % 5 == 1).alias("held_out")).agg(
        F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("language") == F.col("lang"), 1)).alias("agreed")
    )


@query("n08_prompt_layout", "SELECT p_partkey, '<|start|>' || replace(p_name, ' ', '<|t|><|start|>') || '<|t|>' AS prompt FROM part")
def prompt_layout(spark: SparkSession, sf: str) -> DataFrame:
    slots = F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("<|start|>"), w, F.lit("<|t|>")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(slots, "").alias("prompt"))


@query("o05_candidates_classified", r"SELECT conv_id, CASE WHEN sum(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))) < 20 OR count(*) FILTER (regexp_matches(text, '[\p{L}\p{N}]')) < 2 THEN 'insufficient_text' ELSE 'non_japanese' END AS bucket FROM (SELECT conv_id, turn, regexp_replace(min(text), '\n+', ' ', 'g') AS text FROM conversations GROUP BY conv_id, turn) GROUP BY conv_id")
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Subtitle documents to cues to script metrics to a bucket."""
    from subtide.functions import scripts
    from subtide.plans.parsing import documents
    from subtide.sources.subtitles import parse_srt

    cues = parse_srt(documents(spark, sf), "conv_id", "document")
    joined = cues.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n").alias("t"))
    return scripts.metrics(joined, "t").select("conv_id", F.coalesce(scripts.bucket(), F.lit("ambiguous")).alias("bucket"))


@query("o12_initial_lookup", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'error' WHEN p_partkey % 4 = 1 THEN 'anilist' WHEN p_partkey % 4 = 2 THEN 'tvdb' ELSE 'path' END AS by, CASE WHEN p_partkey % 4 IN (1, 2) THEN 5 WHEN p_partkey % 4 = 0 THEN p_partkey + 1 END::BIGINT AS id FROM part")
def initial_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """An explicit id wins over the path's; two explicit ones are an error."""
    k = F.col("p_partkey") % 4
    p = table(spark, sf, "part").select("p_partkey", F.when(k.isin(1, 3), 5).alias("a"), F.when(k.isin(2, 3), 5).alias("t"), F.concat(F.lit("/m/anilist-"), (F.col("p_partkey") + 1).cast("string"), F.lit("/x.mkv")).alias("path"))
    both = F.col("a").isNotNull() & F.col("t").isNotNull()
    by = F.when(both, "error").when(F.col("a").isNotNull(), "anilist").when(F.col("t").isNotNull(), "tvdb").otherwise("path")
    return p.select("p_partkey", by.alias("by"), F.when(~both, F.coalesce("a", "t", N.nearest_anilist(F.col("path")))).cast("long").alias("id"))


@query("o04_ingest_plan", "SELECT o_custkey, n, CASE WHEN n = 1 THEN 'ingest' ELSE 'review' END AS plan FROM (SELECT o_custkey, o_orderkey % 12 AS ep, count(*) AS n FROM orders GROUP BY o_custkey, o_orderkey % 12)")
def ingest_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Suggestions that are unique go in; ambiguous ones go to review."""
    g = table(spark, sf, "orders").groupBy("o_custkey", (F.col("o_orderkey") % 12).alias("ep")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("o_custkey", "n", F.when(F.col("n") == 1, "ingest").otherwise("review").alias("plan"))


@query("o08_lines_to_groups", "SELECT conv_id, count(*) AS groups, sum(len(regexp_extract_all(line, '[\\p{L}\\p{N}]+')))::BIGINT AS tokens FROM (SELECT conv_id, unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE trim(line) <> '' GROUP BY conv_id")
def lines_to_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Lines to token groups, aligned by a stand-in, merged back per conversation."""
    line = table(spark, sf, "conversations").select("conv_id", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    n = F.size(F.regexp_extract_all("line", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return line.groupBy("conv_id").agg(F.count(F.lit(1)).alias("groups"), F.sum(n).alias("tokens"))


@query("m08_query_result_cache", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'cached' ELSE 'fetched' END AS outcome FROM customer")
def query_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Cache keys of queries against stored results."""
    key = F.sha2(F.format_string('{"flags": [%d], "query": "%s"}', "c_nationkey", "c_name"), 256)
    c = table(spark, sf, "customer").select("c_custkey", key.alias("cache_key"))
    stored = c.where("c_custkey % 3 = 0").select("cache_key", F.lit(True).alias("hit"))
    return c.join(stored, "cache_key", "left").select("c_custkey", F.when(F.col("hit"), "cached").otherwise("fetched").alias("outcome"))


@query("o17_fetch_by_lookup_kind", f"WITH {bridge_source._ROWS}, r AS (SELECT DISTINCT row_id FROM g WHERE source = 'tvdb' AND external_id = '6' AND media_kind = 'tv') SELECT l_partkey, count(*) AS files FROM lineitem JOIN r ON l_partkey + 1 = row_id GROUP BY l_partkey")
def fetch(spark: SparkSession, sf: str) -> DataFrame:
    ids = X.lookup(bridge_source.bridge(spark, sf), "tvdb", "6", "tv").select((F.col("row_id") - 1).alias("l_partkey")).distinct()
    return table(spark, sf, "lineitem").join(ids, "l_partkey", "left_semi").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("files"))
