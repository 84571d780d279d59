"""Record queries: manifests, requests, logs, reports and end-to-end compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subtide.functions import release_names
from subtide.functions import text as T
from subtide.operators import cleaning as C
from subtide.operators import records as R
from subtide.operators import search as S
from subtide.operators.ranking import places
from subtide.plans.registry import query
from subtide.session import table


@query("c03_validated_projection", "SELECT c_name, c_custkey FROM customer")
def projection(spark: SparkSession, sf: str) -> DataFrame:
    return R.project(table(spark, sf, "customer"), ["c_name", "c_custkey", "c_name"])


@query("c04_detail_decodes_json", "SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE event_id = 77")
def detail(spark: SparkSession, sf: str) -> DataFrame:
    return R.detail(table(spark, sf, "events"), "event_id", 77, ["event_id", "props"], {"props": "k int"}).select("event_id", F.col("props.k").alias("k"))


@query("c05_cached_payload_contract", "SELECT s_suppkey, s_name AS title, round(s_acctbal, 2) AS score FROM supplier")
def payload(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "supplier").select("s_suppkey", F.to_json(F.struct(F.col("s_name").alias("title"), F.col("s_acctbal").alias("score"), F.lit(1).alias("private"))).alias("j"))
    return p.select("s_suppkey", F.from_json("j", "title string, score double").alias("x")).select("s_suppkey", "x.title", F.round("x.score", 2).alias("score"))


def _manifests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A manifest a customer with its orders as episodes; some broken, some files missing."""
    o = table(spark, sf, "orders")
    ep = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: F.struct(k.cast("string").alias("episode_key"), F.concat(F.lit("e"), k.cast("string"), F.lit(".m4a")).alias("relative_path"), k.alias("size_bytes")))
    k = F.col("o_custkey")
    body = F.to_json(F.struct(
        F.when(k % 11 == 0, 2).otherwise(1).alias("schema_version"), F.lit("audio").alias("kind"), F.struct(k.alias("id"), F.concat(F.lit("t"), k.cast("string")).alias("title")).alias("series"),
        F.struct(F.lit("opus").alias("name"), F.lit("opus").alias("codec")).alias("profile"), F.col("e").alias("episodes")))
    texts = o.groupBy("o_custkey").agg(ep.alias("e")).select(F.concat(F.lit("/lib/"), k.cast("string"), F.lit("/.media.json")).alias("path"), F.when(k % 13 == 0, "{nope").otherwise(body).alias("value"))
    files = o.where("o_orderkey % 97 <> 0").select(F.format_string("/lib/%d/e%d.m4a", "o_custkey", "o_orderkey").alias("path"))
    return texts, files


_MAN = """m AS (SELECT o_custkey AS k, bool_or(o_orderkey % 97 = 0) AS lost, o_custkey % 11 = 0 OR o_custkey % 13 = 0 AS bad FROM orders GROUP BY o_custkey)"""


@query("a09_manifest_series", f"WITH {_MAN} SELECT k AS series_id, 't' || k AS title, 'opus' AS profile FROM m WHERE NOT bad AND NOT lost")
def manifest_series(spark: SparkSession, sf: str) -> DataFrame:
    return R.load_manifests(*_manifests(spark, sf))[0].select("series_id", "title", "profile")


@query("a09_manifest_artifacts", f"WITH {_MAN} SELECT k AS series_id, o_orderkey::VARCHAR AS episode_key, o_orderkey AS size_bytes FROM m JOIN orders ON o_custkey = k WHERE NOT bad AND NOT lost")
def manifest_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return R.load_manifests(*_manifests(spark, sf))[1].select("series_id", "episode_key", "size_bytes")


@query("l10_manifest_errors", f"WITH {_MAN} SELECT '/lib/' || k || '/.media.json' AS path, CASE WHEN bad THEN 'invalid_manifest' ELSE 'missing_artifact' END AS code FROM m WHERE bad OR lost")
def manifest_errors(spark: SparkSession, sf: str) -> DataFrame:
    return R.load_manifests(*_manifests(spark, sf))[2]


_CUES = "c AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM c)"


def _cues(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return C.context_windows(_cues(spark, sf), "conv_id", "turn", F.struct(F.col("turn").alias("index"), "text"), 3, 1)


@query(
    "c12_window_manifest",
    rf"""WITH {_CUES} SELECT printf('%s-w%05d-%s', conv_id::VARCHAR, i // 3, sha256(string_agg(text, chr(10) ORDER BY i))[1:12]) AS custom_id, conv_id, string_agg(turn::VARCHAR, ',' ORDER BY i) AS indexes FROM n GROUP BY conv_id, i // 3""",
)
def window_manifest(spark: SparkSession, sf: str) -> DataFrame:
    m = R.window_manifest(_windows(spark, sf), "conv_id")
    return m.select("custom_id", "conv_id", F.array_join(F.transform("indexes", lambda x: x.cast("string")), ",").alias("indexes"))


@query(
    "c13_batch_requests",
    rf"""WITH {_CUES}, w AS (SELECT conv_id, i // 3 AS w, list(text ORDER BY i) AS t FROM n GROUP BY conv_id, i // 3)
    SELECT conv_id, w, md5(array_to_string(list_transform(t, lambda x, k: '<cue id="' || k || '">' || replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</cue>'), chr(10))) AS user_digest FROM w""",
)
def batch_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The O01 path: cues to windows to manifests to requests."""
    m = R.window_manifest(_windows(spark, sf), "conv_id")
    body = F.from_json("body", "messages array<struct<role:string,content:string>>")
    r = R.batch_requests(m, "m", "s").join(m.select("custom_id", "conv_id", F.col("window").alias("w")), "custom_id")
    return r.select("conv_id", "w", F.md5(F.get(body["messages"], 1)["content"]).alias("user_digest"))


@query("l05_dead_letters_embed_manifest", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS owner FROM orders WHERE o_orderstatus = 'P'")
def dead(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    d = R.dead_letters(o.where("o_orderstatus = 'P'").select("o_orderkey"), o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey"), "o_orderkey")
    return d.select("o_orderkey", F.col("manifest.o_custkey").alias("owner"))


@query("l08_decision_log", f"WITH {_CUES} SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'asis' WHEN 1 THEN 'edit' ELSE 'remove' END AS decision, md5(CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || '!' END) AS digest, turn % 3 <> 0 AS changed FROM c")
def decision_log(spark: SparkSession, sf: str) -> DataFrame:
    c = _cues(spark, sf)
    k = F.col("turn") % 3
    d = c.select("conv_id", "turn", F.when(k == 0, "asis").when(k == 1, "edit").otherwise("remove").alias("decision"), F.concat("text", F.lit("!")).alias("new_text"))
    return R.decision_log(c, d, ["conv_id", "turn"], "text").select("conv_id", "turn", "decision", F.md5("emitted_text").alias("digest"), "changed")


@query("f20_reconstruction_summary", f"WITH {_CUES} SELECT count(DISTINCT conv_id) AS sources, count(*) AS cues, count(*) FILTER (turn = 5) AS errors, count(DISTINCT conv_id) FILTER (turn = 5) AS blocked FROM c")
def summary(spark: SparkSession, sf: str) -> DataFrame:
    c = _cues(spark, sf)
    return R.reconstruction_summary(c, c.where("turn = 5"), "conv_id")


@query("f21_changed_and_episodes", "SELECT o_custkey, count(*) FILTER (o_totalprice > 200000) AS changed, coalesce(string_agg(DISTINCT (o_orderkey % 9)::VARCHAR, ',' ORDER BY (o_orderkey % 9)::VARCHAR) FILTER (o_orderkey % 9 > 0), '') AS episodes FROM orders GROUP BY o_custkey")
def changed(spark: SparkSession, sf: str) -> DataFrame:
    e = F.sort_array(F.collect_set(F.when(F.col("o_orderkey") % 9 > 0, (F.col("o_orderkey") % 9).cast("string"))))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_totalprice") > 200000).alias("changed"), F.array_join(e, ",").alias("episodes"))


@query(
    "j34_segment_parse",
    """SELECT event_id, round(least(l + s, greatest(s, CASE WHEN a < s THEN a + s ELSE a END)), 6) AS start, round(least(l + s, greatest(s, CASE WHEN b <= l THEN b + s ELSE b END)), 6) AS "end", event_type AS text
       FROM (SELECT event_id, event_type, 100e0 AS s, 60e0 AS l, value AS a, value + 2e0 AS b FROM events)""",
)
def segments(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("value").cast("string"), (F.col("value") + 2).cast("string")
    odd = F.col("event_id") % 2 == 1
    one = F.to_json(F.array(F.struct(F.concat(a, F.lit("s")).alias("start_time"), F.concat(b, F.lit("s")).alias("end_time"), F.col("event_type").alias("content"))))
    two = F.to_json(F.array(F.struct(a.alias("start"), b.alias("end"), F.col("event_type").alias("text"))))
    s = R.segments_of(F.when(odd, one).otherwise(two), F.lit(100.0), F.lit(60.0))
    e = table(spark, sf, "events").select("event_id", F.explode(s).alias("x"))
    return e.select("event_id", F.round("x.start", 6).alias("start"), F.round("x.end", 6).alias("end"), "x.text")


@query("g13_local_ids", "SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey * 10 + l_linenumber) AS local FROM lineitem")
def local(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").withColumn("o", F.col("l_partkey") * 10 + F.col("l_linenumber"))
    return R.indexed_samples(l, "l_orderkey", "o").select("l_orderkey", "l_partkey", F.col("local").cast("long").alias("local"))


@query("h07_group_report_order", "SELECT o_custkey, row_number() OVER (ORDER BY s <> 'P', printf('%.3f', r), n DESC, o_custkey) AS place FROM (SELECT o_custkey, min(o_orderstatus) AS s, count(*) FILTER (o_orderstatus = 'F') / count(*) AS r, count(*) AS n FROM orders GROUP BY o_custkey)")
def group_report(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderstatus").alias("x"), F.min("o_orderstatus").alias("s"), (F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("r"), F.count(F.lit(1)).alias("n"))
    return places(g, [F.col("s") != "P", F.format_string("%.3f", "r"), -F.col("n")], ["o_custkey"]).select("o_custkey", "place")


@query("h13_inventory_order", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY source, n_chars, doc_id) AS place FROM documents")
def inventory_order(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return places(d, [F.col("source"), F.col("n_chars")], ["doc_id"], ("lang",)).select("doc_id", "place")


@query("h14_integer_key_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders")
def integer_order(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderkey").cast("string").cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("i08_distinct_prompts", "SELECT count(DISTINCT text) AS prompts FROM conversations WHERE role = 'system'")
def prompts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("role = 'system'").agg(F.countDistinct("text").alias("prompts"))


@query("e11_review_join", f"WITH {_CUES} SELECT conv_id, turn, md5(text) AS cue, CASE WHEN turn % 2 = 0 THEN 'edit' END AS decision, CASE WHEN turn % 3 = 0 THEN length(text) END AS cleaned FROM c")
def review(spark: SparkSession, sf: str) -> DataFrame:
    c = _cues(spark, sf)
    d = c.where("turn % 2 = 0").select("conv_id", "turn", F.lit("edit").alias("decision"))
    k = c.where("turn % 3 = 0").select("conv_id", "turn", F.char_length("text").cast("long").alias("cleaned"))
    r = R.review_rows(c.select("conv_id", "turn"), c, d, k, ["conv_id", "turn"])
    return r.select("conv_id", "turn", F.md5("text").alias("cue"), "decision", "cleaned")


@query("e20_first_existing_candidate", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'b' || p_partkey WHEN p_size % 3 = 1 THEN 'a' || p_partkey END AS path FROM part")
def existing(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    both = F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.lit("a").alias("d")), F.struct(F.lit(1).alias("rank"), F.lit("b").alias("d")))).alias("x")
    c = p.select("p_partkey", both).select("p_partkey", "x.rank", F.concat("x.d", F.col("p_partkey").cast("string")).alias("path"))
    have = p.where("p_size % 3 = 1").select(F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("path")).unionByName(
        p.where("p_size % 3 < 2").select(F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("path")))
    return R.first_existing(c, have, "p_partkey", "path", "rank")


@query("e24_entry_by_key", "SELECT o_custkey, min(o_orderkey) FILTER (o_orderpriority = '2-HIGH') AS entry FROM orders GROUP BY o_custkey")
def entry_by_key(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("l"))
    return l.select("o_custkey", F.get(F.filter("l", lambda x: x["o_orderpriority"] == "2-HIGH"), 0)["o_orderkey"].alias("entry"))


@query("j30_iso_to_unix", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE epoch(date_trunc('second', ts))::BIGINT END AS unix FROM events")
def iso(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return table(spark, sf, "events").select("event_id", F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))), F.lit(0)).cast("long").alias("unix"))


@query("j53_user_prompt", "SELECT p_partkey, 'Length 00:' || printf('%02d', p_size) || '. Hotwords: ' || p_name || ', ' || p_brand || '.' AS prompt FROM part")
def prompt(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("Length "), T.clock(F.col("p_size").cast("double")), F.lit(". Hotwords: "), F.concat_ws(", ", "p_name", "p_brand"), F.lit("."))
    return table(spark, sf, "part").select("p_partkey", text.alias("prompt"))


@query(
    "o10_name_to_title_search",
    """WITH d AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part), st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
    p AS (SELECT p_partkey, term, len(any_value(w)) AS l, count(*) AS tf FROM (SELECT p_partkey, w, unnest(w) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term), q AS (SELECT DISTINCT p_name AS title, unnest(string_split(lower(p_name), ' ')) AS term FROM part),
    s AS (SELECT title, p_partkey, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 4) AS score FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY ALL)
    SELECT title, (length(title) % 12 + 1)::INT AS episode, p_partkey, score, row_number() OVER (PARTITION BY title ORDER BY score DESC, p_partkey)::INT AS place FROM s QUALIFY place <= 10""",
)
def name_to_title(spark: SparkSession, sf: str) -> DataFrame:
    """File names give a title and an episode; each title's ten best parts by relevance, all titles at once."""
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    number = F.lpad((F.char_length("p_name") % 12 + 1).cast("string"), 2, "0")
    parsed = part.select(F.concat(F.lit("[Group] "), "p_name", F.lit(" - "), number, F.lit(" [720p].srt")).alias("name")).distinct().select(release_names.parsed_name(F.col("name")).alias("p"))
    asked = parsed.select(F.col("p.title").alias("title"), F.get("p.episodes", 0).alias("episode"))
    wanted = asked.select(F.col("title").alias("query_id"), F.explode(S.tokens(F.col("title"))).alias("term"))
    scores = S.bm25_bulk(S.postings(part, "p_partkey", F.col("p_name")), part, "p_partkey", F.col("p_name"), wanted).withColumn("score", F.round("score", 4))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "p_partkey")
    top = scores.withColumn("place", F.row_number().over(best)).where("place <= 10")
    return top.join(asked, top["query_id"] == asked["title"]).select("title", "episode", "p_partkey", "score", "place")


@query("o09_batch_token_statistics", "SELECT role, sum(tokens)::BIGINT AS total, ceil(quantile_cont(tokens, 0.95))::BIGINT AS p95 FROM (SELECT role, (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 4)) END)::BIGINT AS tokens FROM conversations) GROUP BY role")
def batch_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Requests as JSON lines are parsed, their tokens estimated and summed."""
    line = F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")))
    m = table(spark, sf, "conversations").select(F.explode(F.from_json(line, "messages array<struct<role:string,content:string>>")["messages"]).alias("m"))
    t = m.select("m.role", T.token_estimate(F.col("m.content")).alias("tokens"))
    return t.groupBy("role").agg(F.sum("tokens").alias("total"), F.ceil(F.percentile("tokens", 0.95)).cast("long").alias("p95"))


@query(
    "o02_reconstruct_pipeline",
    f"""WITH {_CUES}, man AS (SELECT conv_id, i // 2 AS w, list(turn ORDER BY i) AS t FROM n GROUP BY conv_id, i // 2),
    res AS (SELECT conv_id, w FROM man WHERE (conv_id + w) % 9 <> 4), bad AS (SELECT DISTINCT conv_id FROM man ANTI JOIN res USING (conv_id, w))
    SELECT conv_id, count(*) AS cues, md5(string_agg(CASE WHEN turn % 3 = 1 THEN text || '!' ELSE text END, chr(10) ORDER BY turn)) AS digest FROM c WHERE conv_id NOT IN (SELECT conv_id FROM bad) AND turn % 3 <> 2 GROUP BY conv_id""",
)
def reconstruct(spark: SparkSession, sf: str) -> DataFrame:
    """Windows, results, completeness, gate, decisions and text, end to end."""
    c = _cues(spark, sf)
    w = C.context_windows(c, "conv_id", "turn", F.col("turn"), 2, 1).select("conv_id", "window", (F.col("conv_id") * 1000 + F.col("window")).alias("custom_id"))
    results = w.where("(conv_id + window) % 9 <> 4").select("custom_id", F.lit(0).alias("pos"))
    matched, _ = C.match_results(results, w, "custom_id")
    good, _ = C.first_wins(matched, ["custom_id"], "pos")
    blocked = C.blocked_sources(C.missing_results(w, good, "custom_id").join(w, "custom_id"), "conv_id", ["missing_result"])
    k = F.col("turn") % 3
    d = c.select("conv_id", "turn", F.when(k == 1, "edit").when(k == 2, "remove").otherwise("asis").alias("decision"), F.concat("text", F.lit("!")).alias("new_text"))
    kept = C.apply_decisions(C.gate(c, blocked, "conv_id"), d, ["conv_id", "turn"], "text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("cues"), F.md5(text).alias("digest"))


@query("b27_stable_json", """SELECT l_orderkey, l_linenumber, '{"id":' || l_partkey || ',"flag":"' || l_returnflag || '","none":null}' AS record FROM lineitem""")
def stable_json(spark: SparkSession, sf: str) -> DataFrame:
    s = F.to_json(F.struct(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("flag"), F.lit(None).cast("string").alias("none")), {"ignoreNullFields": "false"})
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", s.alias("record"))


@query("c31_replace_text_keep_timing", "SELECT event_id, value AS start_s, upper(event_type) AS text FROM events")
def replace_text(spark: SparkSession, sf: str) -> DataFrame:
    cue = F.struct(F.col("value").alias("start_s"), F.col("event_type").alias("text"))
    new = cue.withField("text", F.upper("event_type"))
    return table(spark, sf, "events").select("event_id", new.alias("c")).select("event_id", "c.start_s", "c.text")


@query("c19_reader_lanes", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (o_orderstatus = 'F') AS media, count(*) FILTER (o_orderstatus <> 'F') AS subtitles FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'F') > 0")
def lanes(spark: SparkSession, sf: str) -> DataFrame:
    lane = F.sort_array(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))))
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(lane.alias("l"), F.count_if(F.col("o_orderstatus") != "F").alias("subtitles")).where(F.size("l") > 0)
    return g.select("o_custkey", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("media"), "subtitles")


@query("a27_sorted_key_values", "SELECT n_name AS key, n_regionkey::VARCHAR AS value, row_number() OVER (ORDER BY n_name) AS place FROM nation")
def key_values(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return n.withColumn("place", F.row_number().over(Window.orderBy("key")).cast("long"))


@query("k05_subchunk_bounds", "SELECT event_id, greatest(10e0, value - 5e0) AS start, least(200e0, value + 5e0) AS \"end\" FROM events WHERE greatest(10e0, value - 5e0) < least(200e0, value + 5e0)")
def subchunks(spark: SparkSession, sf: str) -> DataFrame:
    s, e = F.greatest(F.lit(10.0), F.col("value") - 5), F.least(F.lit(200.0), F.col("value") + 5)
    return table(spark, sf, "events").select("event_id", s.alias("start"), e.alias("end")).where(F.col("start") < F.col("end"))


@query("d19_cache_point_lookup", "SELECT c_custkey, c_custkey % 5 > 2 AS fresh FROM customer WHERE c_custkey IN (3, 4, 10)")
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    from subtide.operators.upkeep import fresh

    c = table(spark, sf, "customer").where(F.col("c_custkey").isin(3, 4, 10))
    return c.select("c_custkey", fresh(F.col("c_custkey") % 5, F.lit(2)).alias("fresh"))
