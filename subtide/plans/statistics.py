"""Aggregation, coverage, ordering and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subtide.functions.text import span_list
from subtide.operators import coverage as V
from subtide.operators.intervals import consecutive_runs
from subtide.operators.ranking import joined_segments, places
from subtide.plans.registry import query
from subtide.session import table

_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


@query("f01_count", "SELECT count(*) AS n FROM lineitem")
def count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("f02_distinct_per_series", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS episodes, count(*) AS artifacts FROM orders GROUP BY o_custkey")
def distinct_per_series(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("episodes"), F.count(F.lit(1)).alias("artifacts"))


@query("f03_filtered_counts", "SELECT event_type, count(*) AS n, count(*) FILTER (value <= 20) AS expired, count(*) FILTER (event_id % 7 = 0) AS negative FROM events GROUP BY event_type")
def filtered_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") <= 20).alias("expired"), F.count_if(F.col("event_id") % 7 == 0).alias("negative"))


@query("f15_hit_ratio", "SELECT user_id, round(coalesce(count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type <> 'error'), 0), 0), 4) AS hit_rate FROM events GROUP BY user_id")
def hit_ratio(spark: SparkSession, sf: str) -> DataFrame:
    r = F.try_divide(F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type") != "error"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.coalesce(r, F.lit(0.0)), 4).alias("hit_rate"))


_COV = """e AS (SELECT user_id AS title, event_type AS grp, (epoch_us(ts) // 86400000000 - 19722)::INT AS ep, event_id, props FROM events),
t AS (SELECT title, count(*) AS rows, count(ep) AS parsed, list_sort(list(DISTINCT ep)) AS eps FROM e GROUP BY title),
g AS (SELECT title, grp, count(*) AS rows, list_sort(list(DISTINCT ep)) AS eps FROM e GROUP BY title, grp)"""


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("title"), F.col("event_type").alias("grp"), F.expr(f"cast({_US} div 86400000000 - 19722 AS INT)").alias("ep"), "event_id", "props")


def _list(c: object) -> object:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("f08_title_coverage", f"WITH {_COV} SELECT title, rows, parsed, array_to_string(eps, ',') AS episodes FROM t")
def title_coverage(spark: SparkSession, sf: str) -> DataFrame:
    t = V.title_coverage(episodes(spark, sf), "title", "ep", "props", "event_id")
    return t.select("title", "rows", "parsed", _list("episodes").alias("episodes"))


@query(
    "f09_group_coverage_examples",
    f"""WITH {_COV} SELECT g.title, g.grp, g.rows, array_to_string(eps, ',') AS episodes,
        (SELECT string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FROM (SELECT event_id FROM e WHERE e.title = g.title AND e.grp = g.grp ORDER BY event_id LIMIT 5)) AS examples FROM g""",
)
def group_coverage(spark: SparkSession, sf: str) -> DataFrame:
    g = V.group_coverage(episodes(spark, sf), "title", "grp", "ep", "event_id", "event_id")
    return g.select("title", "grp", "rows", _list("episodes").alias("episodes"), _list("examples").alias("examples"))


@query(
    "l02_coverage_class",
    f"""WITH {_COV}, j AS (SELECT g.title, g.grp, g.eps AS a, t.eps AS b, len(list_intersect(g.eps, t.eps)) / len(t.eps) AS r FROM g JOIN t USING (title))
        SELECT title, grp, round(r, 3) AS ratio, CASE WHEN r >= 0.35 THEN 'probably_complete'
          WHEN list_min(a) <= list_min(b) + 1 AND list_max(a) <= list_max(b) - greatest(3, round_even(len(b) * 0.15, 0)::INT) AND len(a) >= 3 THEN 'possible_gave_up'
          WHEN len(a) >= 3 THEN 'partial_or_alt_span' ELSE 'one_off' END AS class FROM j""",
)
def coverage_class(spark: SparkSession, sf: str) -> DataFrame:
    e = episodes(spark, sf)
    g = V.group_coverage(e, "title", "grp", "ep", "event_id", "event_id").select("title", "grp", F.col("episodes").alias("a"))
    t = V.title_coverage(e, "title", "ep", "props", "event_id").select("title", F.col("episodes").alias("b"))
    j = g.join(t, "title")
    return j.select("title", "grp", F.round(V.coverage_ratio(F.col("a"), F.col("b")), 3).alias("ratio"), V.classify(F.col("a"), F.col("b"), 0.35).alias("class"))


@query("f10_most_common", "SELECT word, n FROM (SELECT p_name AS word, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY p_name) ORDER BY n DESC, f LIMIT 12")
def most_common(spark: SparkSession, sf: str) -> DataFrame:
    return V.most_common(table(spark, sf, "part"), "p_name", "p_partkey", 12).select(F.col("p_name").alias("word"), F.col("count").alias("n"))


@query(
    "f12_language_shares",
    """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)
       SELECT source, lang, round(n / sum(n) OVER (PARTITION BY source), 4) AS share FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) <= 3""",
)
def language_shares(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source")
    r = c.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "lang"))).withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 4))
    return r.where("r <= 3").select("source", "lang", "share")


@query(
    "f13_token_statistics",
    """WITH t AS (SELECT role, greatest(1, ceil(length(text) / 4))::BIGINT AS n, text FROM conversations)
       SELECT role, sum(n)::BIGINT AS total, min(n) AS least, max(n) AS most, ceil(quantile_cont(n, 0.5))::BIGINT AS p50, ceil(quantile_cont(n, 0.95))::BIGINT AS p95, count(DISTINCT md5(text)) AS prompts FROM t GROUP BY role""",
)
def token_statistics(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").select("role", F.greatest(F.lit(1), F.ceil(F.char_length("text") / 4)).alias("n"), F.md5("text").alias("d"))
    p = lambda q: F.ceil(F.percentile("n", q)).cast("long")
    return t.groupBy("role").agg(F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.countDistinct("d").alias("prompts"))


@query("f14_cost_estimate", "SELECT role, round(sum(length(text)) / 4e0 * CASE role WHEN 'user' THEN 0.15e0 WHEN 'assistant' THEN 0.6e0 END / 1e6, 9) AS cost FROM conversations GROUP BY role")
def cost(spark: SparkSession, sf: str) -> DataFrame:
    price = F.when(F.col("role") == "user", 0.15).when(F.col("role") == "assistant", 0.6)
    return table(spark, sf, "conversations").groupBy("role").agg(F.sum(F.char_length("text")).alias("n")).select("role", F.round(F.col("n") / 4 * price / 1e6, 9).alias("cost"))


@query("f18_suggestion_multiplicity", "SELECT event_id, k, k IS NOT NULL AND count(*) OVER (PARTITION BY k) = 1 AS unambiguous FROM (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_id % 9000 END AS k FROM events)")
def multiplicity(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 9000).alias("k"))
    once = e.where("k IS NOT NULL").groupBy("k").agg((F.count(F.lit(1)) == 1).alias("u"))
    return e.join(once, "k", "left").select("event_id", "k", F.coalesce("u", F.lit(False)).alias("unambiguous"))


@query("f19_inventory_counts", "SELECT count(*) AS total, count(*) FILTER (lang = 'en') AS srt, count(*) FILTER (lang <> 'en') AS other FROM documents")
def inventory_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("lang") == "en").alias("srt"), F.count_if(F.col("lang") != "en").alias("other"))


@query("f22_state_snapshot", "SELECT max(n_regionkey) FILTER (n_name = 'NATION_1') AS a, max(n_regionkey) FILTER (n_name = 'NATION_7') AS b, max(n_regionkey) FILTER (n_name = 'NONE') AS c FROM nation")
def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    kv = F.map_from_entries(F.collect_list(F.struct("n_name", "n_regionkey")))
    get = lambda k: F.try_element_at("kv", F.lit(k))
    return table(spark, sf, "nation").agg(kv.alias("kv")).select(get("NATION_1").alias("a"), get("NATION_7").alias("b"), get("NONE").alias("c"))


@query("f23_metric_lines", "SELECT 'events_total' AS metric, event_type AS label, count(*)::DOUBLE AS value FROM events GROUP BY event_type UNION ALL SELECT 'value_max', event_type, max(value) FROM events GROUP BY event_type")
def metric_lines(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "events").groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("events_total"), F.max("value").alias("value_max"))
    return a.unpivot("label", ["events_total", "value_max"], "metric", "value").select("metric", "label", "value")


@query("f24_extension_set", "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS extensions FROM documents GROUP BY source")
def extension_set(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("extensions"))


@query("f25_availability", "SELECT user_id, round(avg((event_type <> 'error')::INT), 6) AS availability FROM events GROUP BY user_id")
def availability(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.avg((F.col("event_type") != "error").cast("int")), 6).alias("availability"))


@query("f26_staleness", "SELECT user_id, 1706745600000000 - max(epoch_us(ts)) AS age FROM events GROUP BY user_id")
def staleness(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg((F.lit(1706745600000000) - F.max(F.expr(_US))).alias("age"))


@query("f06_inventory_snapshot", "SELECT c_custkey, count(o_orderkey) AS artifacts, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), '') AS profiles FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Series with their artifacts, those without included."""
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("p"))
    j = table(spark, sf, "customer").join(per, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("c_custkey", F.coalesce("n", F.lit(0)).alias("artifacts"), F.coalesce("p", F.lit("")).alias("profiles"))


@query("f07_episode_groups", "SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey)::INT AS place, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders")
def episode_groups(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey", "o_orderpriority")
    return table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.row_number().over(w.orderBy("o_orderkey")).alias("place"), F.count(F.lit(1)).over(w).alias("n"))


@query("h02_nulls_last_order", "SELECT doc_id, quality, row_number() OVER (ORDER BY quality ASC NULLS LAST, doc_id) AS place FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)")
def nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table(spark, sf, "documents").join(l, "doc_id", "left").select("doc_id", "quality")
    return places(rows, [F.col("quality").isNull(), F.coalesce("quality", F.lit(0)), F.floor(F.col("doc_id") / 4096)], ["doc_id"])


@query("h03_numeric_then_text_order", "SELECT s_suppkey, row_number() OVER (ORDER BY coalesce(try_cast(regexp_extract(s_name, '([0-9]+)$', 1) AS INT), 0) % 7, s_name) AS place FROM supplier")
def numeric_text(spark: SparkSession, sf: str) -> DataFrame:
    k = F.coalesce(F.regexp_extract("s_name", "([0-9]+)$", 1).try_cast("int"), F.lit(0)) % 7
    return places(table(spark, sf, "supplier").select("s_suppkey", "s_name"), [k], ["s_name"]).select("s_suppkey", "place")


@query("h09_argmax_embedding", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best FROM embeddings")
def argmax(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("best"))


@query("h08_argmin_composite", "SELECT l_partkey, (min(struct_pack(d := abs(l_quantity - 25), l := -l_extendedprice, o := l_orderkey, n := l_linenumber))).o AS best FROM lineitem GROUP BY l_partkey")
def argmin(spark: SparkSession, sf: str) -> DataFrame:
    key = F.struct(F.abs(F.col("l_quantity") - 25).alias("d"), (-F.col("l_extendedprice")).alias("l"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min(key).alias("m")).select("l_partkey", F.col("m.o").alias("best"))


@query("h10_time_ordered_text", "SELECT user_id, block, min(ts) AS first, string_agg(event_type, ' ' ORDER BY ts, event_id) AS text FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 16 AS block FROM events) GROUP BY user_id, block")
def ordered_text(spark: SparkSession, sf: str) -> DataFrame:
    return joined_segments(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", 16).select("user_id", "block", F.col("first.ts").alias("first"), "text")


@query("h06_multi_key_report", "SELECT o_custkey, n, total, row_number() OVER (ORDER BY n DESC, total DESC, o_custkey) AS place FROM (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey)")
def report(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return places(a, [-F.col("n"), -F.floor(F.col("total") / 10_000)], [F.desc("total"), "o_custkey"])


@query("i04_intersection_ratio", f"WITH {_COV} SELECT a.title, a.grp AS one, b.grp AS other, round(len(list_intersect(a.eps, b.eps)) / len(b.eps), 4) AS ratio FROM g a JOIN g b ON a.title = b.title AND a.grp < b.grp")
def intersection(spark: SparkSession, sf: str) -> DataFrame:
    g = V.group_coverage(episodes(spark, sf), "title", "grp", "ep", "event_id", "event_id").select("title", "grp", "episodes")
    b = g.select("title", F.col("grp").alias("other"), F.col("episodes").alias("b"))
    return g.join(b, "title").where("grp < other").select("title", F.col("grp").alias("one"), "other", F.round(V.coverage_ratio(F.col("episodes"), F.col("b")), 4).alias("ratio"))


@query("i05_expected_minus_seen", f"WITH {_COV} SELECT title, coalesce(array_to_string(list_sort(list_filter(range(1, 31), lambda k: NOT list_contains(eps, k::INT))), ','), '') AS missing FROM t")
def expected(spark: SparkSession, sf: str) -> DataFrame:
    t = V.title_coverage(episodes(spark, sf), "title", "ep", "props", "event_id")
    return t.select("title", _list(F.array_except(F.sequence(F.lit(1), F.lit(30)), F.col("episodes"))).alias("missing"))


@query("i06_ordered_distinct", "WITH f AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS kinds FROM f GROUP BY user_id")
def ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    s = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_distinct(F.transform(s, lambda x: x["event_type"])), ",").alias("kinds"))


@query("i10_duplicate_stems", "SELECT p_name AS stem, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_stems(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("stem")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("i11_replace_by_key", "SELECT o_custkey, string_agg(CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey::VARCHAR END, ',' ORDER BY o_orderkey) || ',new' AS entries FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 10 <> 0) > 0")
def replace_by_key(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("e"))
    kept = F.transform(F.filter("e", lambda x: x % 10 != 0), lambda x: x.cast("string"))
    return o.where(F.size(kept) > 0).select("o_custkey", F.array_join(F.array_append(kept, F.lit("new")), ",").alias("entries"))


@query(
    "j44_span_list_rendering",
    f"""WITH {_COV}, r AS (SELECT title, min(ep) AS a, max(ep) AS b FROM (SELECT title, ep, ep - dense_rank() OVER (PARTITION BY title ORDER BY ep) AS k FROM (SELECT DISTINCT title, ep FROM e)) GROUP BY title, k),
        n AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY a) AS i, count(*) OVER (PARTITION BY title) AS c FROM r)
        SELECT title, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) FILTER (i <= 3) || CASE WHEN max(c) > 3 THEN ', +' || (max(c) - 3) || ' more' ELSE '' END AS spans FROM n GROUP BY title""",
)
def span_lists(spark: SparkSession, sf: str) -> DataFrame:
    r = consecutive_runs(episodes(spark, sf), ["title"], "ep")
    per = r.groupBy("title").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("s"))
    return per.select("title", span_list(F.col("s"), 3).alias("spans"))
