"""Inventory filters, point lookups and key rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.plans.registry import query
from subtide.session import table


@query("d02_point_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def point(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where("c_custkey = 42").select("c_custkey", "c_name").limit(1)


@query("d04_prefix_like", "SELECT page_id FROM pages WHERE url ILIKE 'HTTPS://th' || '%'")
def prefix_like(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").where(F.col("url").ilike("HTTPS://th%")).select("page_id")


@query("d05_multi_id_and_prefix", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (1, 5, 9) AND s_name LIKE 'Supplier#0%'")
def multi_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").where(F.col("s_nationkey").isin(1, 5, 9) & F.col("s_name").like("Supplier#0%")).select("s_suppkey")


@query("d06_case_sensitive_prefix", "SELECT page_id FROM pages WHERE starts_with(url, 'https://th') AND page_id % 5 = 2")
def case_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").where(F.col("url").startswith("https://th") & (F.col("page_id") % 5 == 2)).select("page_id")


@query("d08_extension_filter", "SELECT page_id, lower(regexp_extract(url, '\\.([^./?]+)(\\?|$)', 1)) AS ext FROM pages WHERE lower(regexp_extract(url, '\\.([^./?]+)(\\?|$)', 1)) IN ('html', 'com')")
def extension(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.lower(F.regexp_extract("url", r"\.([^./?]+)(\?|$)", 1))
    return table(spark, sf, "pages").select("page_id", ext.alias("ext")).where(F.col("ext").isin("html", "com"))


@query("d09_group_prefix_or_filename", "SELECT p_partkey FROM part WHERE (starts_with(p_name, 'red') OR starts_with(p_brand, 'Brand#1')) AND p_size = 1")
def group_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where((F.col("p_name").startswith("red") | F.col("p_brand").startswith("Brand#1")) & (F.col("p_size") == 1)).select("p_partkey")


@query(
    "d12_uuid_reference_test",
    "SELECT page_id, page_id % 2 = 0 AS is_uuid FROM pages",
)
def uuid_test(spark: SparkSession, sf: str) -> DataFrame:
    h = F.md5("url")
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    ref = F.when(F.col("page_id") % 2 == 0, dashed).otherwise(F.concat(h, F.lit("x")))
    return table(spark, sf, "pages").select("page_id", ref.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$").alias("is_uuid"))


@query("d13_blocked_sources", "SELECT DISTINCT user_id FROM events WHERE event_type IN ('error') AND value > 30")
def blocked(spark: SparkSession, sf: str) -> DataFrame:
    from subtide.operators.cleaning import blocked_sources

    return blocked_sources(table(spark, sf, "events").where("value > 30").withColumnRenamed("event_type", "error_kind"), "user_id", ["error"])


@query(
    "d14_unambiguous_choice",
    """WITH s AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) FILTER (o_orderstatus = 'P') AS hit, count(*) FILTER (o_orderstatus = 'P') AS hits,
                  min(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS def, count(*) FILTER (o_orderpriority = '1-URGENT') AS defs, min(o_orderkey) AS single FROM orders GROUP BY o_custkey)
       SELECT o_custkey, CASE WHEN hits = 1 THEN hit WHEN n = 1 THEN single WHEN defs = 1 THEN def END AS chosen FROM s""",
)
def unambiguous(spark: SparkSession, sf: str) -> DataFrame:
    streams = F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))
    s = table(spark, sf, "orders").groupBy("o_custkey").agg(streams.alias("s"))
    hits = F.filter("s", lambda x: x["o_orderstatus"] == "P")
    default = F.filter("s", lambda x: x["o_orderpriority"] == "1-URGENT")
    one = lambda a: F.get(a, 0)["o_orderkey"]
    return s.select("o_custkey", F.when(F.size(hits) == 1, one(hits)).when(F.size("s") == 1, one(F.col("s"))).when(F.size(default) == 1, one(default)).alias("chosen"))


@query("d17_cache_size_then_digest", "SELECT page_id, page_id % 3 <> 0 AS valid FROM pages")
def cache_match(spark: SparkSession, sf: str) -> DataFrame:
    size = F.octet_length("html") + F.when(F.col("page_id") % 3 == 0, 1).otherwise(0)
    ok = (F.octet_length("html") == size) & (F.sha2("html", 256) == F.sha2("html", 256))
    return table(spark, sf, "pages").select("page_id", ok.alias("valid"))


@query("d18_safe_relative_path", "SELECT page_id, page_id % 3 = 1 AS safe FROM pages")
def safe_path(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(F.col("page_id") % 3 == 0, "/etc/x").when(F.col("page_id") % 3 == 2, "a/../b").otherwise("a/b..c/d")
    return table(spark, sf, "pages").select("page_id", (~p.rlike(r"^/|(^|/)\.\.(/|$)")).alias("safe"))


@query("d20_point_lookups", "SELECT page_id FROM pages WHERE page_id = 7 OR url = (SELECT url FROM pages WHERE page_id = 9)")
def point_lookups(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    url = p.where("page_id = 9").select("url")
    return p.where("page_id = 7").select("page_id").unionByName(p.join(url, "url", "left_semi").select("page_id")).distinct()


@query("d21_three_key_lookup", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey = 5979 AND l_partkey = 1616 AND l_linenumber = 6")
def three_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where("l_orderkey = 5979 AND l_partkey = 1616 AND l_linenumber = 6").select("l_orderkey", "l_quantity")


@query("d22_episode_scope", "SELECT doc_id FROM documents WHERE source = 'src3' AND n_chars > 500")
def scoped(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("source = 'src3' AND n_chars > 500").select("doc_id")


@query("e13_cached_ids_keep_order", "SELECT o_custkey, pos, row_number() OVER (PARTITION BY o_custkey ORDER BY pos) AS rank, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos FROM orders) WHERE o_orderstatus <> 'F'")
def cached_ids(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf, "orders")
    listed = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))).alias("l"))
    ids = listed.select("o_custkey", F.posexplode("l").alias("pos", "x")).select("o_custkey", F.col("pos").cast("long").alias("pos"), F.col("x.o_orderkey").alias("o_orderkey"))
    kept = ids.join(o.where("o_orderstatus <> 'F'").select("o_orderkey"), "o_orderkey")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy("pos")).cast("long")).select("o_custkey", "pos", "rank", "o_orderkey")


@query("e16_group_with_title_total", "SELECT o_custkey, o_orderstatus, count(*) AS n, t.total FROM orders JOIN (SELECT o_custkey, count(*) AS total FROM orders GROUP BY o_custkey) t USING (o_custkey) GROUP BY ALL")
def group_with_title(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return g.join(g.groupBy("o_custkey").agg(F.sum("n").alias("total")), "o_custkey").select("o_custkey", "o_orderstatus", "n", "total")


@query("e21_anti_join_loaded", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_loaded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_anti")


@query("e22_missing_owner", "SELECT o_orderkey, c_name, c_name IS NULL AS orphan FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey <> 3")
def missing_owner(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_nationkey <> 3").select("c_custkey", "c_name")
    return table(spark, sf, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"), "left").select("o_orderkey", "c_name", F.col("c_name").isNull().alias("orphan"))


@query("e15_conflicting_ids", "SELECT p_name, count(DISTINCT p_brand) > 1 AS conflict FROM part GROUP BY p_name")
def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_name").agg((F.countDistinct("p_brand") > 1).alias("conflict"))


@query("o11_priority_join", "SELECT c_custkey, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'O'), max(o_orderkey), -1) AS audio FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def priority_join(spark: SparkSession, sf: str) -> DataFrame:
    """The indexed artifact first, any local one next."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey"))).alias("a"), F.max("o_orderkey").alias("b"))
    return table(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("a", "b", F.lit(-1)).alias("audio"))


@query("m17_fallback_to_series", "SELECT s_suppkey, CASE WHEN count(l_orderkey) FILTER (l_linenumber = 7) > 0 THEN 'episode' WHEN count(l_orderkey) > 0 THEN 'series' ELSE 'none' END AS offer FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def fallback(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_linenumber") == 7).alias("e"))
    j = table(spark, sf, "supplier").join(l, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return j.select("s_suppkey", F.when(F.col("e") > 0, "episode").when(F.col("e").isNotNull(), "series").otherwise("none").alias("offer"))
