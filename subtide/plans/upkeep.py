"""Upkeep queries: two slices of a table stand for an old and a new state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.operators import upkeep as U
from subtide.plans.registry import query
from subtide.session import table

_OLD = "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0"
_NEW = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 6 <> 0"


def states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    changed = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return o.where("o_orderkey % 5 <> 0"), o.where("o_orderkey % 6 <> 0").withColumn("o_totalprice", changed)


@query(
    "m04_incremental_diff",
    f"""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed'
        WHEN a.o_totalprice = b.o_totalprice THEN 'unchanged' ELSE 'refreshed' END AS change FROM ({_OLD}) a FULL JOIN ({_NEW}) b USING (o_orderkey)""",
)
def diff(spark: SparkSession, sf: str) -> DataFrame:
    return U.diff_listing(*states(spark, sf), "o_orderkey", ["o_totalprice", "o_orderstatus"])


@query("i02_removed_keys", f"SELECT o_orderkey FROM ({_OLD}) EXCEPT SELECT o_orderkey FROM ({_NEW})")
def removed(spark: SparkSession, sf: str) -> DataFrame:
    old, new = states(spark, sf)
    return old.select("o_orderkey").subtract(new.select("o_orderkey"))


@query("b04_upsert", f"SELECT * FROM ({_OLD}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_NEW})) UNION ALL SELECT * FROM ({_NEW})")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    old, new = states(spark, sf)
    return U.upsert(old, new, ["o_orderkey"])


@query("b05_negative_entries", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN '{}' ELSE c_name END AS payload, c_custkey % 9 = 0 AS negative FROM customer")
def negative(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("payload"), F.lit(False).alias("negative"))
    n = c.where("c_custkey % 9 = 0").select("c_custkey", F.lit("{}").alias("payload"), F.lit(True).alias("negative"))
    return U.upsert(c, n, ["c_custkey"])


@query("b06_patch_one_column", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'failed' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def patch(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return U.patch(c, c.where("c_custkey % 4 = 0").withColumn("c_mktsegment", F.lit("failed")), ["c_custkey"], "c_mktsegment")


@query("b15_cascade_delete", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 4)")
def cascade(spark: SparkSession, sf: str) -> DataFrame:
    parents = table(spark, sf, "customer").where("c_nationkey <> 4").select(F.col("c_custkey").alias("o_custkey"))
    return U.cascade(table(spark, sf, "orders"), parents, "o_custkey").select("o_orderkey")


@query("b17_counter_increments", "SELECT c_nationkey AS k, (sum(c_custkey) + count(*))::BIGINT AS v FROM customer GROUP BY c_nationkey")
def increments(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return U.increments(c.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("v")), c.select(F.col("c_nationkey").alias("k"), F.lit(1).cast("long").alias("v")), "k", "v")


@query("b17_last_value_put", "SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_type)) AS event_type FROM events GROUP BY user_id")
def last_value(spark: SparkSession, sf: str) -> DataFrame:
    return U.latest(table(spark, sf, "events"), "user_id", "event_type", "ts")


@query("b08_source_overrides", f"SELECT * FROM ({_NEW}) UNION ALL SELECT * FROM ({_OLD}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_NEW}))")
def overrides(spark: SparkSession, sf: str) -> DataFrame:
    old, new = states(spark, sf)
    return U.override(old, new, ["o_orderkey"])


@query("i03_error_rows_override", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'error' ELSE 'series' END AS kind FROM documents")
def error_override(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.lit("series").alias("kind"))
    bad = table(spark, sf, "labels").where("quality = 0").select("doc_id").distinct().join(d.select("doc_id"), "doc_id", "left_semi").withColumn("kind", F.lit("error"))
    return U.override(d, bad, ["doc_id"])


@query("i07_first_path_wins", "SELECT p_partkey, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) > 1 AS duplicate FROM part")
def first_path(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("id", F.concat_ws("|", "p_name", "p_brand"))
    return U.first_path_wins(p, "id", "p_partkey").select("p_partkey", "duplicate")


_NOW = 1000 * 86400


@query(
    "d07_ttl_freshness",
    f"""SELECT o_orderkey, ttl, t + ttl > {_NOW} AS fresh FROM (SELECT o_orderkey, CASE WHEN upper(trim(CASE o_orderstatus WHEN 'F' THEN ' finished ' ELSE o_orderstatus END)) = 'FINISHED' THEN 2592000 ELSE 604800 END AS ttl,
        ({_NOW} - (o_orderkey % 40) * 86400)::BIGINT AS t FROM orders)""",
)
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", " finished ").otherwise(F.col("o_orderstatus"))
    ttl = U.lifetime(status)
    t = F.lit(_NOW) - (F.col("o_orderkey") % 40) * 86400
    return table(spark, sf, "orders").select("o_orderkey", ttl.alias("ttl"), U.fresh(t + ttl, F.lit(_NOW)).alias("fresh"))


@query(
    "m07_read_through_cache",
    """SELECT d.doc_id, CASE WHEN hit AND fresh AND neg THEN 'negative' WHEN hit AND fresh THEN 'fresh' WHEN doc_id % 5 < 3 THEN 'fetched' WHEN hit AND NOT neg THEN 'stale' ELSE 'miss' END AS outcome
       FROM (SELECT doc_id, doc_id % 3 > 0 AS hit, doc_id % 7 > 3 AS fresh, doc_id % 11 = 0 AS neg FROM documents) d""",
)
def cache(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    stored = table(spark, sf, "documents").where(k % 3 > 0).select(k.alias("_k"), (k % 7 > 3).alias("fresh"), (k % 11 == 0).alias("neg"))
    j = table(spark, sf, "documents").join(stored, k == F.col("_k"), "left")
    hit = F.col("_k").isNotNull()
    return j.select("doc_id", U.cache_outcome(hit, F.coalesce("fresh", F.lit(False)), F.coalesce("neg", F.lit(False)), k % 5 < 3).alias("outcome"))


@query("d15_resume_by_fingerprint", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_orderkey % 3 = 0 AND l_quantity < 40)")
def resume(spark: SparkSession, sf: str) -> DataFrame:
    work = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.when(F.col("l_tax") > 0.04, "x").alias("profile"))
    done = work.where("l_orderkey % 3 = 0 AND l_quantity < 40")
    left = U.resume(work, done, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "profile"])
    return left.select("l_orderkey", "l_linenumber")


@query("l12_health_state", "SELECT event_type, CASE WHEN max(epoch(ts)) < 1706745600 - 86400 THEN 'stale' WHEN count(*) FILTER (value > 200) > 3 THEN 'degraded' ELSE 'ok' END AS state FROM events GROUP BY event_type")
def health(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1e6")
    a = table(spark, sf, "events").groupBy("event_type").agg(F.max(seconds).alias("last"), F.count_if(F.col("value") > 200).alias("bad"))
    return a.select("event_type", F.when(F.col("last") < 1706745600 - 86400, "stale").when(F.col("bad") > 3, "degraded").otherwise("ok").alias("state"))


@query("m10_coalesced_requests", "SELECT user_id, count(*) AS waiting FROM events WHERE event_type = 'click' GROUP BY user_id")
def coalesced(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("event_type = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("waiting"))


@query("m18_neighbour_prefetch", "SELECT DISTINCT l_orderkey, n FROM (SELECT l_orderkey, unnest([l_linenumber - 1, l_linenumber + 1])::INT AS n FROM lineitem) WHERE n > 0")
def prefetch(spark: SparkSession, sf: str) -> DataFrame:
    n = F.explode(F.array(F.col("l_linenumber") - 1, F.col("l_linenumber") + 1)).alias("n")
    return table(spark, sf, "lineitem").select("l_orderkey", n).where("n > 0").distinct()
