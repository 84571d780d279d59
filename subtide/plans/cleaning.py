"""Cleaning queries: a conversation is a source and its turns are cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.operators import cleaning as C
from subtide.plans.registry import query
from subtide.session import table

_CUES = "c AS (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY conv_id, turn)"


def cues(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))


def _ids(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


_WINDOWS = f"""{_CUES}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS total FROM c),
w AS (SELECT DISTINCT conv_id, i // 2 AS win FROM n)"""
_JOINED = "coalesce((SELECT string_agg(turn::VARCHAR, ',' ORDER BY i) FROM n WHERE n.conv_id = w.conv_id AND i >= {a} AND i < {b}), '')"


@query(
    "g01_context_windows",
    f"WITH {_WINDOWS} SELECT conv_id, win AS \"window\", {_JOINED.format(a='win * 2', b='win * 2 + 2')} AS active, {_JOINED.format(a='win * 2 - 3', b='win * 2')} AS before, {_JOINED.format(a='win * 2 + 2', b='win * 2 + 5')} AS after FROM w",
)
def context_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = C.context_windows(cues(spark, sf), "conv_id", "turn", F.col("turn"), 2, 3)
    return w.select("conv_id", "window", _ids("active").alias("active"), _ids("before").alias("before"), _ids("after").alias("after"))


@query(
    "b19_greedy_shards",
    """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE n_chars <= 20000),
       f AS (SELECT source, doc_id, i, 0::BIGINT AS shard, 1::BIGINT AS n, n_chars AS total FROM d WHERE i = 1
             UNION ALL SELECT d.source, d.doc_id, d.i, CASE WHEN f.n < 7 AND f.total + d.n_chars <= 20000 THEN f.shard ELSE f.shard + 1 END,
                              CASE WHEN f.n < 7 AND f.total + d.n_chars <= 20000 THEN f.n + 1 ELSE 1 END, CASE WHEN f.n < 7 AND f.total + d.n_chars <= 20000 THEN f.total + d.n_chars ELSE d.n_chars END
             FROM f JOIN d ON d.source = f.source AND d.i = f.i + 1)
       SELECT source, doc_id, shard FROM f UNION ALL SELECT source, doc_id, NULL FROM documents WHERE n_chars > 20000""",
)
def shards(spark: SparkSession, sf: str) -> DataFrame:
    return C.greedy_shards(table(spark, sf, "documents"), "source", "doc_id", F.col("n_chars"), 7, 20000)


@query("b20_shard_summary", "SELECT lang, source, count(*) AS items, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY ALL")
def shard_summary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("items"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


_RESULTS = f"""{_CUES}, man AS (SELECT conv_id * 100 + turn AS custom_id, conv_id, turn FROM c),
res AS (SELECT custom_id, turn AS pos FROM man WHERE turn % 5 <> 3 UNION ALL SELECT custom_id, turn + 1000 FROM man WHERE turn % 4 = 1 AND turn % 5 <> 3 UNION ALL SELECT -1 - conv_id, 0 FROM c WHERE conv_id % 20 = 0 AND turn = 0)"""


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    return cues(spark, sf).select((F.col("conv_id") * 100 + F.col("turn")).alias("custom_id"), "conv_id", "turn")


def results(spark: SparkSession, sf: str) -> DataFrame:
    m = manifests(spark, sf)
    some = m.where("turn % 5 <> 3")
    return (
        some.select("custom_id", F.col("turn").alias("pos"))
        .unionByName(some.where("turn % 4 = 1").select("custom_id", (F.col("turn") + 1000).alias("pos")))
        .unionByName(m.where("conv_id % 20 = 0 AND turn = 0").select((-1 - F.col("conv_id")).alias("custom_id"), F.lit(0).cast("long").alias("pos")))
    )


@query("e07_unknown_results", f"WITH {_RESULTS} SELECT custom_id, 'unknown_custom_id' AS error_kind FROM res WHERE custom_id NOT IN (SELECT custom_id FROM man)")
def unknown(spark: SparkSession, sf: str) -> DataFrame:
    return C.match_results(results(spark, sf), manifests(spark, sf), "custom_id")[1]


@query("e08_missing_results", f"WITH {_RESULTS} SELECT custom_id, 'missing_result' AS error_kind FROM man WHERE custom_id NOT IN (SELECT custom_id FROM res)")
def missing(spark: SparkSession, sf: str) -> DataFrame:
    return C.missing_results(manifests(spark, sf), results(spark, sf), "custom_id")


@query("g16_first_result_wins", f"WITH {_RESULTS} SELECT custom_id, pos, row_number() OVER (PARTITION BY custom_id ORDER BY pos) > 1 AS duplicate FROM res")
def first_result(spark: SparkSession, sf: str) -> DataFrame:
    first, later = C.first_wins(results(spark, sf), ["custom_id"], "pos")
    return first.withColumn("duplicate", F.lit(False)).unionByName(later.withColumn("duplicate", F.lit(True)))


@query(
    "l07_source_gate",
    f"""WITH {_RESULTS}, bad AS (SELECT DISTINCT conv_id FROM man WHERE custom_id NOT IN (SELECT custom_id FROM res)
        UNION SELECT conv_id FROM man JOIN res USING (custom_id) GROUP BY conv_id, custom_id HAVING count(*) > 1)
        SELECT conv_id, count(*) AS cues FROM man WHERE conv_id NOT IN (SELECT conv_id FROM bad) GROUP BY conv_id""",
)
def source_gate(spark: SparkSession, sf: str) -> DataFrame:
    m, r = manifests(spark, sf), results(spark, sf)
    matched, _ = C.match_results(r, m, "custom_id")
    good, late = C.first_wins(matched, ["custom_id"], "pos")
    errors = C.missing_results(m, good, "custom_id").unionByName(late.select("custom_id", F.lit("duplicate_result").alias("error_kind")))
    blocked = C.blocked_sources(errors.join(m, "custom_id"), "conv_id", ["missing_result", "duplicate_result"])
    return C.gate(m, blocked, "conv_id").groupBy("conv_id").agg(F.count(F.lit(1)).alias("cues"))


@query(
    "l03_result_taxonomy",
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unknown_custom_id' WHEN event_id % 10 = 1 THEN 'auth_error' WHEN event_id % 10 IN (2, 3) THEN 'api_error'
       WHEN event_id % 7 = 0 THEN 'missing_response' WHEN event_id % 7 = 1 THEN 'schema_error' END AS error_kind,
       event_id % 10 IN (0, 2, 3) AS retryable FROM events""",
)
def taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    status = F.when(k % 10 == 1, 401).when(k % 10 == 2, 429).when(k % 10 == 3, 503).when(k % 10 == 0, F.lit(None)).otherwise(200)
    content = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, F.lit("{}")).otherwise(F.lit('{"decisions": []}'))
    kind = C.result_error(k % 11 != 0, status, F.lit(None).cast("string"), content)
    return table(spark, sf, "events").select("event_id", kind.alias("error_kind"), C.retryable(status).alias("retryable"))


_FAULTS = """w AS (SELECT o_custkey AS win, (o_custkey % 4 + 1) AS n, list((o_orderkey % 6)::INT ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey)"""


@query(
    "l06_decision_faults",
    f"""WITH {_FAULTS}, e AS (SELECT win, n, unnest(ids) AS id FROM w)
        SELECT win, 'id_mismatch' AS error_kind, id FROM e WHERE id < 1 OR id > n
        UNION ALL SELECT win, 'duplicate_decision', id FROM e GROUP BY win, id HAVING count(*) > 1
        UNION ALL SELECT win, 'missing_decision', k FROM (SELECT win, ids, unnest(range(1, n + 1))::INT AS k FROM w) WHERE NOT list_contains(ids, k)""",
)
def faults(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("win")).agg(
        F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: (x % 6).cast("int")).alias("ids"))
    return C.decision_faults(o.withColumn("n", F.col("win") % 4 + 1), "win", "n", "ids")


@query(
    "e10_apply_decisions",
    f"""WITH {_CUES}, d AS (SELECT *, CASE turn % 4 WHEN 1 THEN 'edit' WHEN 2 THEN 'remove' WHEN 3 THEN 'asis' END AS decision FROM c),
        k AS (SELECT conv_id, turn, decision IS NOT DISTINCT FROM 'edit' AS changed, CASE WHEN decision = 'edit' THEN '+' || text ELSE text END AS text FROM d WHERE decision IS DISTINCT FROM 'remove')
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, changed, md5(text) AS digest FROM k""",
)
def decisions(spark: SparkSession, sf: str) -> DataFrame:
    c = cues(spark, sf).drop("role")
    t = F.col("turn") % 4
    d = c.where("turn % 4 <> 0").select("conv_id", "turn", F.when(t == 1, "edit").when(t == 2, "remove").otherwise("asis").alias("decision"), F.concat(F.lit("+"), "text").alias("new_text"))
    kept = C.renumber(C.apply_decisions(c, d, ["conv_id", "turn"], "text"), "conv_id", "turn")
    return kept.select("conv_id", F.col("number").cast("long").alias("number"), "changed", F.md5("text").alias("digest"))


@query(
    "b23_srt_documents",
    f"""WITH {_CUES}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM c)
        SELECT conv_id, md5(string_agg(k || chr(10) || printf('00:00:%02d,000 --> 00:00:%02d,500', k * 2, k * 2) || chr(10) || text, chr(10) || chr(10) ORDER BY k) || chr(10)) AS digest FROM n GROUP BY conv_id""",
)
def srt_documents(spark: SparkSession, sf: str) -> DataFrame:
    n = C.renumber(cues(spark, sf), "conv_id", "turn")
    at = F.col("number") * 2.0
    return C.srt_documents(n, "conv_id", "number", at, at + 0.5, "text").select("conv_id", F.md5("document").alias("digest"))


@query(
    "g15_cross_window_first_wins",
    f"WITH {_CUES} SELECT conv_id, count(*) FILTER (rn = 1) AS kept, count(*) FILTER (rn > 1) AS overlapping FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id, turn // 3 ORDER BY turn) AS rn FROM c) GROUP BY conv_id",
)
def cross_window(spark: SparkSession, sf: str) -> DataFrame:
    c = cues(spark, sf).withColumn("index", F.expr("turn div 3"))
    first, late = C.first_wins(c, ["conv_id", "index"], "turn")
    both = first.withColumn("k", F.lit(1)).unionByName(late.withColumn("k", F.lit(2)))
    return both.groupBy("conv_id").agg(F.count_if(F.col("k") == 1).alias("kept"), F.count_if(F.col("k") == 2).alias("overlapping"))
