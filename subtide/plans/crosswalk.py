"""Crosswalk queries: suppliers and parts stand for titles with ids in several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.operators import crosswalk as X
from subtide.plans.registry import query
from subtide.session import table


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One payload per part: single, listed, missing and blank ids."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        (k + 1).alias("row_id"), k.alias("anidb_id"),
        F.when(k % 3 == 0, F.to_json(F.array(k % 97, k % 89))).otherwise(F.when(k % 3 == 1, (k % 97).cast("string")).otherwise(F.lit(""))).alias("mal_id"),
        F.when(k % 2 == 0, k % 50).alias("tvdb_id"), F.when(k % 5 == 0, k % 40).alias("tmdb_tv"), F.when(k % 7 == 0, k % 40).alias("tmdb_movie"),
        F.when(k % 4 == 0, "movie").otherwise("tv").alias("kind"),
    )


_ROWS = """
p AS (SELECT p_partkey AS k, p_partkey + 1 AS row_id, CASE WHEN p_partkey % 4 = 0 THEN 'movie' ELSE 'tv' END AS kind FROM part),
g AS (SELECT 'anidb' AS source, k::VARCHAR AS external_id, NULL::VARCHAR AS media_kind, row_id FROM p
  UNION ALL SELECT 'mal', unnest([(k % 97)::VARCHAR, (k % 89)::VARCHAR]), NULL, row_id FROM p WHERE k % 3 = 0
  UNION ALL SELECT 'mal', (k % 97)::VARCHAR, NULL, row_id FROM p WHERE k % 3 = 1
  UNION ALL SELECT 'tvdb', (k % 50)::VARCHAR, unnest([NULL, kind]), row_id FROM p WHERE k % 2 = 0
  UNION ALL SELECT 'tmdb', (k % 40)::VARCHAR, unnest(['tv', NULL]), row_id FROM p WHERE k % 5 = 0
  UNION ALL SELECT 'tmdb', (k % 40)::VARCHAR, unnest(['movie', NULL]), row_id FROM p WHERE k % 7 = 0)
"""


def bridge(spark: SparkSession, sf: str) -> DataFrame:
    return X.bridge_rows(payloads(spark, sf), F.col("kind"))


@query("j06_crosswalk_rows", f"WITH {_ROWS} SELECT source, external_id, media_kind, row_id FROM g")
def rows(spark: SparkSession, sf: str) -> DataFrame:
    return bridge(spark, sf)


@query(
    "b10_insert_or_ignore_null_kinds",
    f"WITH {_ROWS} SELECT source, external_id, media_kind, row_id FROM g WHERE media_kind IS NULL UNION ALL (SELECT DISTINCT source, external_id, media_kind, row_id FROM g WHERE media_kind IS NOT NULL)",
)
def insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    twice = bridge(spark, sf)
    return X.insert_or_ignore(twice)


@query("f04_counts_before_dedupe", f"WITH {_ROWS}, c AS (SELECT source, media_kind, count(*) AS n FROM g GROUP BY ALL) SELECT *, (sum(n) OVER ())::BIGINT AS total FROM c")
def counts(spark: SparkSession, sf: str) -> DataFrame:
    return X.generated_counts(bridge(spark, sf))


@query(
    "e01_lookup_keeps_multiplicity",
    f"WITH {_ROWS} SELECT g.row_id, media_kind, p_name FROM g JOIN part ON p_partkey + 1 = g.row_id WHERE source = 'tmdb' AND external_id = '5'",
)
def lookup(spark: SparkSession, sf: str) -> DataFrame:
    titles = table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("row_id"), "p_name")
    return X.lookup(bridge(spark, sf), "tmdb", "5").join(titles, "row_id").select("row_id", "media_kind", "p_name")


@query("d03_optional_kind", f"WITH {_ROWS} SELECT external_id, count(*) AS n FROM g WHERE source = 'tvdb' AND media_kind = 'movie' GROUP BY external_id")
def optional_kind(spark: SparkSession, sf: str) -> DataFrame:
    found = bridge(spark, sf).where("source = 'tvdb' AND media_kind = 'movie'")
    return found.groupBy("external_id").agg(F.count(F.lit(1)).alias("n"))


@query("e02_distinct_resolved_ids", f"WITH {_ROWS} SELECT DISTINCT p_size AS resolved FROM g JOIN part ON p_partkey + 1 = row_id WHERE source = 'mal' AND external_id IN ('7', '11') AND p_size > 0")
def distinct_ids(spark: SparkSession, sf: str) -> DataFrame:
    payload = table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("row_id"), F.to_json(F.struct(F.col("p_size").alias("anilist_id"))).alias("payload_json"))
    hit = bridge(spark, sf).where(F.col("source") == "mal").where(F.col("external_id").isin("7", "11")).join(payload, "row_id")
    resolved = X.positive_int(F.get_json_object("payload_json", "$.anilist_id")).cast("int")
    return hit.select(resolved.alias("resolved")).where("resolved IS NOT NULL").distinct()


@query(
    "e03_two_hop_resolution",
    """SELECT l_suppkey, count(*) AS files FROM lineitem WHERE l_suppkey IN
       (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN ('NATION_3', 'NATION_7')) GROUP BY l_suppkey""",
)
def two_hop(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").where(F.col("n_name").isin("NATION_3", "NATION_7"))
    ids = table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey").distinct()
    files = table(spark, sf, "lineitem").join(ids, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return files.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("files"))


@query(
    "e04_title_resolution_unique",
    """WITH c AS (SELECT o_custkey, o_orderpriority AS v FROM orders WHERE o_totalprice > 250000)
       SELECT o_custkey, min(v) AS resolved FROM c GROUP BY o_custkey HAVING count(DISTINCT v) = 1""",
)
def title_resolution(spark: SparkSession, sf: str) -> DataFrame:
    candidates = table(spark, sf, "orders").where("o_totalprice > 250000").select("o_custkey", F.col("o_orderpriority").alias("resolved"))
    return X.resolve_unique(candidates, "o_custkey", "resolved")


_REQUESTS = [(0, "tvdb", "4", None), (1, "tvdb", "4", "movie"), (2, "mal", "999999", None), (3, "tmdb", "5", "tv"), (4, "tvdb", "4", None), (5, "anidb", "12", None)]


@query(
    "e05_bulk_lookup",
    f"""WITH {_ROWS}, r(pos, source, external_id, media_kind) AS (VALUES {", ".join(f"({p}, '{s}', '{i}', {'NULL' if k is None else repr(k)})" for p, s, i, k in _REQUESTS)})
    SELECT pos, r.source, r.external_id, r.media_kind, count(row_id) AS n, coalesce(string_agg(row_id::VARCHAR, ',' ORDER BY row_id), '') AS results
    FROM r LEFT JOIN g ON g.source = r.source AND g.external_id = r.external_id AND (r.media_kind IS NULL OR r.media_kind = g.media_kind)
    GROUP BY ALL""",
)
def bulk(spark: SparkSession, sf: str) -> DataFrame:
    requests = spark.createDataFrame(_REQUESTS, "pos int, source string, external_id string, media_kind string")
    found = X.lookup_bulk(bridge(spark, sf), requests)
    joined = F.array_join(F.transform("results", lambda x: x.cast("string")), ",")
    return found.select("pos", "source", "external_id", "media_kind", F.col("count").cast("long").alias("n"), joined.alias("results"))


_RAW = ("' MyAnimeList '", "'Anime_Planet'", "'TVDB'", "'themoviedb'", "'ANN'", "'series'")


@query(
    "j04_source_aliases",
    """SELECT event_type, user_id, ['mal', 'anime-planet', 'tvdb', 'tmdb', 'animenewsnetwork', 'series'][k + 1] AS source, ['myanimelist', 'anime-planet', 'tvdb', 'themoviedb', 'ann', 'tv'][k + 1] AS kind, n
       FROM (SELECT event_type, user_id, (user_id % 6)::INT AS k, count(*) AS n FROM events GROUP BY ALL)""",
)
def aliases(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr(f"element_at(array({', '.join(_RAW)}), cast(user_id % 6 AS INT) + 1)")
    e = table(spark, sf, "events").select("event_type", "user_id", X.normalize_source(raw).alias("source"), X.normalize_kind(raw).alias("kind"))
    return e.groupBy("event_type", "user_id", "source", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j15_prefixed_id_split",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN nullif(trim(split_part(v, ':', 1)), '') END AS kind,
       nullif(trim(CASE WHEN p_partkey % 2 = 0 THEN split_part(v, ':', 2) ELSE v END), '') AS id
       FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type || ': ' || p_size ELSE p_size::VARCHAR END AS v FROM part)""",
)
def prefixed(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit(": "), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string"))
    kind, ident = X.split_prefixed(v)
    return table(spark, sf, "part").select("p_partkey", kind.alias("kind"), ident.alias("id"))


@query(
    "j16_tolerant_ints",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 AND event_id > 0 THEN event_id END AS strict,
       CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN -event_id WHEN 2 THEN event_id END AS loose FROM events""",
)
def tolerant_ints(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    raw = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(F.lit("-"), k.cast("string"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit(".0"))).otherwise(F.lit("12v2"))
    return table(spark, sf, "events").select("event_id", X.positive_int(raw).alias("strict"), X.loose_int(raw).alias("loose"))


@query(
    "e06_reference_cascade",
    """WITH r AS (SELECT * FROM (VALUES (1, '12'), (2, 'Supplier#000000003'), (3, 'IN'), (4, 'nothing')) t(pos, ref)),
       c AS (SELECT pos, ref, (SELECT count(*) FROM supplier WHERE s_suppkey::VARCHAR = ref) AS a, (SELECT count(*) FROM supplier WHERE s_name = ref) AS b,
             (SELECT count(*) FROM nation WHERE left(n_name, 2) || '' = 'NA' AND ref = 'IN') AS d FROM r)
       SELECT pos, ref, CASE WHEN a = 1 THEN 'ok' WHEN b = 1 THEN 'ok' WHEN d = 1 THEN 'ok' WHEN d > 1 THEN '409' ELSE '404' END AS status FROM c""",
)
def cascade(spark: SparkSession, sf: str) -> DataFrame:
    refs = spark.createDataFrame([(1, "12"), (2, "Supplier#000000003"), (3, "IN"), (4, "nothing")], "pos int, ref string")
    s = table(spark, sf, "supplier")
    counted = lambda df, c, name: df.groupBy(c.alias("_k")).agg(F.count(F.lit(1)).alias(name))
    first = counted(s, F.col("s_suppkey").cast("string"), "a")
    second = counted(s, F.col("s_name"), "b")
    third = counted(table(spark, sf, "nation"), F.lit("IN"), "d")
    out = refs
    for side, name in ((first, "a"), (second, "b"), (third, "d")):
        out = out.join(side.withColumnRenamed("_k", f"_{name}"), F.col("ref") == F.col(f"_{name}"), "left").drop(f"_{name}")
    status = F.when((F.col("a") == 1) | (F.col("b") == 1) | (F.col("d") == 1), "ok").when(F.greatest("a", "b", "d") > 1, "409").otherwise("404")
    return out.select("pos", "ref", status.alias("status"))
