"""Queries of library functions that no other query runs by themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.functions import filenames as N
from subtide.functions import release_names as names_of
from subtide.functions import text as T
from subtide.operators import alignment as A
from subtide.operators import cleaning as C
from subtide.operators import crosswalk as X
from subtide.operators import intervals as I
from subtide.operators import records as R
from subtide.operators import upkeep as U
from subtide.operators.ranking import reciprocal_rank, repeats
from subtide.operators.search import top_k
from subtide.plans.registry import query
from subtide.session import dealt, table
from subtide.sources import files

# Scans and listings ----------------------------------------------------------

_LISTING = "'d' || (p_size % 5) || '/' || CASE WHEN p_partkey % 11 = 0 THEN '._' ELSE '' END || p_name || p_partkey || CASE p_size % 4 WHEN 0 THEN '.srt' WHEN 1 THEN '.ASS' WHEN 2 THEN '.mkv' ELSE '.txt' END"


def listing(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.expr(_LISTING).alias("path"))


@query(
    "a16_expand_inputs",
    f"""WITH l AS (SELECT DISTINCT {_LISTING} AS path FROM part),
        a AS (SELECT path, CASE WHEN regexp_full_match(path, 'd3/[^/]*') THEN 0 WHEN regexp_full_match(path, '[^/]*/[^/]*[^/]7[.][^/]*') THEN 1 WHEN regexp_full_match(path, 'd[^/]/.*[.]srt') THEN 2 END AS argument FROM l)
        SELECT argument, path, lower(regexp_extract(path, '[.]([^./]+)$', 1)) NOT IN ('srt', 'ass') AS unsupported FROM a WHERE argument IS NOT NULL""",
)
def expand(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = files.expand_inputs(listing(spark, sf), ["d3/*", "*/*?7.*", "d?/**.srt"], ["srt", "ass"])
    return good.withColumn("unsupported", F.lit(False)).unionByName(bad.withColumn("unsupported", F.lit(True)))


@query(
    "a17_discover_media",
    f"""WITH l AS (SELECT {_LISTING} AS path FROM part), k AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, lower(regexp_extract(path, '([^/]*)$', 1)) AS n FROM l)
        SELECT folder, path, row_number() OVER (PARTITION BY folder ORDER BY n, path)::INT AS place FROM k WHERE n NOT LIKE '.\\_%' ESCAPE '\\' AND n LIKE '%.mkv'""",
)
def discover(spark: SparkSession, sf: str) -> DataFrame:
    return files.discover_media(listing(spark, sf), ["mkv", "mp4"])


_FIRST = "(p_size % 24 + 1)"
#: A name a part, in eight forms; # is the first episode, and ranges and lists go on from it.
_FORMS = """CASE p_size % 8 WHEN 0 THEN ' S01E' || # WHEN 1 THEN ' - ' || # || 'v2' WHEN 2 THEN '' WHEN 3 THEN ' ep' || # WHEN 4 THEN ' S02E' || # || '-E' || (# + p_partkey % 5 + 1)
    WHEN 5 THEN ' - ' || # || '+' || (# + 1) WHEN 6 THEN ' ' || # || '.5' ELSE ' [' || # || ']' END""".replace("#", _FIRST)
_NAME = f"'[Group ' || chr(65 + p_size % 7) || '] ' || p_name || {_FORMS} || ' [1080p].mkv'"
_EPISODES = "CASE p_size % 8 WHEN 2 THEN [] WHEN 4 THEN range(#, # + p_partkey % 5 + 2) WHEN 5 THEN [#, # + 1] WHEN 6 THEN [] ELSE [#] END".replace("#", _FIRST)


def names(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_name")
    return dealt(p, "p_partkey").select("p_partkey", F.expr(_NAME).alias("name"))


@query(
    "a30_parsed_file_name",
    f"""SELECT p_partkey, p_name AS title, 'Group ' || chr(65 + p_size % 7) AS grp, CASE p_size % 8 WHEN 0 THEN 1 WHEN 4 THEN 2 END AS season, array_to_string({_EPISODES}, ',') AS episodes,
        CASE WHEN p_size % 8 = 6 THEN (p_size % 24 + 1) || '.5' ELSE '' END AS fractions, p_size % 8 IN (4, 5, 6) AS ambiguous FROM part""",
)
def parsed_name(spark: SparkSession, sf: str) -> DataFrame:
    p = names(spark, sf).select("p_partkey", names_of.parsed_name(F.col("name")).alias("p"))
    listed = F.array_join(F.transform("p.episodes", lambda n: n.cast("string")), ",")
    return p.select("p_partkey", "p.title", F.col("p.group").alias("grp"), "p.season", listed.alias("episodes"), F.array_join("p.fractions", ",").alias("fractions"), "p.ambiguous")


@query("j12_runtime_episodes", f"SELECT p_partkey, unnest({_EPISODES})::INT AS episode FROM part")
def runtime_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select("p_partkey", F.explode(names_of.episode_numbers(F.col("name"))).alias("episode"))


@query("a31_last_decision", "SELECT source, max_by(event_type, event_id) AS decision FROM (SELECT nullif(user_id % 50, 7) AS source, event_type, event_id FROM events) WHERE source IS NOT NULL GROUP BY source")
def last_decision(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.expr("nullif(user_id % 50, 7)").alias("source"), F.col("event_type").alias("decision"), "event_id").where("source IS NOT NULL")
    return U.latest(e, "source", "decision", "event_id")


@query("a29_coverage_row", "SELECT p_partkey, p_name AS title, coalesce(nullif(p_type, ''), '') AS kind, CASE WHEN p_size % 8 IN (1, 2) THEN -1 ELSE p_size % 24 + 1 END AS episode, '1080p' AS tag FROM part")
def coverage_row(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("title"), F.coalesce("p_type", F.lit("")).alias("kind"))
    n = names(spark, sf).select("p_partkey", F.coalesce(N.episode(F.col("name"))["local"], F.lit(-1)).alias("episode"), F.element_at(N.tags(F.col("name")), -1).alias("tag"))
    return p.join(n, "p_partkey")


# Builds and upkeep -----------------------------------------------------------


@query(
    "b02_rebuild_where_stale",
    """WITH c AS (SELECT o_custkey, count(*) || ':' || max(o_orderkey) AS fingerprint FROM orders GROUP BY o_custkey)
       SELECT o_custkey, fingerprint, NOT coalesce(o_custkey % 3 <> 0 AND o_custkey % 5 <> 0 AND o_custkey % 7 <> 0, false) AS rebuild FROM c""",
)
def rebuild(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.max("o_orderkey").cast("string")).alias("fingerprint"))
    built = o.where("o_custkey % 3 <> 0").withColumn("fingerprint", F.when(F.col("o_custkey") % 5 == 0, "old").otherwise(F.col("fingerprint")))
    return U.stale(o, built.withColumn("rows", F.when(F.col("o_custkey") % 7 == 0, 0).otherwise(1)), "o_custkey", "fingerprint", "rows")


@query("b07_query_cache_upsert", "SELECT md5(lower(trim(p_type)) || '|' || p_size) AS cache_key, max(p_partkey) AS result FROM part GROUP BY 1")
def query_cache(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.md5(F.concat_ws("|", F.lower(F.trim("p_type")), F.col("p_size").cast("string"))).alias("cache_key"), F.col("p_partkey").alias("result"))
    best = lambda d: d.groupBy("cache_key").agg(F.max("result").alias("result"))
    p = p.join(F.broadcast(p.agg(F.floor(F.max("result") / 2).alias("cut"))))  # one row
    old, new = best(p.where("result <= cut")), best(p.where("result > cut"))
    return U.upsert(old, new, ["cache_key"])


@query(
    "b12_insert_batches",
    "SELECT l_suppkey, batch, count(*) AS n, min(l_orderkey) AS first FROM (SELECT l_suppkey, l_orderkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) // 500 AS batch FROM lineitem) GROUP BY 1, 2",
)
def batches(spark: SparkSession, sf: str) -> DataFrame:
    r = U.insert_batches(table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey"], ["l_orderkey", "l_linenumber"], 500)
    return r.groupBy("l_suppkey", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first"))


_ROOTS = "SELECT n_nationkey AS c_nationkey, n_nationkey % 4 <> 1 AS available FROM nation"


def _index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    roots = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") % 4 != 1).alias("available"))
    return c, c.where("c_custkey % 5 <> 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), roots


@query(
    "b14_replace_index",
    f"""SELECT c_custkey, c_nationkey, CASE WHEN available THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer JOIN ({_ROOTS}) USING (c_nationkey)
        WHERE NOT available OR c_custkey % 5 <> 0""",
)
def replace_index(spark: SparkSession, sf: str) -> DataFrame:
    old, new, roots = _index(spark, sf)
    return U.guarded_replace(old, new, roots, "c_nationkey", "available")


@query("m05_availability_guard", f"SELECT c_nationkey, count(*) AS kept FROM customer JOIN ({_ROOTS}) USING (c_nationkey) WHERE NOT available GROUP BY c_nationkey")
def availability(spark: SparkSession, sf: str) -> DataFrame:
    old, new, roots = _index(spark, sf)
    after = U.guarded_replace(old, new.limit(0), roots, "c_nationkey", "available")
    return after.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "b16_rejected_manifest",
    """WITH o AS (SELECT o_custkey, bool_or(o_orderkey % 40 = 0) AS lost FROM orders GROUP BY o_custkey)
       SELECT 'root/' || o_custkey || '/m.json' AS path, CASE WHEN o_custkey % 7 = 0 THEN 'invalid_manifest' ELSE 'missing_artifact' END AS code FROM o WHERE o_custkey % 7 = 0 OR lost""",
)
def rejected(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    episode = F.struct(F.col("o_orderkey").cast("string").alias("episode_key"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".m4a")).alias("relative_path"), F.lit(1).alias("size_bytes"))
    per = o.groupBy("o_custkey").agg(F.collect_list(episode).alias("episodes"))
    value = F.to_json(F.struct(
        F.when(F.col("o_custkey") % 7 == 0, 2).otherwise(1).alias("schema_version"), F.lit("audio").alias("kind"),
        F.struct(F.col("o_custkey").alias("id"), F.lit("t").alias("title")).alias("series"), F.struct(F.lit("p").alias("name"), F.lit("c").alias("codec")).alias("profile"), "episodes",
    ))
    folder = lambda c: F.concat(F.lit("root/"), c.cast("string"), F.lit("/"))
    texts = per.select(F.concat(folder(F.col("o_custkey")), F.lit("m.json")).alias("path"), value.alias("value"))
    there = o.where("o_orderkey % 40 <> 0").select(F.concat(folder(F.col("o_custkey")), F.col("o_orderkey").cast("string"), F.lit(".m4a")).alias("path"))
    return R.load_manifests(texts, there)[2]


@query("b22_run_manifest", "SELECT 'model-a' AS model, count(*) AS shards, sum(n)::BIGINT AS requests, string_agg(p_brand || '=' || n, ',' ORDER BY p_brand) AS listing FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)")
def run_manifest(spark: SparkSession, sf: str) -> DataFrame:
    shards = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return R.run_manifest(shards, "model-a", "p_brand", "n")


# Projections -----------------------------------------------------------------


@query("c09_first_cover", "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size % 3 = 0 THEN '  ' ELSE p_name END), ''), nullif(CASE WHEN p_size % 5 = 0 THEN p_type END, ''), p_brand) AS cover FROM part")
def cover(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", T.first_of(F.expr("CASE WHEN p_size % 3 = 0 THEN '  ' ELSE p_name END"), F.expr("CASE WHEN p_size % 5 = 0 THEN p_type END"), F.col("p_brand")).alias("cover"))


_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("c20_columns", " UNION ALL ".join(f"SELECT '{c}' AS column_name, {i} AS position, count({c}) AS filled, count(DISTINCT {c}) AS different FROM orders" for i, c in enumerate(_ORDERS)))
def columns(spark: SparkSession, sf: str) -> DataFrame:
    return R.column_profile(table(spark, sf, "orders").select(*_ORDERS)).drop("type")


@query("c22_cue_reference", "SELECT 'events:' || user_id || ':' || event_id AS ref, user_id AS source_id, event_id AS index, value AS start_s, value + 1 AS end_s FROM events")
def cue_reference(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    ref = T.source_key(F.lit("events"), F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    return e.select(F.struct(ref.alias("ref"), F.col("user_id").alias("source_id"), F.col("event_id").alias("index"), F.col("value").alias("start_s"), (F.col("value") + 1).alias("end_s")).alias("s")).select("s.*")


_DECISION = "CASE p_size % 4 WHEN 0 THEN 'remove' WHEN 1 THEN 'edit' WHEN 2 THEN 'asis' END"


def _decided(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "part")
    return p.select("p_partkey", "p_name"), p.select("p_partkey", F.expr(_DECISION).alias("decision"), F.upper("p_name").alias("new_text")).where("decision IS NOT NULL")


@query(
    "c24_display_text",
    f"SELECT p_partkey, p_name AS source_text, decision, CASE decision WHEN 'edit' THEN upper(p_name) WHEN 'asis' THEN p_name END AS emitted_text, decision = 'remove' OR (decision = 'edit' AND upper(p_name) <> p_name) AS changed FROM (SELECT *, {_DECISION} AS decision FROM part) WHERE decision IS NOT NULL",
)
def display(spark: SparkSession, sf: str) -> DataFrame:
    cues, decisions = _decided(spark, sf)
    return R.decision_log(cues, decisions, ["p_partkey"], "p_name")


@query("c25_review_payload", f"""SELECT p_partkey, '{{"index":' || p_partkey || ',"text":"' || p_name || '","decision":"' || ({_DECISION}) || '"}}' AS payload FROM part WHERE {_DECISION} IS NOT NULL""")
def payload(spark: SparkSession, sf: str) -> DataFrame:
    cues, decisions = _decided(spark, sf)
    return R.review_payloads(cues, decisions, "p_partkey", "p_name")


@query("c28_insert_row", """SELECT p_partkey, p_name, '["' || array_to_string(string_split(p_type, ' '), '","') || '"]' AS tags, coalesce(p_size, 0) AS size FROM part""")
def insert_row(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(*R.insert_row({c: F.col(c) for c in ("p_partkey", "p_name")}, {"tags": F.split("p_type", " ")}, {"size": F.col("p_size")}))


@query("c29_review_text", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_name || 'x' END AS shown, p_size % 3 = 0 AS stored FROM part")
def review_text(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    kept = p.where("p_size % 3 = 0").select("p_partkey", F.col("p_brand").alias("mechanical"))
    cues = p.select("p_partkey", F.concat("p_name", F.lit("\nx➡")).alias("text"))
    again, _ = T.mechanical_normalise(F.col("text"))
    return cues.join(kept, "p_partkey", "left").select("p_partkey", F.coalesce("mechanical", again).alias("shown"), F.col("mechanical").isNotNull().alias("stored"))


@query("d11_rejected_lookups", "SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'unknown_source' WHEN user_id % 3 = 2 THEN 'unknown_kind' END AS error FROM events")
def rejections(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("user_id") % 3 == 1, "tv").when(F.col("user_id") % 3 == 2, "opera")
    return table(spark, sf, "events").select("event_id", X.rejection(F.col("event_type"), kind, ["view", "click", "purchase"], ["tv", "movie"]).alias("error"))


@query(
    "e14_series_with_buckets",
    """SELECT s_suppkey, count(l_orderkey) FILTER (l_returnflag = 'A') AS n_a, count(l_orderkey) FILTER (l_returnflag = 'N') AS n_n, count(l_orderkey) AS n
       FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE l_suppkey % 3 <> 0) ON l_suppkey = s_suppkey GROUP BY s_suppkey""",
)
def buckets(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "lineitem").where("l_suppkey % 3 <> 0").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count_if(F.col("l_returnflag") == "A").alias("n_a"), F.count_if(F.col("l_returnflag") == "N").alias("n_n"), F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "supplier").select("s_suppkey").join(a, "s_suppkey", "left").na.fill(0)


# Windows and order -----------------------------------------------------------


@query(
    "g08_running_end_faults",
    """WITH t AS (SELECT user_id, event_id, value AS a, value + event_id % 7 AS e FROM events),
       w AS (SELECT *, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS m FROM t)
       SELECT event_id, m AS running_max FROM w WHERE a < m - 0.5""",
)
def running_end(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events").select("user_id", "event_id", F.col("value").alias("a"), (F.col("value") + F.col("event_id") % 7).alias("e"))
    return I.running_faults(t, ["user_id"], "a", "event_id", 0.5, of="e").select("event_id", "running_max")


@query("g14_duplicates_in_window", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS position, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS duplicate FROM events")
def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return repeats(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type", "event_id").select("event_id", "position", "duplicate")


@query("g17_reciprocal_rank", "SELECT event_id, round(1.0 / row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id), 9) AS score FROM events")
def reciprocal(spark: SparkSession, sf: str) -> DataFrame:
    return reciprocal_rank(table(spark, sf, "events").select("user_id", "value", "event_id"), ["user_id"], [F.desc("value"), "event_id"]).select("event_id", "score")


@query("g18_results_by_input", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS local FROM events")
def by_input(spark: SparkSession, sf: str) -> DataFrame:
    return R.indexed_samples(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("h01_top_scores", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def top(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").transform(top_k, 25, "c_acctbal", "c_custkey")


@query("h11_decision_log_order", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id)::INT AS place FROM events")
def log_order(spark: SparkSession, sf: str) -> DataFrame:
    return R.indexed_samples(table(spark, sf, "events").select("user_id", "event_id", F.struct("event_type", "ts", "event_id").alias("o")), "user_id", "o").select("user_id", "event_id", F.col("local").alias("place"))


# Sets and expressions --------------------------------------------------------


@query(
    "i01_ids_across_sources",
    "SELECT k, min(v) AS v FROM (SELECT o_custkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 9 = 0) GROUP BY k HAVING count(DISTINCT v) = 1",
)
def across(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("v"))
    return X.resolve_unique(o.where("o_orderkey % 4 = 0").select("k", "v").unionByName(o.where("o_orderkey % 9 = 0").select("k", "v")), "k", "v")


@query(
    "i09_field_sets",
    """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: x[1] > 'm'))), ',') AS unknown, array_to_string(list_sort(list_distinct(list_filter(w, lambda x: x[1] = 'a'))), ',') AS forbidden
       FROM (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part)""",
)
def field_sets(spark: SparkSession, sf: str) -> DataFrame:
    w = F.split(F.lower("p_name"), " ")
    known, reserved = F.filter(w, lambda x: F.substring(x, 1, 1) <= "m"), F.filter(w, lambda x: F.substring(x, 1, 1) == "a")
    faults = table(spark, sf, "part").select("p_partkey", R.field_faults(w, known, reserved).alias("f"))
    return faults.select("p_partkey", F.array_join("f.unknown", ",").alias("unknown"), F.array_join("f.forbidden", ",").alias("forbidden"))


@query(
    "j05_nested_ids",
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN '' ELSE c_custkey || '|' || c_name || '|a, ]b|' || c_nationkey END AS ids FROM customer",
)
def nested_ids(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    value = F.expr("""CASE c_custkey % 3 WHEN 0 THEN ' ' || c_custkey || ' ' WHEN 1 THEN '[null, [" ", []], ""]'
                      ELSE '[' || c_custkey || ', ["' || c_name || '", null, ["a, ]b"]], "", [[' || c_nationkey || ']]]' END""")
    return c.select("c_custkey", F.array_join(X.scalar_ids(value), "|").alias("ids"))


@query("j24_character_classes", r"SELECT doc_id, len(regexp_extract_all(text, '\p{Lu}')) AS upper, len(regexp_extract_all(text, '\p{Nd}')) AS digits, len(regexp_extract_all(text, '\p{Han}')) AS han, len(regexp_extract_all(text, '\p{Cyrillic}')) AS cyrillic FROM documents")
def classes(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, sf, "documents").select("doc_id", n(r"\p{Lu}").alias("upper"), n(r"\p{Nd}").alias("digits"), n(r"\p{IsHan}").alias("han"), n(r"\p{IsCyrillic}").alias("cyrillic"))


@query(
    "j43_service_url",
    "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'http://own/' || p_size WHEN p_size % 3 = 0 THEN 'http://env' WHEN p_size % 7 = 0 THEN NULL ELSE 'http://gate/' || p_partkey END AS url FROM part",
)
def service_url(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    bare = lambda c: F.regexp_replace(T.blank_to_null(c), "/+$", "")
    own, env = F.expr("CASE WHEN p_size % 5 = 0 THEN ' http://own/' || p_size || '/ ' ELSE ' ' END"), F.expr("CASE WHEN p_size % 3 = 0 THEN 'http://env//' END")
    gate = F.expr("CASE WHEN p_size % 7 <> 0 THEN 'http://gate/' END")
    return p.select("p_partkey", F.coalesce(bare(own), bare(env), F.concat(bare(gate), F.lit("/"), F.regexp_replace(F.concat(F.lit("//"), F.col("p_partkey").cast("string")), "^/+", ""))).alias("url"))


@query("k06_full_source_chunk", "SELECT p_partkey, 0 AS index, 0.0::DOUBLE AS start, p_retailprice AS end FROM part WHERE p_size % 10 <> 0")
def full_chunk(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.expr("CASE WHEN p_size % 10 <> 0 THEN p_retailprice END").alias("d"))
    return A.chunks_or_whole(p, ["p_partkey"], "d", 1e9)


@query(
    "k12_absolute_spans",
    "SELECT c_custkey, c_custkey % 100 * 30 + s.a AS start, c_custkey % 100 * 30 + s.e AS end, s.t AS text FROM customer, (VALUES (0.5::DOUBLE, 1.25::DOUBLE, 'x'), (2.0, 29.5, 'y')) AS s(a, e, t) WHERE c_custkey % 100 > 0",
)
def absolute(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_custkey % 100 > 0").select("c_custkey", (F.col("c_custkey") % 100 * 30).cast("double").alias("chunk"))
    spans = R.segments_of(F.lit('[{"start": "0.5s", "end": 1.25, "text": "x"}, {"start_time": 2.0, "end_time": "29.5", "content": "y"}]'), F.col("chunk"), F.lit(30.0))
    return c.select("c_custkey", F.inline(spans))


@query(
    "l04_error_rows",
    "SELECT o_orderkey, 'api_error' AS error_kind, status, coalesce(status IN (0, 408, 500), true) AS retryable FROM (SELECT o_orderkey, [NULL, 0, 408, 401, 500, 404][o_orderkey % 6 + 1] AS status FROM orders)",
)
def error_rows(spark: SparkSession, sf: str) -> DataFrame:
    status = F.get(F.expr("array(null, 0, 408, 401, 500, 404)"), (F.col("o_orderkey") % 6).cast("int"))
    o = table(spark, sf, "orders").select("o_orderkey", F.lit("api_error").alias("error_kind"), status.alias("status"))
    return o.withColumn("retryable", C.retryable(F.col("status")))


@query(
    "l11_artifact_faults",
    "SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_tax > 0.05 THEN 'tax' END, CASE WHEN l_quantity > 40 THEN 'size' END) AS faults FROM lineitem WHERE l_tax > 0.05 OR l_quantity > 40",
)
def artifact_faults(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = A.invariant_faults(table(spark, sf, "lineitem"), {"tax": "l_tax <= 0.05", "size": "l_quantity <= 40"})
    return bad.select("l_orderkey", "l_linenumber", F.array_join("faults", ",").alias("faults"))


@query("m09_lifetime_by_status", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 2592000 ELSE 604800 END AS ttl FROM orders")
def ttl(spark: SparkSession, sf: str) -> DataFrame:
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN ' finished ' WHEN 'O' THEN 'RELEASING' END")
    return table(spark, sf, "orders").select("o_orderkey", U.lifetime(status).alias("ttl"))


@query(
    "m13_running_counters",
    "SELECT event_type, day, sum(count(*)) OVER (PARTITION BY event_type ORDER BY day)::BIGINT AS total FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day FROM events) GROUP BY event_type, day",
)
def counters(spark: SparkSession, sf: str) -> DataFrame:
    return U.running_counts(table(spark, sf, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")), ["event_type"], "day")


@query("m14_resumed_items", "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0)")
def resumed(spark: SparkSession, sf: str) -> DataFrame:
    work = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("fingerprint"))
    done = work.where("o_orderkey % 3 = 0").withColumn("fingerprint", F.when(F.col("o_orderkey") % 4 == 0, "other").otherwise(F.col("fingerprint")))
    return U.resume(work, done, ["o_orderkey", "fingerprint"]).select("o_orderkey")


@query(
    "m16_fetch_and_cache",
    """SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN '{}' ELSE c_name END AS payload, c_custkey % 6 = 0 AS negative,
       CASE WHEN c_custkey % 6 = 0 THEN 100 + 86400 WHEN c_custkey % 2 = 0 THEN 100 + 2592000 ELSE 100 + 604800 END AS expires_at FROM customer""",
)
def fetch(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    got = c.where("c_custkey % 6 <> 0").select("c_custkey", "c_name", F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'finished' ELSE 'airing' END").alias("status"))
    return U.positive_or_negative(c.select("c_custkey"), got, "c_custkey", F.col("c_name"), U.lifetime(F.col("status")) + 100, F.lit(100 + 86400))


@query("n10_asked_and_decided", "SELECT p_partkey, p_size % 3 = 0 AND p_partkey % 2 = 1 AS asked FROM part")
def asked(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    clear, ask = U.unresolved(p, p.where("p_partkey % 2 = 0").select("p_partkey"), ["p_partkey"], F.col("p_size") % 3 == 0)
    return clear.select("p_partkey", F.lit(False).alias("asked")).unionByName(ask.select("p_partkey", F.lit(True).alias("asked")))
