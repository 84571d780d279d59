"""Projection, alignment and composite queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subtide.operators import alignment as A
from subtide.plans.registry import query
from subtide.session import table


@query("c01_exclude_and_lead", "SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM orders")
def exclude(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    first, out = ["o_custkey"], {"o_orderstatus", "o_orderdate"}
    return o.select(*first, *[c for c in o.columns if c not in out and c not in first])


@query("c06_flatten_nested", "SELECT c_custkey, c_name AS title_name, c_mktsegment AS title_segment, '[' || c_nationkey || ']' AS edges, NULL::VARCHAR AS missing FROM customer")
def flatten(spark: SparkSession, sf: str) -> DataFrame:
    media = F.to_json(F.struct(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("title"), F.array("c_nationkey").alias("edges")))
    parsed = F.from_json("media", "title struct<name:string,segment:string>, edges array<int>, missing string").alias("m")
    m = table(spark, sf, "customer").select("c_custkey", media.alias("media")).select("c_custkey", parsed)
    return m.select("c_custkey", F.col("m.title.name").alias("title_name"), F.col("m.title.segment").alias("title_segment"), F.to_json("m.edges").alias("edges"), F.col("m.missing").alias("missing"))


@query("c07_typed_record", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS size, nullif(trim(CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE ' ' END), '') AS brand FROM part")
def typed(spark: SparkSession, sf: str) -> DataFrame:
    size = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).otherwise("n/a").try_cast("int")
    brand = F.nullif(F.trim(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(" ")), F.lit(""))
    return table(spark, sf, "part").select("p_partkey", size.alias("size"), brand.alias("brand"))


@query("c10_conditional_tags", "SELECT p_partkey, 'part:' || p_partkey || CASE WHEN p_size > 25 THEN ',size:' || p_size ELSE '' END AS tags FROM part")
def conditional_tags(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.concat(F.array(F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))), F.when(F.col("p_size") > 25, F.array(F.concat(F.lit("size:"), F.col("p_size").cast("string")))).otherwise(F.array().cast("array<string>")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(tags, ",").alias("tags"))


@query("c11_derived_url", "SELECT o_orderkey, '/series/' || o_custkey || '/episodes/' || o_orderkey || '/content' AS content_url FROM orders")
def derived_url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.format_string("/series/%d/episodes/%d/content", "o_custkey", "o_orderkey").alias("content_url"))


@query("c14_search_projection", "SELECT p_partkey, round(p_retailprice / 7, 4) AS score, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE 'y' || p_size END AS year FROM part")
def search_projection(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.lit("y"), F.col("p_size").cast("string")))
    year = F.coalesce(raw.try_cast("int").cast("string"), raw)
    return table(spark, sf, "part").select("p_partkey", F.round(F.col("p_retailprice") / 7, 4).alias("score"), year.alias("year"))


@query("c16_context_text", "SELECT o_custkey, coalesce('orders: ' || string_agg(o_orderkey::VARCHAR, ', ' ORDER BY o_orderkey) FILTER (i <= 3), 'unknown') AS context FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) GROUP BY o_custkey")
def context_text(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.slice(F.sort_array(F.collect_list("o_orderkey")), 1, 3)
    text = F.concat(F.lit("orders: "), F.array_join(F.transform(ids, lambda x: x.cast("string")), ", "))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.coalesce(text, F.lit("unknown")).alias("context"))


@query("c18_warnings", "SELECT doc_id, CASE WHEN n_chars < 200 THEN CASE WHEN lang <> 'en' THEN 'short,foreign' ELSE 'short' END ELSE CASE WHEN lang <> 'en' THEN 'foreign' ELSE '' END END AS warnings FROM documents")
def warnings(spark: SparkSession, sf: str) -> DataFrame:
    w = F.filter(F.array(F.when(F.col("n_chars") < 200, "short"), F.when(F.col("lang") != "en", "foreign")), lambda x: x.isNotNull())
    return table(spark, sf, "documents").select("doc_id", F.array_join(w, ",").alias("warnings"))


@query("c21_additive_columns", "SELECT r_regionkey, r_name, NULL::BIGINT AS extra FROM region UNION ALL SELECT n_nationkey, n_name, 1 FROM nation")
def additive(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name"), F.lit(1).cast("long").alias("extra"))
    return table(spark, sf, "region").unionByName(n, allowMissingColumns=True)


@query("c26_count_defaults_to_length", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def counted(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list("o_orderkey").alias("results"))).alias("j"))
    r = F.from_json("j", "count bigint, results array<bigint>")
    return per.select("o_custkey", r.alias("r")).select("o_custkey", F.coalesce("r.count", F.size("r.results").cast("long")).alias("n"))


@query("j38_path_encoding", "SELECT c_custkey, 'Customer%23' || c_name[10:] || '%20x' AS path FROM customer")
def encoding(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.replace(F.url_encode(F.concat("c_name", F.lit(" x"))), F.lit("+"), F.lit("%20")).alias("path"))


@query("j46_price_sum_propagates_null", "SELECT l_orderkey, l_linenumber, l_extendedprice + CASE WHEN l_linenumber % 2 = 0 THEN l_tax END AS total FROM lineitem")
def null_sum(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") + F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax"))).alias("total"))


@query("j51_options_override", "SELECT p_partkey, CASE WHEN p_size > 20 THEN 'big' ELSE 'base' END AS mode, 'keep' AS other FROM part")
def options(spark: SparkSession, sf: str) -> DataFrame:
    base = F.create_map(F.lit("mode"), F.lit("base"), F.lit("other"), F.lit("keep"))
    over = F.when(F.col("p_size") > 20, F.create_map(F.lit("mode"), F.lit("big"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)
    return table(spark, sf, "part").select("p_partkey", merged.alias("m")).select("p_partkey", F.col("m.mode").alias("mode"), F.col("m.other").alias("other"))


@query("j45_chat_request_extraction", "SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'system'), '') AS system, count(*) AS messages FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) GROUP BY conv_id")
def chat_request(spark: SparkSession, sf: str) -> DataFrame:
    body = F.to_json(F.struct(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("messages")))
    b = table(spark, sf, "conversations").groupBy("conv_id").agg(F.from_json(body, "messages array<struct<turn:int,role:string,text:string>>")["messages"].alias("m"))
    system = F.array_join(F.transform(F.filter("m", lambda x: x["role"] == "system"), lambda x: x["text"]), "\n")
    return b.select("conv_id", system.alias("system"), F.size("m").cast("long").alias("messages"))


@query("g12_renumber_after_removal", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem WHERE l_quantity > 10")
def renumber(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return table(spark, sf, "lineitem").where("l_quantity > 10").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("n"))


@query("g19_greedy_offsets", "SELECT p_partkey, 0 || ',' || (strpos(p_name, ' ')) AS starts FROM part WHERE strpos(p_name, ' ') > 0 AND length(p_name) - length(replace(p_name, ' ', '')) = 1")
def offsets(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split("p_name", " ")
    p = table(spark, sf, "part").where(F.size(words) == 2)
    found = A.greedy_offsets(F.col("p_name"), words)
    return p.select("p_partkey", F.array_join(F.transform(found, lambda x: x["start"].cast("string")), ",").alias("starts"))


@query("e12_groups_with_alignments", "SELECT c_custkey, min(o_orderkey) AS start, max(o_orderkey) AS \"end\", count(o_orderkey) AS tokens, CASE WHEN count(o_orderkey) = 0 THEN 'missing' ELSE 'aligned' END AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def alignments(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("start"), F.col("o_orderkey").alias("end"))
    return A.align_groups(table(spark, sf, "customer").select("c_custkey"), t, "c_custkey")


@query("c23_alignment_status", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 20 THEN 'aligned' ELSE 'suspicious' END AS status FROM lineitem")
def status(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", A.token_status(F.lit(20.0), F.col("l_quantity")).alias("status"))


@query("l13_invariants_quarantine", "SELECT event_id, CASE WHEN value > 100 THEN CASE WHEN event_type = 'error' THEN 'bounded,typed' ELSE 'bounded' END ELSE 'typed' END AS faults FROM events WHERE value > 100 OR event_type = 'error'")
def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    bad = A.invariant_faults(table(spark, sf, "events"), {"bounded": "value <= 100", "typed": "event_type <> 'error'"})[1]
    return bad.select("event_id", F.array_join("faults", ",").alias("faults"))


@query("k07_configured_chunks", "SELECT doc_id, i::INT AS index, i * 500e0 AS start, least(n_chars, (i + 1) * 500)::DOUBLE AS \"end\" FROM (SELECT doc_id, n_chars, unnest(range(0, greatest(ceil(n_chars / 500e0)::BIGINT, 1))) AS i FROM documents)")
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    return A.chunks_or_whole(d, ["doc_id"], "n_chars", 500.0)


@query("k08_transcript_cues", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, value + 1e0, event_id) AS number FROM events WHERE event_type <> 'error'")
def transcript(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", F.struct("value", "event_id").alias("start"), F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.struct(F.col("value") + 1, F.col("event_id"))).alias("end"), "event_type")
    return A.transcript_cues(e, "user_id", "start", "end", "event_type").select("user_id", "event_id", F.col("number").cast("long").alias("number"))


@query("k14_frame_ranges", "SELECT event_id, CASE WHEN round_even((value + 2e0) * 10, 0) <= 3000 THEN round_even(value * 10, 0)::BIGINT END AS first, CASE WHEN round_even((value + 2e0) * 10, 0) <= 3000 THEN round_even((value + 2e0) * 10, 0)::BIGINT END AS last FROM events")
def frame_ranges(spark: SparkSession, sf: str) -> DataFrame:
    a, b = A.frame_range(F.col("value"), F.col("value") + 2, F.lit(10), F.lit(3000))
    return table(spark, sf, "events").select("event_id", a.alias("first"), b.alias("last"))


@query("k16_cumulative_offset", "SELECT user_id, event_id, (sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM events")
def cumulative(spark: SparkSession, sf: str) -> DataFrame:
    return A.cumulative_offset(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id", "event_id")


@query("l09_schema_version_gate", "SELECT event_id FROM events WHERE event_id % 3 <> 1")
def version_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of schema version 1, or without any name and version."""
    k = F.col("event_id") % 3
    v = table(spark, sf, "events").withColumn("name", F.when(k == 0, "m")).withColumn("version", F.when(k == 0, 1).when(k == 1, 2))
    return v.where((F.col("name").isNull() & F.col("version").isNull()) | (F.col("version") == 1)).select("event_id")


@query("h04_candidate_order", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, -n_chars, doc_id) AS place FROM documents")
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2)
    w = Window.partitionBy("source").orderBy(rank, -F.col("n_chars"), "doc_id")
    return table(spark, sf, "documents").select("doc_id", F.row_number().over(w).cast("long").alias("place"))


@query("e09_local_ids_to_indexes", "SELECT o_custkey, k AS local, ids[k] AS index FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey), (SELECT unnest([1, 3, 50]) AS k)")
def local_ids(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"))
    k = F.explode(F.array(F.lit(1), F.lit(3), F.lit(50))).alias("local")
    return o.select("o_custkey", "ids", k).select("o_custkey", "local", F.try_element_at("ids", F.col("local")).alias("index"))


@query("e23_index_to_text", "SELECT conv_id, turn, coalesce(text, '') AS text FROM (SELECT DISTINCT conv_id, turn, min(text) OVER (PARTITION BY conv_id, turn) AS text FROM conversations)")
def index_to_text(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    w = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"))
    idx, texts = F.transform("s", lambda x: x["turn"]), F.transform("s", lambda x: x["text"])
    p = w.select("conv_id", F.explode(idx).alias("turn"), idx.alias("idx"), texts.alias("texts"))
    return p.select("conv_id", "turn", F.coalesce(F.try_element_at("texts", F.array_position("idx", F.col("turn")).cast("int")), F.lit("")).alias("text"))


@query("a23_stream_inventory", "SELECT p_partkey, i - 1 AS stream, CASE WHEN i % 2 = 0 THEN i // 2 - 1 END AS ordinal FROM (SELECT p_partkey, unnest(range(1, p_size % 5 + 2)) AS i FROM part)")
def streams(spark: SparkSession, sf: str) -> DataFrame:
    """Streams of a probe document; audio streams count among themselves."""
    made = F.to_json(F.struct(F.transform(F.sequence(F.lit(1), F.col("p_size") % 5 + 1), lambda i: F.struct(F.when(i % 2 == 0, "audio").otherwise("video").alias("codec_type"))).alias("streams")))
    s = F.from_json(made, "streams array<struct<codec_type:string>>")["streams"]
    p = table(spark, sf, "part").select("p_partkey", F.posexplode(s).alias("stream", "x"))
    n = F.row_number().over(Window.partitionBy("p_partkey", F.col("x.codec_type")).orderBy("stream")) - 1
    return p.select("p_partkey", F.col("stream").cast("long").alias("stream"), F.when(F.col("x.codec_type") == "audio", n).cast("long").alias("ordinal"))


@query("a28_sidecar_discovery", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'exact.srt' WHEN p_size % 4 = 1 THEN 'prefix.ja.srt' END AS sidecar, p_size % 4 = 2 AS ambiguous FROM part")
def sidecars(spark: SparkSession, sf: str) -> DataFrame:
    """The exact stem first, then a single file with the stem as prefix; several are ambiguous."""
    s = F.col("p_size") % 4
    sides = F.when(s == 0, F.array(F.lit("exact.srt"), F.lit("exact.en.srt"))).when(s == 1, F.array(F.lit("prefix.ja.srt"))).when(s == 2, F.array(F.lit("two.a.srt"), F.lit("two.b.ass"))).otherwise(F.array().cast("array<string>"))
    stem = F.when(s == 0, "exact").when(s == 1, "prefix").otherwise("two")
    p = table(spark, sf, "part").select("p_partkey", stem.alias("stem"), F.explode_outer(sides).alias("f"))
    tier = F.when(F.col("f") == F.concat("stem", F.lit(".srt")), 0).when(F.col("f").isNotNull(), 1)
    best = p.withColumn("tier", tier).groupBy("p_partkey").agg(F.min("tier").alias("t"), F.collect_list(F.struct("tier", "f")).alias("l"))
    hits = F.filter("l", lambda x: x["tier"] == F.col("t"))
    return best.select("p_partkey", F.when(F.size(hits) == 1, F.get(hits, 0)["f"]).alias("sidecar"), (F.size(hits) > 1).alias("ambiguous"))


@query("o03_coverage_report", """WITH e AS (SELECT o_custkey AS title, o_orderstatus AS grp, (o_orderkey % 12)::INT AS ep FROM orders), t AS (SELECT title, list(DISTINCT ep) AS eps FROM e GROUP BY title),
g AS (SELECT title, grp, list(DISTINCT ep) AS eps FROM e GROUP BY title, grp) SELECT title, grp, len(g.eps) AS episodes, round(len(g.eps) / len(t.eps), 3) AS ratio FROM g JOIN t USING (title) WHERE len(t.eps) >= 3""")
def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    from subtide.operators.coverage import coverage_ratio, group_coverage, title_coverage

    e = table(spark, sf, "orders").select(F.col("o_custkey").alias("title"), F.col("o_orderstatus").alias("grp"), (F.col("o_orderkey") % 12).cast("int").alias("ep"), "o_orderkey", "o_orderpriority")
    t = title_coverage(e, "title", "ep", "o_orderpriority", "o_orderkey").select("title", F.col("episodes").alias("whole"))
    g = group_coverage(e, "title", "grp", "ep", "o_orderkey", "o_orderkey")
    j = g.join(t, "title").where(F.size("whole") >= 3)
    return j.select("title", "grp", F.size("episodes").cast("long").alias("episodes"), F.round(coverage_ratio(F.col("episodes"), F.col("whole")), 3).alias("ratio"))


@query("n09_argmax_to_timestamps", "SELECT vec_id, round((list_position(embedding[1:32], list_max(embedding[1:32])) - 1) * 0.08e0, 4) AS start, round((list_position(embedding[33:64], list_max(embedding[33:64])) - 1) * 0.08e0, 4) AS \"end\" FROM embeddings")
def decode(spark: SparkSession, sf: str) -> DataFrame:
    """Start and end of a token from two rows of scores."""
    best = lambda a: F.round((F.array_position(a, F.array_max(a)) - 1) * 0.08, 4)
    return table(spark, sf, "embeddings").select("vec_id", best(F.slice("embedding", 1, 32)).alias("start"), best(F.slice("embedding", 33, 32)).alias("end"))


@query("n07_line_groups", "SELECT doc_id, printf('src:%04d', i) AS group_id, md5(l[i]) AS digest FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents))")
def line_groups(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    g = table(spark, sf, "documents").select("doc_id", F.posexplode(lines).alias("i", "line"))
    return g.select("doc_id", F.format_string("src:%04d", F.col("i") + 1).alias("group_id"), F.md5("line").alias("digest"))
