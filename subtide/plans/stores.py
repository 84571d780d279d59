"""Queries over files: rows of the tables are written as files of each kind, and read back by the library's scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.functions import unicode as U
from subtide.operators import records as R
from subtide.plans.registry import query
from subtide.session import table
from subtide.sources import files, json_arrays, named_files, sinks
from subtide.sources.storage import scratch
from subtide.streaming.manifests import SCHEMA, Manifests


@query("a01_csv_scan", "SELECT CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey::VARCHAR END AS id, s_name || ', \"x\"' || chr(10) || s_nationkey AS name FROM supplier WHERE s_suppkey % 7 > 0")
def csv(spark: SparkSession, sf: str) -> DataFrame:
    """Quoted line feeds and quotes; rows without an id are dropped."""
    out = scratch(spark)
    name = F.concat("s_name", F.lit(', "x"\n'), F.col("s_nationkey").cast("string"))
    rows = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 7 > 0, F.col("s_suppkey").cast("string")).alias("id"), name.alias("name"))
    rows.write.option("header", True).option("escape", '"').csv(out)
    return files.read_csv(spark, out, "id string, name string")


_ARRAY = "SELECT p_size % 5 AS doc, row_number() OVER (PARTITION BY p_size % 5 ORDER BY p_partkey) AS row_id, p_partkey AS id, p_name || ' \\\"], [' AS name FROM part"


@query("a02_json_array_elements", _ARRAY)
def json_array(spark: SparkSession, sf: str) -> DataFrame:
    """Five documents, each one array, read by ranges of 64 KB."""
    out = scratch(spark)
    p = table(spark, sf, "part").select((F.col("p_size") % 5).alias("doc"), F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(' \\"], [')).alias("name"))
    first = p.groupBy("doc").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    text = F.concat(F.when(F.col("id") == F.col("first"), "[\n").otherwise(",\n"), F.to_json(F.struct("doc", "id", "name")), F.when(F.col("id") == F.col("last"), "\n]").otherwise(""))
    lines = p.join(first, "doc").select(F.concat(F.lit("d"), F.col("doc").cast("string"), F.lit(".json")).alias("file"), "id", text.alias("text"))
    named_files.write_named_files(lines, out, "file", "text", ["id"])
    read = json_arrays.read_json_array(spark, f"{out}/d*.json", "struct<doc:bigint,id:bigint,name:string>", 1 << 16)
    return read.select(F.col("doc").cast(p.schema["doc"].dataType).alias("doc"), "row_id", F.col("id").cast(p.schema["id"].dataType).alias("id"), "name")


@query("a03_jsonl_strict", "SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size > 20 THEN p_size END AS size FROM part")
def jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """Plain and gzipped lines side by side (A05), a malformed one would fail the read."""
    out = scratch(spark)
    line = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 20, F.col("p_size")).alias("size")))
    p = table(spark, sf, "part")
    p.where("p_partkey % 2 = 0").select(line.alias("value")).write.text(f"{out}/plain")
    p.where("p_partkey % 2 = 1").select(line.alias("value")).write.option("compression", "gzip").text(f"{out}/gz")
    size = p.schema["p_size"].dataType.simpleString()
    return files.read_jsonl(spark, [f"{out}/plain", f"{out}/gz"], f"id {p.schema['p_partkey'].dataType.simpleString()}, name string, size {size}")


@query("a04_jsonl_errors", "SELECT CASE WHEN p_partkey % 9 IN (2, 5) THEN 'invalid_jsonl' ELSE 'good' END AS kind, count(*) AS n, sum(CASE WHEN p_partkey % 9 NOT IN (2, 5) THEN p_partkey END)::BIGINT AS ids FROM part GROUP BY 1")
def jsonl_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that are cut off or are no objects become error rows."""
    out = scratch(spark)
    line, k = F.to_json(F.struct(F.col("p_partkey").alias("id"), "p_name")), F.col("p_partkey") % 9
    table(spark, sf, "part").select(F.when(k == 2, F.substr(line, F.lit(1), F.lit(9))).when(k == 5, F.lit("[1]")).otherwise(line).alias("value")).write.text(out)
    good, bad = files.read_jsonl_split(spark, out, "id long, p_name string")
    kinds = good.select(F.lit("good").alias("kind"), "id").unionByName(bad.select(F.col("error_kind").alias("kind"), F.lit(None).cast("long").alias("id")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def _library(spark: SparkSession, sf: str) -> str:
    """A folder a supplier with a manifest that starts with a point."""
    out = scratch(spark)
    s = table(spark, sf, "supplier")
    text = F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title")))
    named_files.write_named_files(s, out, F.concat(F.lit("t"), F.col("s_suppkey").cast("string"), F.lit("/.media.json")), text)
    return out


@query("a07_hidden_metadata_files", "SELECT 't' || s_suppkey AS folder, s_suppkey AS id, s_name AS title FROM supplier")
def hidden(spark: SparkSession, sf: str) -> DataFrame:
    """Dot-files one folder deep (A08), which Spark's own sources pass over."""
    out = _library(spark, sf)
    named = named_files.read_named_files(spark, out).where("ok")
    read = F.from_json(F.col("data").cast("string"), "id bigint, title string")
    return named.where(F.col("name").rlike(r"^[^/]+/\.media\.json$")).select(F.substring_index("name", "/", 1).alias("folder"), read.alias("m")).select("folder", "m.id", "m.title")


@query("m02_manifest_events", "SELECT 't' || s_suppkey || '/.media.json' AS path, 'added' AS change, s_name AS title FROM supplier")
def manifest_events(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming source over a library of manifests, until it has caught up."""
    library, work = _library(spark, sf), scratch(spark)
    spark.dataSource.register(Manifests)
    stream = spark.readStream.format("manifests").option("state", f"{work}/state").load(library)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{work}/checkpoint").option("path", f"{work}/events").trigger(availableNow=True).start()
    q.awaitTermination()
    events = spark.read.schema(SCHEMA).parquet(f"{work}/events")
    return events.select("path", "change", F.from_json("value", "title string")["title"].alias("title"))


@query(
    "a10_versioned_manifests",
    """SELECT 'lib/s' || s_suppkey || '/m.json' AS path, CASE WHEN s_suppkey % 5 = 1 OR s_suppkey % 5 = 2 OR s_suppkey % 5 = 3 THEN 'invalid_manifest' WHEN s_suppkey % 5 = 4 THEN 'missing_artifact' ELSE 'good' END AS code,
       CASE WHEN s_suppkey % 5 = 0 THEN 2 ELSE 0 END::BIGINT AS artifacts FROM supplier""",
)
def versioned(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests of another version, another kind (A11) or cut off, and ones that name files that are not there."""
    k = F.col("s_suppkey") % 5
    episode = lambda n: F.struct(F.lit(n).alias("episode_key"), F.lit(f"S01E00{n}.m4a").alias("relative_path"), F.lit(9).alias("size_bytes"))
    body = F.struct(
        F.when(k == 1, 2).otherwise(1).alias("schema_version"), F.when(k == 2, "window").otherwise("audio").alias("kind"), F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title")).alias("series"),
        F.struct(F.lit("p").alias("name"), F.lit("aac").alias("codec")).alias("profile"), F.array(episode("1"), episode("2")).alias("episodes"),
    )
    folder = F.concat(F.lit("lib/s"), F.col("s_suppkey").cast("string"))
    s = table(spark, sf, "supplier").withColumn("folder", folder)
    text = F.to_json(body)
    texts = s.select(F.concat("folder", F.lit("/m.json")).alias("path"), F.when(k == 3, F.substr(text, F.lit(1), F.lit(40))).otherwise(text).alias("value"))
    listing = s.select(F.explode(F.array(F.concat("folder", F.lit("/S01E001.m4a")), F.when(k != 4, F.concat("folder", F.lit("/S01E002.m4a"))))).alias("path")).where("path IS NOT NULL")
    series, artifacts, errors = R.load_manifests(texts, listing)
    n = artifacts.groupBy("path").agg(F.count(F.lit(1)).alias("artifacts"))
    good = series.join(n, "path").select("path", F.lit("good").alias("code"), "artifacts")
    return good.unionByName(errors.select("path", "code", F.lit(0).cast("long").alias("artifacts")))


@query("a15_id_list", "SELECT s_nationkey::VARCHAR AS id FROM supplier GROUP BY s_nationkey")
def id_list(spark: SparkSession, sf: str) -> DataFrame:
    """Ids with comments and blank lines, each once."""
    out = scratch(spark)
    line = F.concat(F.lit(" "), F.col("s_nationkey").cast("string"), F.lit("  # "), "s_name", F.lit("\n# none\n\n"))
    named_files.write_named_files(table(spark, sf, "supplier"), out, F.lit("ids.txt"), line, ["s_suppkey"])
    return files.read_id_list(spark, f"{out}/ids.txt").select("id")


@query("a19_metadata_of_another_store", "SELECT r_name AS key, count(n_nationkey)::VARCHAR AS value FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def other_store(spark: SparkSession, sf: str) -> DataFrame:
    """One store keeps the table of keys and values; the other only knows its folder."""
    base = scratch(spark)
    n = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("n_nationkey").alias("n"))
    kept = table(spark, sf, "region").join(n, "r_regionkey", "left").select(F.col("r_name").alias("key"), F.coalesce("n", F.lit(0)).cast("string").alias("value"))
    sinks.publish({"main": table(spark, sf, "nation"), "metadata": kept}, base)
    return sinks.current(spark, base, "metadata")


@query("b03_publish_and_carry", "SELECT 'main' AS name, count(*) AS n, sum(p_partkey)::BIGINT AS ids, 3 AS entry FROM part WHERE p_size > 20 UNION ALL SELECT 'cache', count(*), sum(c_custkey)::BIGINT, 3 FROM customer")
def publish(spark: SparkSession, sf: str) -> DataFrame:
    """A table published twice (B30, B35), equal content once (A18), and a cache carried from the first version."""
    base, part = scratch(spark), table(spark, sf, "part")
    sinks.publish({"main": part, "cache": table(spark, sf, "customer")}, base, {"some": "count(*) > 0", "keys": "count(p_partkey) = count(*)"})
    sinks.publish(part.where("p_size > 10"), base, after=1, carry=["cache"])
    sinks.publish(part.where("p_size > 10").orderBy(F.desc("p_partkey")), base, after=2, carry=["cache"])
    sinks.publish(part.where("p_size > 20"), base, after=2, carry=["cache"])
    entry = F.lit(sinks.head(spark, base)["number"])
    sums = lambda name, key: sinks.current(spark, base, name).agg(F.count(F.lit(1)).alias("n"), F.sum(key).cast("long").alias("ids")).select(F.lit(name).alias("name"), "n", "ids", entry.alias("entry"))
    return sums("main", "p_partkey").unionByName(sums("cache", "c_custkey"))


@query("b18_jsonl_sink", "SELECT p_partkey AS id, (p_size > 20)::INT AS sized, 3 AS fields FROM part")
def jsonl_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Null fields stay in the lines."""
    out = scratch(spark)
    p = table(spark, sf, "part")
    sinks.write_jsonl(p.select(F.col("p_partkey").alias("id"), "p_name", F.when(F.col("p_size") > 20, F.col("p_size")).alias("size")), out)
    line = spark.read.text(out)
    sized = (F.get_json_object("value", "$.size").isNotNull()).cast("int")
    kind = p.schema["p_partkey"].dataType.simpleString()
    return line.select(F.get_json_object("value", "$.id").cast(kind).alias("id"), sized.alias("sized"), F.size(F.json_object_keys("value")).alias("fields"))


@query(
    "b21_shard_files",
    "SELECT 'q' || (o_custkey % 17) || '/shard.jsonl' AS name, octet_length(encode(string_agg(o_orderkey || ' ' || o_orderpriority || chr(10), '' ORDER BY o_orderkey)))::BIGINT AS size, sha256(string_agg(o_orderkey || ' ' || o_orderpriority || chr(10), '' ORDER BY o_orderkey)) AS sha256, true AS ok FROM orders GROUP BY 1",
)
def shards(spark: SparkSession, sf: str) -> DataFrame:
    """One file a shard with a manifest (B26), read back against size and checksum."""
    out = scratch(spark)
    name = F.concat(F.lit("q"), (F.col("o_custkey") % 17).cast("string"), F.lit("/shard.jsonl"))
    named_files.write_named_files(table(spark, sf, "orders"), out, name, F.concat(F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority", F.lit("\n")), ["o_orderkey"])
    return named_files.manifest(spark, out).join(named_files.read_named_files(spark, out).select("name", "ok"), "name").select("name", "size", "sha256", "ok")


@query("j22_visible_lines", r"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split_regex(coalesce(text, '') || ' & fin', '[\n\r\v\f\x1c-\x1e]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS digest FROM documents""")
def visible(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as marked-up text: tags, references and a ligature, then their visible lines."""
    marked = F.concat(F.lit("<p class='x'>"), F.replace(F.coalesce("text", F.lit("")), F.lit(" the "), F.lit("&nbsp;<b>the</b>&#32;")), F.lit(" &amp;　ﬁn</p>"))
    return table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(U.visible_lines(marked), "\n")).alias("digest"))


@query("n05_named_backends", "SELECT user_id, count(*) AS n, count(*) FILTER (length(event_type) > 5) AS long FROM events GROUP BY user_id")
def backends(spark: SparkSession, sf: str) -> DataFrame:
    """A detector chosen by name with its options (N02-N04: rows of chunks to rows of spans go the same way, see ``k15_detect_normalise``)."""
    U.register_backend("detector", "length", lambda least: U.line_detector(lambda s: s.str.len().gt(least).map({True: "long", False: "short"})))
    kind = U.backend("detector", "length", least=5)("event_type")
    return table(spark, sf, "events").select("user_id", kind.alias("kind")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "long").alias("long"))
