"""Typed records: validated projections, manifests, requests, reports and review rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def project(df: DataFrame, fields: Sequence[str], reserved: Sequence[str] = ()) -> DataFrame:
    """``df`` with the asked fields; an unknown or reserved one fails."""
    unknown = [f for f in fields if f not in df.columns]
    forbidden = [f for f in fields if f in reserved]
    if unknown or forbidden:
        raise ValueError(f"unknown fields: {unknown}; reserved fields: {forbidden}")
    return df.select(*dict.fromkeys(fields))


def detail(df: DataFrame, key: str, value: object, fields: Sequence[str], decoded: dict[str, str]) -> DataFrame:
    """One record's fields, JSON columns decoded by their schema where valid."""
    row = project(df.where(F.col(key) == F.lit(value)), fields)
    for c, schema in decoded.items():
        if c in fields:
            row = row.withColumn(c, F.from_json(c, schema))
    return row


MANIFEST = (
    "schema_version int, kind string, series struct<id:bigint,title:string>, profile struct<name:string,codec:string>, "
    "episodes array<struct<episode_key:string,relative_path:string,size_bytes:bigint>>"
)


def load_manifests(texts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(series, artifacts, error rows) of manifest texts (path, value) against a file listing (path).

    A manifest that does not parse, has another version, or names a missing file is
    rejected whole with one error row; paths of files are relative to the manifest's folder.
    """
    m = texts.select("path", F.from_json("value", MANIFEST).alias("m")).withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    valid = F.col("m.series.id").isNotNull() & (F.col("m.schema_version") == 1) & (F.col("m.kind") == "audio")
    e = m.where(valid).select("path", "folder", F.explode("m.episodes").alias("e")).select("path", F.concat_ws("/", "folder", "e.relative_path").alias("file"), "e.*")
    lost = e.join(files.select(F.col("path").alias("file")), "file", "left_anti").select("path").distinct()
    invalid = m.where(~F.coalesce(valid, F.lit(False))).select("path", F.lit("invalid_manifest").alias("code"))
    errors = invalid.unionByName(lost.select("path", F.lit("missing_artifact").alias("code")))
    good = m.where(valid).join(lost, "path", "left_anti")
    series = good.select("path", F.col("m.series.id").alias("series_id"), F.col("m.series.title").alias("title"), F.col("m.profile.name").alias("profile"))
    return series, e.join(good.select("path", F.col("m.series.id").alias("series_id")), "path").select("path", "series_id", "episode_key", "file", "size_bytes"), errors


def window_manifest(windows: DataFrame, source: str, text: str = "text") -> DataFrame:
    """(custom_id, source, indexes, texts, before, after) rows of cue windows."""
    from subtide.functions.text import window_id

    texts = F.transform("active", lambda c: c[text])
    ident = window_id(F.col(source).cast("string"), F.col("window"), F.array_join(texts, "\n"))
    side = lambda c: F.transform(c, lambda x: x[text])
    return windows.select(
        ident.alias("custom_id"), source, "window", F.transform("active", lambda c: c["index"]).alias("indexes"), texts.alias("texts"), side("before").alias("before"), side("after").alias("after")
    )


RESPONSE_SCHEMA = '{"type": "object", "properties": {"decisions": {"type": "array"}}, "required": ["decisions"]}'


def batch_requests(manifest: DataFrame, model: str, system: str) -> DataFrame:
    """(custom_id, body): one request a window, with the answer's JSON schema as a literal."""
    from subtide.functions.text import cue_tags

    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.to_json(F.struct(
        F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", cue_tags(F.col("texts")))).alias("messages"), F.lit(RESPONSE_SCHEMA).alias("response_schema")
    ))
    return manifest.select("custom_id", body.alias("body"))


def dead_letters(errors: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Error rows with the manifest row embedded, null where there is none."""
    known = manifest.select(key, F.struct(*[c for c in manifest.columns]).alias("manifest"))
    return errors.join(known, key, "left")


def decision_log(cues: DataFrame, decisions: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row a decision: what was shown, decided and emitted, in source and place order."""
    j = decisions.join(cues, list(keys), "left")
    out = F.when(F.col("decision") == "remove", F.lit(None)).when(F.col("decision") == "edit", F.col("new_text")).otherwise(F.col(text))
    return j.select(*keys, F.col(text).alias("source_text"), "decision", out.alias("emitted_text"), (F.coalesce(out, F.lit("")) != F.col(text)).alias("changed"))


def reconstruction_summary(rows: DataFrame, errors: DataFrame, source: str) -> DataFrame:
    """One row of counts of sources, cues, errors and blocked sources."""
    a = rows.agg(F.countDistinct(source).alias("sources"), F.count(F.lit(1)).alias("cues"))
    b = errors.agg(F.count(F.lit(1)).alias("errors"), F.countDistinct(source).alias("blocked"))
    return a.join(F.broadcast(b))


def segments_of(payload: Column, chunk_start: Column, chunk_length: Column) -> Column:
    """array<struct<start, end, text>> of a model's segments under alternative keys, clamped to the chunk.

    Times may carry an ``s``; a start before the chunk's is relative to it, an end
    within the chunk's length is; both rules stand apart, as in the source data.
    """
    raw = F.from_json(payload, "array<struct<start:string,start_time:string,end:string,end_time:string,text:string,content:string>>")
    seconds = lambda a, b: F.regexp_replace(F.coalesce(a, b), "s$", "").try_cast("double")

    def one(x: Column) -> Column:
        s, e = seconds(x["start"], x["start_time"]), seconds(x["end"], x["end_time"])
        s, e = F.when(s < chunk_start, s + chunk_start).otherwise(s), F.when(e <= chunk_length, e + chunk_start).otherwise(e)
        lo, hi = chunk_start, chunk_start + chunk_length
        clamp = lambda v: F.least(hi, F.greatest(lo, v))
        return F.struct(clamp(s).alias("start"), clamp(e).alias("end"), F.coalesce(x["text"], x["content"]).alias("text"))

    return F.filter(F.transform(raw, one), lambda x: x["start"].isNotNull() & x["end"].isNotNull())


def indexed_samples(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with a 1-based local number, to carry in place of positional slicing."""
    return df.withColumn("local", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def report_order(df: DataFrame, status: str, first: str, ratio: str, episodes: str) -> DataFrame:
    """Group report rows: the wanted status first, then the ratio as 3-digit text, then more episodes."""
    return df.orderBy(F.col(status) != first, F.format_string("%.3f", ratio), F.desc(episodes))


def review_rows(manifest: DataFrame, cues: DataFrame, decisions: DataFrame, cleaned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cues of a manifest with their decision and cleaned text, where there are any."""
    out = manifest
    for side in (cues, decisions, cleaned):
        out = out.join(side, list(keys), "left")
    return out


def first_existing(candidates: DataFrame, listing: DataFrame, key: str, path: str, rank: str) -> DataFrame:
    """Each key's best-ranked candidate that is in the listing, null where none is."""
    hit = candidates.join(listing.select(path).distinct().withColumn("_hit", F.lit(True)), path, "left")
    return hit.groupBy(key).agg(F.min(F.when(F.col("_hit"), F.struct(rank, path))).alias("b")).select(key, F.col(f"b.{path}").alias(path))


def column_profile(df: DataFrame) -> DataFrame:
    """(column_name, position, type, filled, different): the schema of a table and how far its columns are filled, in one pass (C20)."""
    counts = df.agg(*[x for i, c in enumerate(df.columns) for x in (F.count(F.col(f"`{c}`")).alias(f"f{i}"), F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}"))])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), F.lit(t).alias("type"), F.col(f"f{i}").alias("filled"), F.col(f"d{i}").alias("different")) for i, (c, t) in enumerate(df.dtypes)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def run_manifest(shards: DataFrame, model: str, shard: str, requests: str) -> DataFrame:
    """One row of a run: model, number of shards, requests, and ``shard=requests`` in the shards' order.

    One row a shard comes in, so the list is as long as the run has files.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct(shard, requests))), lambda x: F.concat_ws("=", x[shard], x[requests].cast("string")))
    return shards.agg(F.lit(model).alias("model"), F.count(F.lit(1)).alias("shards"), F.sum(requests).alias("requests"), F.array_join(listed, ",").alias("listing"))


def review_payloads(cues: DataFrame, decisions: DataFrame, key: str, text: str) -> DataFrame:
    """(key, payload): index, text and decision of each decided cue as JSON; a null text is left out of it."""
    j = cues.select(key, text).join(decisions.select(key, "decision"), key)
    return j.select(key, F.to_json(F.struct(F.col(key).alias("index"), F.col(text).alias("text"), "decision")).alias("payload"))


def field_faults(asked: Column, known: Column, reserved: Column) -> Column:
    """struct<unknown, forbidden>: sorted distinct fields of ``asked`` that are not known, and those that are reserved; null asks for nothing."""
    fields = F.coalesce(asked, F.array().cast("array<string>"))
    return F.struct(
        F.array_sort(F.array_except(fields, known)).alias("unknown"),
        F.array_sort(F.array_intersect(fields, reserved)).alias("forbidden"),
    )


def insert_row(scalars: dict[str, Column], lists: dict[str, Column], numbers: dict[str, Column]) -> list[Column]:
    """Columns of a row to insert: lists as JSON text, null lists as ``[]``, null numbers as 0."""
    return [
        *(c.alias(n) for n, c in scalars.items()),
        *(F.to_json(F.coalesce(c, F.array().cast("array<string>"))).alias(n) for n, c in lists.items()),
        *(F.coalesce(c, F.lit(0)).alias(n) for n, c in numbers.items()),
    ]
