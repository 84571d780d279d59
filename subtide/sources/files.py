"""File scans: JSON lines, id lists, CSV with a declared schema; JSON arrays are read by ``json_arrays``."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subtide.sources.json_arrays import read_json_array  # noqa: F401
from subtide.sources.storage import located


def read_csv(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """CSV with quoted line feeds under a declared schema; rows without a key are dropped."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"').where(F.col(key).isNotNull())


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """JSON lines, plain or gzipped; a malformed line fails the read, blank ones are skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_jsonl_split(spark: SparkSession, path: str | Sequence[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their path, error rows of lines that are not such objects)."""
    raw = spark.read.text(path).where("trim(value) <> ''").select("value", F.col("_metadata.file_path").alias("path"))
    parsed = raw.withColumn("_v", F.try_parse_json("value")).withColumn("_r", F.from_json("value", schema))
    good = F.col("_v").isNotNull() & F.col("value").rlike(r"^\s*\{")
    return parsed.where(good).select("path", "_r.*"), parsed.where(~good).select("path", F.lit("invalid_jsonl").alias("error_kind"), F.col("value").alias("line"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(position, id): ids of a text file, ``#`` starts a comment, first appearance counts."""
    raw = spark.read.text(path, wholetext=True)
    lines = raw.select(F.posexplode(F.split("value", "\n")).alias("position", "line"))
    ids = lines.select("position", F.trim(F.get(F.split("line", "#"), 0)).alias("id")).where("id <> ''")
    return ids.groupBy("id").agg(F.min("position").alias("position")).select("position", "id")


def _read_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole files of paths with a scheme or without, in the task."""
    for b in batches:
        texts = []
        for p in b["path"].to_pylist():
            where, path = located(p)
            with where.open_input_stream(path, compression=None) as stream:
                texts.append(stream.read().decode("utf-8"))
        yield pa.RecordBatch.from_arrays([b["path"], pa.array(texts, pa.string())], names=["path", "value"])


def read_texts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, value): whole texts of named files, dot-files included.

    Plain names are read by Spark. Its file sources pass over names that start with
    a point, so those are dealt to tasks as rows and opened there.
    """
    hidden = [p for p in paths if p.rsplit("/", 1)[-1].startswith(".")]
    plain = [p for p in paths if p not in set(hidden)]
    parts = []
    if plain:
        parts.append(spark.read.text(plain, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))
    if hidden or not plain:
        names = spark.createDataFrame([(p,) for p in hidden], "path string")
        parts.append(names.repartition(max(1, min(len(hidden), 64))).mapInArrow(_read_here, "path string, value string"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def expand_inputs(listing: DataFrame, patterns: Sequence[str], extensions: Sequence[str], path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(argument, path) of the listed files that the glob arguments name, each under its first argument; and the unsupported ones.

    ``*`` and ``?`` stay within a folder, ``**`` does not.
    """
    regex = lambda g: "^" + re.sub(r"\\\*\\\*|\\\*|\\\?", lambda m: {r"\*\*": ".*", r"\*": "[^/]*", r"\?": "[^/]"}[m[0]], re.escape(g)) + "$"
    first = F.lit(None).cast("int")
    for i, g in reversed(list(enumerate(patterns))):
        first = F.when(F.col(path).rlike(regex(g)), i).otherwise(first)
    named = listing.select(path).distinct().select(first.alias("argument"), path).where("argument IS NOT NULL")
    good = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*extensions)
    return named.where(good), named.where(~good)


def discover_media(listing: DataFrame, extensions: Sequence[str], path: str = "path") -> DataFrame:
    """(folder, path, place): files of the allowed extensions, resource forks (``._name``) left out, in order of their lower-cased names."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    kept = listing.where(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*extensions) & ~name.startswith("._"))
    rows = kept.select(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"), path, F.lower(name).alias("_n"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy("_n", path))).drop("_n")
