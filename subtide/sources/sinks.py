"""Sinks: JSON lines, and versioned stores published by compare and swap.

A store is a folder of versions and a log. Each entry of the log names a version's
tables and the entry before it; it is made by linking a finished file to the next
number, which only one writer can do. The other fails and its data is removed. Readers follow the
last entry, so they never see a version half written.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

LOG = "_log"


class ConcurrentPublication(RuntimeError):
    """Another writer has published since this one looked."""


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines that keep null fields (B18); fails where the path exists."""
    df.write.option("ignoreNullFields", "false").mode("errorifexists").json(path)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _unhashable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_unhashable(f.dataType) for f in kind.fields)
    return isinstance(kind, (MapType, VariantType)) or isinstance(kind, ArrayType) and _unhashable(kind.elementType)


def content_digest(df: DataFrame) -> str:
    """A digest of the schema and the bag of rows, whatever their order: two sums of 64-bit hashes, and the count.

    Column order does not count. Maps and variants go by their JSON.
    """
    names = sorted(df.columns)
    columns = [F.to_json(F.struct(F.col(f"`{n}`"))) if _unhashable(df.schema[n].dataType) else F.col(f"`{n}`") for n in names]
    # A null column leaves xxhash64 as it was, so nulls are told by a mask.
    nulls = F.concat(*[F.col(f"`{n}`").isNull().cast("int").cast("string") for n in names]) if names else F.lit("")
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns, nulls).cast("decimal(38,0)"))
    row = df.agg(F.count(F.lit(1)).alias("n"), total(1).alias("a"), total(2).alias("b")).first()
    schema = ",".join(f"{n}:{df.schema[n].dataType.simpleString()}" for n in names)
    return f"{row['n']}-{(int(row['a'] or 0)) % 2**64:016x}{(int(row['b'] or 0)) % 2**64:016x}-{uuid.uuid5(uuid.NAMESPACE_OID, schema).hex}"


def _entries(spark: SparkSession, base: str) -> list[int]:
    fs, folder = _path(spark, f"{base}/{LOG}")
    if not fs.exists(folder):
        return []
    return sorted(int(n[:-5]) for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.endswith(".json") and n[:-5].isdigit())


def _read(spark: SparkSession, path: str) -> dict:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def head(spark: SparkSession, base: str) -> dict | None:
    """The last entry of the log: ``number``, ``previous``, ``version``, ``tables`` and ``digests``; None before the first."""
    numbers = _entries(spark, base)
    return _read(spark, f"{base}/{LOG}/{numbers[-1]:010d}.json") if numbers else None


def _append(spark: SparkSession, base: str, entry: dict) -> None:
    """Makes the entry under its number, or fails where that number is taken."""
    target, draft = f"{base}/{LOG}/{entry['number']:010d}.json", f"{base}/{LOG}/.{uuid.uuid4().hex}"
    fs, p = _path(spark, draft)
    fs.mkdirs(p.getParent())
    out = fs.create(p, False)
    out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
    out.close()
    _, to = _path(spark, target)
    try:
        if fs.getScheme() == "file":  # a rename on a local disk may replace a file made meanwhile; a link may not
            os.link(p.toUri().getPath(), to.toUri().getPath())
        else:
            hadoop = spark._jvm.org.apache.hadoop.fs
            none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
            none[0] = hadoop.Options.Rename.NONE
            hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(p), fs.makeQualified(to), none)
    except Exception as e:
        if fs.exists(to):
            raise ConcurrentPublication(f"entry {entry['number']} of {base} was made by another writer") from e
        raise
    finally:
        if fs.exists(p):
            fs.delete(p, False)


def publish(
    df: DataFrame | dict[str, DataFrame], base: str, checks: dict[str, str] | None = None, *, after: int | None = None, carry: Sequence[str] = (),
) -> str:
    """Writes the tables as a new version and makes it the current one, unless another was published meanwhile.

    ``checks`` name SQL aggregates that must be true over the written rows of the
    main table. ``after`` is the number of the entry that the caller has read (0: none); by default the last one
    before writing. ``carry`` names tables of the last version that go on as they are, by
    reference. Where all tables equal the last version's, by content, nothing is published and its name is returned.
    """
    tables = df if isinstance(df, dict) else {"main": df}
    spark = next(iter(tables.values())).sparkSession
    last = head(spark, base)
    before = last["number"] if last else 0
    if after is not None and after != before:
        raise ConcurrentPublication(f"{base} is at entry {before}, not {after}")
    version = f"v-{uuid.uuid4().hex}"
    fs, folder = _path(spark, f"{base}/{version}")
    try:
        paths, digests = {}, {}
        for name, t in tables.items():
            paths[name] = f"{version}/{name}"
            t.write.parquet(f"{base}/{paths[name]}")
            written = spark.read.parquet(f"{base}/{paths[name]}")
            if checks and name == next(iter(tables)):
                row = written.agg(*[F.expr(e).alias(n) for n, e in checks.items()]).first()
                failed = [n for n in checks if not row[n]]
                if failed:
                    raise ValueError(f"checks failed: {', '.join(failed)}")
            digests[name] = content_digest(written)
        for name in carry:
            if name not in tables and last and name in last["tables"]:
                paths[name], digests[name] = last["tables"][name], last["digests"][name]
        if last and digests == last["digests"]:
            fs.delete(folder, True)
            return last["version"]
        _append(spark, base, {"number": before + 1, "previous": before, "version": version, "tables": paths, "digests": digests})
    except BaseException:
        fs.delete(folder, True)
        raise
    return version


def current(spark: SparkSession, base: str, table: str = "main") -> DataFrame:
    """A table of the current version."""
    last = head(spark, base)
    if last is None:
        raise FileNotFoundError(f"nothing is published at {base}")
    return spark.read.parquet(f"{base}/{last['tables'][table]}")


def history(spark: SparkSession, base: str) -> list[dict]:
    """All entries of the log, from the first."""
    return [_read(spark, f"{base}/{LOG}/{n:010d}.json") for n in _entries(spark, base)]


def vacuum(spark: SparkSession, base: str, keep: int = 2) -> list[str]:
    """Removes versions that none of the last ``keep`` entries reads, crashed ones included; returns their names.

    Only while no writer is at work: a version being written is in no entry yet.
    """
    used = {p.split("/")[0] for e in history(spark, base)[-keep:] for p in e["tables"].values()}
    fs, folder = _path(spark, base)
    gone = [s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in used]
    for name in gone:
        fs.delete(_path(spark, f"{base}/{name}")[1], True)
    return sorted(gone)
