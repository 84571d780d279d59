"""A sink of one named file per source or shard, published in one step or not at all.

Tasks write into a staging folder beside the target and send each file's size
and SHA-256 with their commit message. The commit checks them, writes
``_manifest.json`` into the staging folder last, and renames the folder to its
target. A job that fails leaves no target; a target that exists is never
overwritten. A task that is run again writes under a name of its own, and only files of tasks
that were committed are named and kept.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from subtide.sources.storage import exists, located, safe_name

MANIFEST = "_manifest.json"


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (name, temporary path, size, sha256)."""

    files: list[tuple[str, str, int, str]]


class _Open:
    """One file being written, with what it is expected to be."""

    def __init__(self, fs: pa_fs.FileSystem, path: str, name: str):
        self.name, self.path, self.size, self.hash, self.wants = name, path, 0, hashlib.sha256(), None
        self.out = fs.open_output_stream(path, compression=None)

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)
        self.hash.update(data)

    def done(self) -> tuple[str, str, int, str]:
        self.out.close()
        found = (self.size, self.hash.hexdigest())
        if self.wants:
            size, digest = self.wants
            if size is not None and size != found[0]:
                raise ValueError(f"{self.name} has {found[0]} bytes, not {size}")
            if digest is not None and digest.lower() != found[1]:
                raise ValueError(f"{self.name} has the checksum {found[1]}, not {digest}")
        return self.name, self.path, *found


class NamedFilesWriter(DataSourceArrowWriter):
    """Rows (name, data[, size, sha256]), those of a file together and in order."""

    def __init__(self, target: str, stage: str):
        self.target, self.stage = target, stage

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, stage = located(self.stage)
        attempt, files, now, names = uuid.uuid4().hex, [], None, set()
        for batch in iterator:
            has = set(batch.schema.names)
            sizes = batch["size"].to_pylist() if "size" in has else [None] * len(batch)
            digests = batch["sha256"].to_pylist() if "sha256" in has else [None] * len(batch)
            for name, data, size, digest in zip(batch["name"].to_pylist(), batch["data"].to_pylist(), sizes, digests, strict=True):
                if now is None or now.name != name:
                    if now is not None:
                        files.append(now.done())
                    if not name or not safe_name(name) or name == MANIFEST or name in names:
                        raise ValueError(f"{name!r} is no file name, or its rows are not together")
                    names.add(name)
                    path = f"{stage}/.{attempt}-{len(names)}"
                    fs.create_dir(stage, recursive=True)
                    now = _Open(fs, path, name)
                    now.wants = (size, digest)
                now.add(data.encode() if isinstance(data, str) else data or b"")
        if now is not None:
            files.append(now.done())
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, stage = located(self.stage)
        target = located(self.target)[1]
        files = sorted(f for m in messages if m is not None for f in m.files)
        names = [f[0] for f in files]
        if len(set(names)) < len(names):
            raise ValueError("two tasks wrote a file of one name")
        fs.create_dir(stage, recursive=True)
        for name, path, size, _ in files:
            if fs.get_file_info(path).size != size:
                raise OSError(f"{name} is not whole")
            if "/" in name:
                fs.create_dir(f"{stage}/{name.rsplit('/', 1)[0]}", recursive=True)
            fs.move(path, f"{stage}/{name}")
        for left in fs.get_file_info(pa_fs.FileSelector(stage)):
            if left.base_name.startswith("."):  # of attempts that were not committed
                fs.delete_file(left.path)
        with fs.open_output_stream(f"{stage}/{MANIFEST}", compression=None) as out:
            listed = [{"name": n, "size": s, "sha256": h} for n, _, s, h in files]
            out.write(json.dumps({"files": listed}, ensure_ascii=False, sort_keys=True).encode())
        if exists(fs, target):
            raise FileExistsError(f"{self.target} exists")
        fs.move(stage, target)

    def abort(self, messages: list[Written | None]) -> None:
        fs, stage = located(self.stage)
        if exists(fs, stage):
            fs.delete_dir(stage)


class NamedFiles(DataSource):
    """``df.write.format("named_files").mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        target = self.options["path"].rstrip("/")
        if exists(*located(target)):
            raise FileExistsError(f"{target} exists")
        folder, _, leaf = target.rpartition("/")
        return NamedFilesWriter(target, f"{folder}/.{leaf}-{uuid.uuid4().hex}")


def write_named_files(df: DataFrame, folder: str, name: str | Column, data: str | Column, order: Sequence[str | Column] = (), size: str | None = None, sha256: str | None = None) -> None:
    """One file per ``name`` under ``folder``, its rows' ``data`` in ``order``, with a manifest.

    ``size`` and ``sha256`` name columns that a file must agree with: one that does not fails the write (B36).
    Fails where ``folder`` exists (B29).
    """
    spark = df.sparkSession
    spark.dataSource.register(NamedFiles)
    of = lambda c: F.col(c) if isinstance(c, str) else c
    columns = [of(name).alias("name"), of(data).cast("binary").alias("data"), *[F.col(c).alias(n) for c, n in ((size, "size"), (sha256, "sha256")) if c]]
    keys = [f"_o{i}" for i in range(len(order))]
    rows = df.select(*columns, *[of(o).alias(k) for o, k in zip(order, keys, strict=True)])
    placed = rows.repartition("name").sortWithinPartitions("name", *keys).drop(*keys)
    placed.write.format("named_files").mode("append").save(folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size, sha256) of a published folder; read in a task, as Spark's sources pass over names that start with an underscore."""

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b["path"].to_pylist():
                fs, path = located(p)
                with fs.open_input_stream(path, compression=None) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([f.read().decode()])], names=["value"])

    whole = spark.createDataFrame([(f"{folder.rstrip('/')}/{MANIFEST}",)], "path string").mapInArrow(text, "value string")
    files = whole.select(F.explode(F.from_json("value", "files array<struct<name:string,size:long,sha256:string>>")["files"]).alias("f"))
    return files.select("f.*")


def read_named_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, data, ok): the files that the manifest names, and whether size and checksum still agree."""
    base = folder.rstrip("/")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, size, digest in zip(*[b[c].to_pylist() for c in ("name", "size", "sha256")], strict=True):
                fs, path = located(f"{base}/{name}")
                data = None
                if exists(fs, path):
                    with fs.open_input_stream(path, compression=None) as f:
                        data = f.read()
                ok = data is not None and len(data) == size and hashlib.sha256(data).hexdigest() == digest
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary()), pa.array([ok])], names=["name", "data", "ok"])

    return manifest(spark, folder).repartition("name").mapInArrow(read, "name string, data binary, ok boolean")
