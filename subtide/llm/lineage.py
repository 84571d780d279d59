"""Cutting lineage in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Temporary folders of applications without a shared one, by application id (tests).
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where none is set and the master is local (tests).

    On a cluster each executor would write to a disk of its own, so there the setting must be made.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get().rstrip("/")
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = tempfile.mkdtemp(prefix="subtide-")
        named = _OWN[context.applicationId]
    return named.rstrip("/")


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: no recomputation, no lineage."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    tables = _SCOPE.get()
    if tables is not None:
        tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dropped(df: DataFrame) -> None:
    """Removes the files of a ``stored`` table that nothing reads any more."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if "/table-" in f:
            _delete(df.sparkSession, f)


#: Paths of the tables stored within the scope now open, in this thread.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes on leaving what was ``stored`` inside; keep a result by storing it outside."""
    tables: list[str] = []
    outer = _SCOPE.set(tables)
    try:
        yield
    finally:
        _SCOPE.reset(outer)
        for path in tables:
            _delete(spark, path)


#: Keys with more rows than this are hot; up to ``MOST_HOT`` of them are broadcast.
HOT, MOST_HOT = 1000, 200_000


def join_unique(left: DataFrame, right: DataFrame, on: list[str], how: str, weight: str) -> DataFrame:
    """An inner or left-semi join with a stored ``right`` of unique keys whose ``weight`` counts the rows they meet.

    Rows of hot keys are joined by broadcast where they lie, the rest by shuffle,
    so a key with a third of all rows does not meet in one task. There are fewer
    hot keys than rows of ``left`` over ``HOT``; should they pass ``MOST_HOT``, one shuffled join does it all.
    """
    heavy = right.where(F.col(weight) > HOT)
    if not 0 < heavy.count() <= MOST_HOT:
        return left.join(right.drop(weight), on, how)
    here = left.join(F.broadcast(heavy.drop(weight)), on, how)
    rest = left.join(F.broadcast(heavy.select(*on)), on, "left_anti")
    return here.unionByName(rest.join(right.where(F.col(weight) <= HOT).drop(weight), on, how))
