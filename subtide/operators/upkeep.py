"""Index upkeep: incremental comparison, upserts, caches with lifetimes, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff_listing(old: DataFrame, new: DataFrame, key: str, marks: Sequence[str]) -> DataFrame:
    """(key, change): added, refreshed, unchanged or removed, by equal marks such as size and time."""
    a = old.select(key, F.struct(*marks).alias("_a"))
    b = new.select(key, F.struct(*marks).alias("_b"))
    same = F.col("_a").eqNullSafe(F.col("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(same, "unchanged").otherwise("refreshed")
    return a.join(b, key, "full").select(key, change.alias("change"))


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with rows of ``updates`` in place of those with the same keys."""
    return base.join(updates.select(*keys).distinct(), list(keys), "left_anti").unionByName(updates.select(*base.columns))


def override(low: DataFrame, high: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union in which rows of ``high`` replace those of ``low`` with the same keys."""
    return upsert(low, high, keys)


def patch(base: DataFrame, updates: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``base`` with one column replaced where an update has it; nothing else changes."""
    u = updates.select(*keys, F.col(column).alias("_u"))
    return base.join(u, list(keys), "left").withColumn(column, F.coalesce("_u", column)).drop("_u").select(*base.columns)


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def increments(counters: DataFrame, deltas: DataFrame, key: str, value: str) -> DataFrame:
    """Counters with deltas added, new keys included."""
    return counters.select(key, value).unionByName(deltas.select(key, value)).groupBy(key).agg(F.sum(value).alias(value))


def latest(values: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """The last value put under each key."""
    return values.groupBy(key).agg(F.max(F.struct(F.col(at).alias("a"), F.col(value).alias("v"))).alias("_m")).select(key, F.col("_m.v").alias(value))


def first_path_wins(rows: DataFrame, key: str, path: str) -> DataFrame:
    """``rows`` with ``duplicate``: an id seen under an earlier path."""
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy(key).orderBy(path)) > 1)


def lifetime(status: Column, airing: int = 7 * 86400, finished: int = 30 * 86400) -> Column:
    """Seconds that a cached row stays fresh, by its status."""
    return F.when(F.upper(F.trim(status)) == "FINISHED", finished).otherwise(airing)


def fresh(expires: Column, now: Column) -> Column:
    """Strictly before expiry; a row on the boundary has expired."""
    return expires > now


def cache_outcome(hit: Column, is_fresh: Column, negative: Column, fetched: Column) -> Column:
    """What a read-through cache answers with: fresh, negative, fetched, stale or miss."""
    return (
        F.when(hit & is_fresh & negative, "negative").when(hit & is_fresh, "fresh").when(fetched, "fetched").when(hit & ~negative, "stale").otherwise("miss")
    )


def resume(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items of ``work`` not done under the same fingerprint, nulls equal."""
    on = None
    d = done.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = c if on is None else on & c
    return work.join(d, on, "left_anti")


def stale(current: DataFrame, built: DataFrame, key: str, fingerprint: str, rows: str) -> DataFrame:
    """``current`` (key, fingerprint) with ``rebuild``: nothing built, another fingerprint, or no rows."""
    b = built.select(key, F.col(fingerprint).alias("_f"), F.col(rows).alias("_n"))
    kept = F.coalesce((F.col("_f") == F.col(fingerprint)) & (F.col("_n") > 0), F.lit(False))
    return current.join(b, key, "left").withColumn("rebuild", ~kept).drop("_f", "_n")


def guarded_replace(old: DataFrame, new: DataFrame, roots: DataFrame, root: str, available: str) -> DataFrame:
    """The rows of ``new`` for roots that are available and those of ``old`` for the others, whole."""
    there = roots.where(F.coalesce(F.col(available), F.lit(False))).select(root)
    return new.join(there, root, "left_semi").unionByName(old.join(there, root, "left_anti"))


def positive_or_negative(wanted: DataFrame, fetched: DataFrame, key: str, payload: Column, expires: Column, negative_expires: Column) -> DataFrame:
    """(key, payload, negative, expires_at) to cache: a fetched row flattened, ``{}`` where nothing was found."""
    j = wanted.select(key).distinct().join(fetched.withColumn("_hit", F.lit(True)), key, "left")
    hit = F.col("_hit").isNotNull()
    return j.select(key, F.when(hit, payload).otherwise("{}").alias("payload"), (~hit).alias("negative"), F.when(hit, expires).otherwise(negative_expires).alias("expires_at"))


def unresolved(rows: DataFrame, decisions: DataFrame, keys: Sequence[str], ambiguous: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that are clear or decided, rows to ask about): decisions stand in for a prompt."""
    decided = decisions.select(*keys).distinct()
    asked = rows.where(ambiguous)
    return rows.where(~F.coalesce(ambiguous, F.lit(False))).unionByName(asked.join(decided, list(keys), "left_semi")), asked.join(decided, list(keys), "left_anti")


def insert_batches(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """``rows`` with the number of their insert ``batch`` from 0, ``size`` rows of a key each, the last one smaller."""
    if size < 1:
        raise ValueError("a batch has at least one row")
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size))


def running_counts(rows: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """(keys, at, total): rows of a key up to and with each ``at`` (M13); rows are counted per ``at`` before any window."""
    n = rows.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("n"))
    return n.select(*keys, at, F.sum("n").over(Window.partitionBy(*keys).orderBy(at)).alias("total"))
