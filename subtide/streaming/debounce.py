"""Structured Streaming forms of debouncing, counters and upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(events: DataFrame, key: str, at: str, delay: str, late: str) -> DataFrame:
    """(key, first, last, due, n): bursts with no pause of ``delay``, emitted once the watermark passes."""
    w = F.session_window(at, delay)
    out = events.withWatermark(at, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    return out.select(key, "first", "last", F.col("w.end").alias("due"), "n")


def windowed_counts(events: DataFrame, key: str, at: str, width: str, late: str) -> DataFrame:
    """Counts per key and tumbling window, for counters that only grow."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Each key once while its state lives."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def path_events(events: DataFrame, source: str, target: str, pattern: str) -> DataFrame:
    """(path, other columns): both ends of a move, kept where they match ``pattern``."""
    rest = [c for c in events.columns if c not in (source, target)]
    return events.select(F.explode(F.array(source, target)).alias("path"), *rest).where(F.col("path").isNotNull() & F.col("path").rlike(pattern))


def upsert_batches(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the last row per key."""
    from subtide.operators.upkeep import upsert

    def apply(batch: DataFrame, _: int) -> None:
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        write(upsert(read(), last, keys))

    return apply
