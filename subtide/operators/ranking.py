"""Places in an order over all rows, without all rows in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def places(rows: DataFrame, bucket: list[Column], order: list[Column | str], keys: tuple[str, ...] = (), into: str = "place") -> DataFrame:
    """``rows`` with the 1-based place of each by ``bucket`` (ascending) and then ``order``, within ``keys``.

    Rows are counted by bucket, a running sum of the counts tells where a bucket
    begins, and rows are numbered within theirs. So a task holds a bucket's rows or
    the counts, one row a bucket. Buckets are to be fine: a hot one is sorted by one
    task. Nulls come first and are a bucket of their own; ties have any order.
    """
    names = [f"_b{i}" for i in range(len(bucket))]
    named = rows.withColumns(dict(zip(names, bucket, strict=True)))
    group = [*keys, *names]
    counts = named.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select(*(F.col(c).alias(f"_of_{c}") for c in group), F.coalesce(before, F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group))
    local = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    placed = named.withColumn("_local", local).join(begins, same)
    return placed.withColumn(into, (F.col("_before") + F.col("_local")).cast("long")).drop(*names, *(f"_of_{c}" for c in group), "_before", "_local")


def joined_segments(rows: DataFrame, keys: list[str], order: list[str], text: str, size: int, sep: str = " ") -> DataFrame:
    """(keys, block, first, text): texts in order, joined in blocks of ``size``; ``first`` has the order columns of a block's first.

    A block is bounded, so no source is one collected row; the blocks in their order are the whole text.
    """
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    numbered = rows.select(*keys, F.floor(n / size).alias("block"), F.struct(*order).alias("o"), F.col(text).alias("t"))
    block = F.array_sort(F.collect_list(F.struct("o", "t")))
    return numbered.groupBy(*keys, "block").agg(F.min("o").alias("first"), F.array_join(F.transform(block, lambda x: x["t"]), sep).alias("text"))


def reciprocal_rank(rows: DataFrame, keys: list[str], order: list[Column | str], into: str = "score") -> DataFrame:
    """``rows`` with 1 / place within ``keys`` (C15, G17); one key's rows are ranked by one task."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(into, F.round(F.lit(1.0) / place, 9))


def repeats(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """``rows`` with their 1-based ``position`` within ``keys`` and ``duplicate``: the value stood before (G14). Null is a value like any other."""
    seen = F.row_number().over(Window.partitionBy(*keys, value).orderBy(order)) > 1
    return rows.withColumns({"position": F.row_number().over(Window.partitionBy(*keys).orderBy(order)), "duplicate": seen})
