"""Range joins by cells of time, for keys that hold any number of spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(start: Column, end: Column, width: Column) -> Column:
    """The cells of ``width`` that [start, end) touches; a span without length touches its own."""
    first = F.floor(start / width)
    return F.sequence(first, F.greatest(first, F.ceil(end / width) - 1))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], of_left: tuple[str, str], of_right: tuple[str, str]) -> DataFrame:
    """The pairs of a left and a right row of equal keys whose half-open spans overlap, once each; ``right`` shares no other column name.

    Cells are twice as wide as a key's mean span, so rows grow by half on
    average whatever the lengths, and each row meets about the rows that it
    overlaps. A pair counts in the cell where the later of the two starts. A key
    of any size spreads over its cells. Spans without length overlap nothing.
    The mean is exact, as both sides must reckon with one width whatever the order of their rows.
    """
    (ls, le), (rs, re) = of_left, of_right
    left, right = left.where(F.col(le) > F.col(ls)), right.where(F.col(re) > F.col(rs))
    length = lambda df, s, e: df.select(*keys, (F.col(e) - F.col(s)).cast("decimal(28,6)").alias("_n"))
    width = length(left, ls, le).unionByName(length(right, rs, re)).groupBy(*keys).agg((F.avg("_n").cast("double") * 2).alias("_width"))
    dealt = lambda df, s, e: df.join(width, list(keys)).withColumn("_cell", F.explode(_cells(F.col(s), F.col(e), F.col("_width"))))
    a, b = dealt(left, ls, le), dealt(right, rs, re).drop("_width")
    met = a.join(b, [*keys, "_cell"]).where((F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)))
    return met.where(F.floor(F.greatest(ls, rs) / F.col("_width")) == F.col("_cell")).drop("_cell", "_width")


def near_join(left: DataFrame, right: DataFrame, keys: Sequence[str], of_left: str, of_right: str, reach: int) -> DataFrame:
    """The pairs of a left and a right row of equal keys whose whole-number places are at most ``reach`` apart."""
    width = 2 * reach + 1
    a = left.withColumn("_cell", F.floor(F.col(of_left) / width))
    b = right.withColumn("_cell", F.explode(F.array_distinct(F.array(F.floor((F.col(of_right) - reach) / width), F.floor((F.col(of_right) + reach) / width)))))
    return a.join(b, [*keys, "_cell"]).where(F.abs(F.col(of_left) - F.col(of_right)) <= reach).drop("_cell")
