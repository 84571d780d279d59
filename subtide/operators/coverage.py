"""Release coverage: which episodes a title and its release groups have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def title_coverage(rows: DataFrame, title: str, episode: str, name: str, order: str) -> DataFrame:
    """Per title: rows, parsed rows, sorted distinct episodes and the first non-blank name."""
    named = F.min(F.when(F.coalesce(F.col(name), F.lit("")) != "", F.struct(F.col(order).alias("o"), F.col(name).alias("n"))))
    return rows.groupBy(title).agg(
        F.count(F.lit(1)).alias("rows"), F.count(episode).alias("parsed"), F.sort_array(F.collect_set(episode)).alias("episodes"), named.alias("_n")
    ).withColumn("name", F.coalesce("_n.n", F.lit(""))).drop("_n")


def group_coverage(rows: DataFrame, title: str, group: str, episode: str, example: str, order: str, examples: int = 5) -> DataFrame:
    """Per title and group: sorted distinct episodes and the first examples.

    Only rows ranked among the first reach the example list.
    """
    rank = F.row_number().over(Window.partitionBy(title, group).orderBy(order))
    ranked = rows.withColumn("_r", rank)
    first = F.array_sort(F.collect_list(F.when(F.col("_r") <= examples, F.struct(F.col(order).alias("o"), F.col(example).alias("x")))))
    return ranked.groupBy(title, group).agg(
        F.count(F.lit(1)).alias("rows"), F.sort_array(F.collect_set(episode)).alias("episodes"), F.transform(first, lambda s: s["x"]).alias("examples")
    )


def coverage_ratio(part: Column, whole: Column) -> Column:
    """Share of ``whole`` that ``part`` has, 0 for an empty whole."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(part, whole)), F.size(whole)), F.lit(0.0))


def classify(part: Column, whole: Column, complete: float = 0.8) -> Column:
    """complete, gave up, partial, one-off or unparsed (L02); the margin rounds half to even."""
    ratio = coverage_ratio(part, whole)
    margin = F.greatest(F.lit(3), F.bround(F.size(whole) * 0.15).cast("int"))
    gave_up = (F.array_min(part) <= F.array_min(whole) + 1) & (F.array_max(part) <= F.array_max(whole) - margin) & (F.size(part) >= 3)
    return (
        F.when((F.size(whole) == 0) | (F.size(part) == 0), "unparsed").when(ratio >= complete, "probably_complete").when(gave_up, "possible_gave_up")
        .when(F.size(part) >= 3, "partial_or_alt_span").otherwise("one_off")
    )


def most_common(rows: DataFrame, value: str, order: str, n: int) -> DataFrame:
    """(value, count): the ``n`` most frequent, ties by first appearance."""
    c = rows.groupBy(value).agg(F.count(F.lit(1)).alias("count"), F.min(order).alias("_first"))
    return c.orderBy(F.desc("count"), F.asc("_first")).limit(n).drop("_first")
