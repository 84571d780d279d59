"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm.lineage import dropped, join_unique, stored


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v; longs); component is the least node reachable.

    Each round is two aggregates with map-side minima, each joined back on a
    unique key; the rows of a hub are joined where they lie, so it is never gathered in
    one row or task. The table is rewritten per round in the shared folder until it no longer changes.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w")).select("u", F.least("u", "m").alias("m"), "w"))
        large = join_unique(both, least, ["u"], "inner", "w").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large)
        low = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w")))
        small = (
            join_unique(large, low, ["u"], "inner", "w").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        new = stored(small)
        then = _state(new)
        for old in (now, least, large, low):
            dropped(old)
        now, before, state = new, state, then
        if before == then:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
