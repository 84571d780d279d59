"""Windows of cues, sharded requests, and reconstruction from results with dead letters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def context_windows(cues: DataFrame, source: str, order: str, item: Column, size: int, context: int) -> DataFrame:
    """(source, window, first_row, active[], before[], after[]): tumbling windows of ``size`` cues with context.

    Cues sort by ``order`` within a source; an explicit order column makes the
    result the same on any partitioning. A cue reaches its own window and at
    most the neighbours whose context it is in, so nothing is gathered but a window.
    """
    n = F.row_number().over(Window.partitionBy(source).orderBy(order)) - 1
    rows = cues.select(source, n.alias("_n"), item.alias("_x"))
    w = F.floor(F.col("_n") / size)
    reach = -(-context // size) if size else 0
    places = F.array(*[(w + d).alias("w") for d in range(-reach, reach + 1)])
    spread = rows.select(source, "_n", "_x", F.explode(places).alias("window")).where("window >= 0")
    lo, hi = F.col("window") * size, (F.col("window") + 1) * size
    kind = F.when((F.col("_n") >= lo) & (F.col("_n") < hi), 1).when((F.col("_n") >= lo - context) & (F.col("_n") < lo), 0).when((F.col("_n") >= hi) & (F.col("_n") < hi + context), 2)
    kept = spread.withColumn("_k", kind).where("_k IS NOT NULL")
    take = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("_k") == k, F.struct("_n", "_x")))), lambda s: s["_x"])
    out = kept.groupBy(source, "window").agg(take(1).alias("active"), take(0).alias("before"), take(2).alias("after"))
    return out.where(F.size("active") > 0).withColumn("window", F.col("window").cast("long"))


def greedy_shards(items: DataFrame, source: str, order: str, size: Column, most_items: int, most_size: int) -> DataFrame:
    """``items`` with ``shard``: filled in order until either limit would be passed.

    The running state depends on every item before, so a source's items are sorted into
    one task and streamed past a state of three numbers; sources spread over tasks. An
    item larger than the limit has a shard of null.
    """
    fields = {f: items.schema[f].dataType.simpleString() for f in (source, order)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, begun, shard, n, total = None, False, 0, 0, 0
        for b in batches:
            shards = []
            for k, s in zip(b[source].to_pylist(), b["_size"].to_pylist(), strict=True):
                if not begun or k != at:
                    at, begun, shard, n, total = k, True, 0, 0, 0
                if s is not None and s > most_size:
                    shards.append(None)
                    continue
                # After an item of unknown size another shard begins.
                if s is not None and total is not None and n < most_items and total + s <= most_size:
                    n, total = n + 1, total + s
                else:
                    shard, n, total = shard + 1, 1, s
                shards.append(shard)
            yield pa.RecordBatch.from_arrays([b[source], b[order], pa.array(shards, pa.int64())], names=[source, order, "shard"])

    sized = items.select(source, order, size.cast("long").alias("_size"))
    return sized.repartition(source).sortWithinPartitions(source, order, "_size").mapInArrow(run, ", ".join(f"`{f}` {t}" for f, t in fields.items()) + ", shard long")


def first_wins(rows: DataFrame, keys: Sequence[str], *order: str) -> tuple[DataFrame, DataFrame]:
    """(first rows, later duplicates) per key in the given order."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_r = 1").drop("_r"), ranked.where("_r > 1").drop("_r")


def match_results(results: DataFrame, manifests: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(results with their manifest, error rows of results without one)."""
    known = manifests.withColumn("_known", F.lit(True))
    joined = results.join(known, key, "left")
    unknown = joined.where("_known IS NULL").select(key, F.lit("unknown_custom_id").alias("error_kind"))
    return joined.where("_known").drop("_known"), unknown


def missing_results(manifests: DataFrame, good: DataFrame, key: str) -> DataFrame:
    """Error rows of expected windows without a good result."""
    return manifests.join(good.select(key).distinct(), key, "left_anti").select(key, F.lit("missing_result").alias("error_kind"))


def result_error(known: Column, status: Column, error: Column, content: Column) -> Column:
    """The kind of error of a result row, by precedence; null for a good one."""
    return (
        F.when(~known, "unknown_custom_id").when(status.isin(401, 403), "auth_error").when(error.isNotNull() | (status >= 400), "api_error")
        .when(content.isNull(), "missing_response").when(F.get_json_object(content, "$.decisions").isNull(), "schema_error")
    )


def retryable(status: Column) -> Column:
    """Whether a failed call may be tried again: no status, 408, 409, 429 or 5xx."""
    return status.isNull() | (status == 0) | status.isin(408, 409, 429) | (status >= 500)


def decision_faults(windows: DataFrame, key: str, n: str, ids: str) -> DataFrame:
    """(key, error_kind, id): ids outside 1..n, repeated and missing ones."""
    want = F.when(F.col(n) > 0, F.sequence(F.lit(1), F.col(n).cast("int"))).otherwise(F.array().cast("array<int>"))
    got = F.col(ids).cast("array<int>")
    faults = F.concat(
        F.transform(F.filter(got, lambda x: (x < 1) | (x > F.col(n))), lambda x: F.struct(F.lit("id_mismatch").alias("error_kind"), x.alias("id"))),
        F.transform(F.array_distinct(F.filter(got, lambda x, i: F.array_position(got, x) <= i)), lambda x: F.struct(F.lit("duplicate_decision").alias("error_kind"), x.alias("id"))),
        F.transform(F.array_except(want, got), lambda x: F.struct(F.lit("missing_decision").alias("error_kind"), x.alias("id"))),
    )
    return windows.select(key, F.inline(faults))


def blocked_sources(errors: DataFrame, source: str, blocking: Sequence[str]) -> DataFrame:
    """Sources that hold an error of a blocking kind."""
    return errors.where(F.col("error_kind").isin(*blocking)).select(source).distinct()


def gate(rows: DataFrame, blocked: DataFrame, source: str, allow_partial: bool = False) -> DataFrame:
    """Rows of the sources that may be emitted."""
    return rows if allow_partial else rows.join(blocked, source, "left_anti")


def apply_decisions(cues: DataFrame, decisions: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Cues with their decision: ``remove`` goes, ``edit`` replaces the text, anything else keeps it."""
    j = cues.join(decisions, list(keys), "left").where(F.coalesce(F.col("decision"), F.lit("asis")) != "remove")
    shown = F.when(F.col("decision") == "edit", F.coalesce("new_text", F.col(text))).otherwise(F.col(text))
    return j.withColumn("changed", shown != F.col(text)).withColumn(text, shown).drop("new_text")


def renumber(rows: DataFrame, source: str, order: str, into: str = "number") -> DataFrame:
    """Sequential numbers from 1 within a source."""
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(source).orderBy(order)))


def srt_documents(cues: DataFrame, source: str, number: str, start: Column, end: Column, text: str) -> DataFrame:
    """(source, document): one SRT document a source."""
    from subtide.functions.text import srt_time

    block = F.concat_ws("\n", F.col(number).cast("string"), F.concat(srt_time(start), F.lit(" --> "), srt_time(end)), F.col(text))
    return cues.groupBy(source).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), block.alias("b")))), lambda x: x["b"]), "\n\n"), F.lit("\n")).alias("document"))
