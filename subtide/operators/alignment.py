"""Token alignments, transcripts and chunks as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subtide.functions.folds import collected


def greedy_offsets(text: Column, words: Column) -> Column:
    """array<struct<word, start>>: each word's first place at or after the end of the one before.

    Places count from 0; a word that is not found has a null start and does not move the cursor.
    """
    def place(at: Column, w: Column) -> Column:
        return F.nullif(F.call_function("locate", w, text, at), F.lit(0))

    return collected(
        words, F.lit(1), lambda at, w: F.coalesce(place(at, w) + F.char_length(w), at),
        lambda at, w: F.struct(w.alias("word"), (place(at, w) - 1).alias("start")), "struct<word:string,start:int>",
    )


def align_groups(groups: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """Groups with the first start and last end of their tokens; none gives ``missing``."""
    per = tokens.groupBy(key).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("tokens"))
    return groups.join(per, key, "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("status", F.when(F.col("tokens") == 0, "missing").otherwise("aligned"))


def token_status(start: Column, end: Column) -> Column:
    """aligned, or suspicious where a token ends before it starts."""
    return F.when(end >= start, "aligned").otherwise("suspicious")


def invariant_faults(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows that hold every rule, quarantined rows with ``faults``)."""
    faults = F.filter(F.array(*[F.when(~F.coalesce(F.expr(r), F.lit(False)), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("faults", faults)
    return marked.where(F.size("faults") == 0).drop("faults"), marked.where(F.size("faults") > 0)


def chunks_or_whole(df: DataFrame, keys: Sequence[str], duration: str, target: float) -> DataFrame:
    """(keys, index, start, end): one chunk where short, else equal steps of ``target``."""
    n = F.greatest(F.ceil(F.col(duration) / target).cast("int"), F.lit(1))
    out = df.where(F.col(duration).isNotNull()).select(*keys, duration, F.explode(F.sequence(F.lit(0), n - 1)).alias("index"))
    return out.select(*keys, "index", (F.col("index") * target).alias("start"), F.least(duration, (F.col("index") + 1) * target).alias("end"))


def transcript_cues(segments: DataFrame, key: str, start: str, end: str, text: str) -> DataFrame:
    """Segments of positive length with text, trimmed and numbered from 1 in time order."""
    good = segments.where((F.col(end) > F.col(start)) & (F.trim(F.coalesce(F.col(text), F.lit(""))) != ""))
    return good.withColumn(text, F.trim(text)).withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(start, end)))


def cumulative_offset(actions: DataFrame, key: str, order: str, offset: str) -> DataFrame:
    """Actions with the running offset of their track."""
    return actions.withColumn("total", F.sum(offset).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def frame_range(start: Column, end: Column, rate: Column, frames: Column) -> tuple[Column, Column]:
    """(first, last) frame, half to even and within the source; null where out of bounds."""
    a, b = F.bround(start * rate).cast("long"), F.bround(end * rate).cast("long")
    ok = (a >= 0) & (b >= a) & (b <= frames)
    return F.when(ok, a), F.when(ok, b)


def merge_metadata(a: Column, b: Column) -> Column:
    """The two maps' value where they agree, else both in order."""
    return F.when(a.eqNullSafe(b), F.array(a)).otherwise(F.array(a, b))


def speech_chunks(spans: DataFrame, key: str) -> DataFrame:
    """(key, index, start, end, lineage): speech spans as chunks with where they come from."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("start", "end")) - 1
    return spans.select(key, n.alias("index"), "start", "end", F.struct(F.lit("speech").alias("kind"), F.col(key).alias("source"), n.alias("place")).alias("lineage"))


def playback_range(start: Column, end: Column) -> tuple[Column, Column]:
    """Whole milliseconds to play, one at least."""
    a = F.bround(F.greatest(start, F.lit(0.0)) * 1000).cast("long")
    return a, F.greatest(F.bround(end * 1000).cast("long"), a + 1)


def detect(chunks: DataFrame, backend: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Spans of a detector or model given by the caller: a function from rows of chunks to rows of spans."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield backend(b)

    return chunks.mapInPandas(run, schema)
