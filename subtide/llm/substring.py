"""Substring dedup: words covered by long repeated windows, found by difference-cover anchors.

A difference cover D of period v holds, for any two residues, a shift that takes
both into D. So two equal windows, wherever they start, have an equal run of
words at some common shift below v whose start is a cover position in both
documents. Only runs at cover positions (the anchors, ``width - v + 1`` words
long) are hashed and counted over all documents. A window can repeat only if
an anchor it holds repeats; repeated anchors extend to the windows around them,
which are named by 96 bits from two halves of their words' 128-bit XXH3, and
those that occur twice or more cover the words to remove.

Counts combine before each shuffle, so a passage in a third of all rows meets as
one count per task; its occurrences are joined back to unique keys. Texts that
recur whole take part once, with a count of two: all their windows repeat. What
travels with the tasks is a bitmap of repeated anchors of at most ``MOST_BITS``
bits; where anchors outgrow it, more windows are hashed, with the same result.

Defined results: a null or empty text has no words; a text shorter than the
window loses nothing; equal texts (repeated rows too) of ``width`` words or more
lose every word; documents are told apart by doc_id and text, a null doc_id
included; an empty table gives no rows; extra columns are ignored; a long text is
handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.llm import words as W
from subtide.llm.decontam import _in, bitmap
from subtide.llm.lineage import join_unique, stored

WIDTH = 35
#: A perfect difference cover of period 21.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
MOST_BITS = 29
#: Digests of recurring texts (some 60 bytes each) up to this number are broadcast.
BROADCAST_KEYS = 200_000


def with_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text, t, copies, lead): rows of ``docs`` with how often their text occurs.

    ``lead`` marks rows with the smallest doc_id of their text; ``t``, 60 bits of the
    text's SHA-256, tells texts of one doc_id apart, and is 0 throughout where no doc_id repeats.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    recurring = stored(
        base.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least")).where("copies > 1")
    )
    small = recurring.count() <= BROADCAST_KEYS
    unique = base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    t = F.lit(0).cast("long") if unique else F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    joined = base.join(F.broadcast(recurring) if small else recurring, "digest", "left")
    return joined.select(
        "doc_id", "text", t.alias("t"),
        F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce(F.col("least").eqNullSafe(F.col("doc_id")) | F.col("copies").isNull(), F.lit(True)).alias("lead"),
    )


def attach(rows: DataFrame, found: DataFrame, column: str, key: str) -> DataFrame:
    """``rows`` left-joined with ``found`` (_id, _t, column) on (key, t), nulls matching.

    Up to ``BROADCAST_KEYS`` found rows, their keys are broadcast and only the
    texts they name are shuffled; past that, all are.
    """
    found = stored(found)
    same = F.col(key).eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))
    if found.count() > BROADCAST_KEYS:
        return rows.join(found, same, "left").drop("_id", "_t")
    keys = F.broadcast(found.select("_id", "_t"))
    named = rows.join(keys, same, "left_semi").join(found, same, "left").drop("_id", "_t")
    return named.unionByName(rows.join(keys, same, "left_anti").withColumn(column, F.lit(None).cast(found.schema[column].dataType)))


def _words(column: pa.Array):
    """(row, 128-bit names of the words as two columns, words before each row) of consecutive texts."""
    for row, raw, offsets in W.slices(column):
        names, before = W.word_names(raw, offsets)
        yield row, names, before


def _anchors(h: np.ndarray, before: np.ndarray, width: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the anchors of all rows that hold a window."""
    run = width - period + 1
    counts = np.diff(before)
    place = np.arange(len(h)) - np.repeat(before[:-1], counts)
    room = np.repeat(counts, counts)
    ok = np.isin(place % period, cover) & (place + run <= room) & (room >= width)
    at = np.flatnonzero(ok)
    return at, W.run_hashes(h, at, at + run)


def _count_anchors(width: int, period: int, cover: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            twice = b["copies"].to_numpy(zero_copy_only=False) > 1
            for row, names, before in _words(b["text"]):
                at, a = _anchors(names[:, 0], before, width, period, cover)
                owner = np.searchsorted(before, at, "right") - 1 + row
                values, inverse = np.unique(a, return_inverse=True)
                n = np.bincount(inverse, weights=1 + twice[owner], minlength=len(values))
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

    return run


def _windows(mask: bytes, bits: int, width: int, period: int, cover: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(mask, np.uint8)
        for b in batches:
            copies = b["copies"].to_numpy(zero_copy_only=False)
            for row, names, before in _words(b["text"]):
                h = names[:, 0]
                at, a = _anchors(h, before, width, period, cover)
                flag = np.zeros(len(h) + period + 1, np.int64)
                flag[at[_in(table, a, bits)] + 1] = 1
                np.cumsum(flag, out=flag)
                counts = np.diff(before)
                place = np.arange(len(h)) - np.repeat(before[:-1], counts)
                room = np.repeat(counts, counts)
                near = flag[period : len(h) + period] - flag[: len(h)] > 0
                start = np.flatnonzero(near & (place + width <= room))
                owner = np.searchsorted(before, start, "right") - 1 + row
                high, low = W.run_hashes(h, start, start + width, 0), W.run_hashes(names[:, 1], start, start + width, 1)
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(high.view(np.int64)), pa.array((low >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        b["doc_id"].take(take), b["t"].take(take), pa.array(place[start].astype(np.int32)), pa.array(np.minimum(copies[owner], 2).astype(np.int32)),
                    ],
                    names=["high", "low", "doc_id", "t", "start", "n"],
                )

    return run


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b["copies"].to_numpy(zero_copy_only=False) > 1
            lists = b["starts"]
            n_words, n_removed, kept = [], [], []
            for row, raw, offsets in W.slices(b["text"]):
                starts, ends, before = W.spans(raw, offsets, W.SPACES)
                data = raw.tobytes()
                for k in range(len(before) - 1):
                    first, last = int(before[k]), int(before[k + 1])
                    n = last - first
                    gone = np.zeros(n, bool)
                    if whole[row + k]:
                        gone[:] = n >= width
                    elif lists[row + k].is_valid:
                        edge = np.zeros(n + 1, np.int64)
                        s = np.unique(lists[row + k].values.to_numpy())
                        np.add.at(edge, s, 1)
                        np.add.at(edge, np.minimum(s + width, n), -1)
                        gone = np.cumsum(edge[:-1]) > 0
                    n_words.append(n)
                    n_removed.append(int(gone.sum()))
                    stay = np.flatnonzero(~gone) + first
                    kept.append(b" ".join([data[a:e] for a, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return run


def dedup_substrings(docs: DataFrame, width: int = WIDTH, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    rows = with_copies(docs)
    leads = rows.where("lead")
    shared = stored(
        leads.select("text", "copies").mapInArrow(_count_anchors(width, period, cover), "hash long, n long")
        .groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
    )
    bits = min(MOST_BITS, max(20, ceil(log2(16 * (shared.count() + 1)))))
    windows = leads.select("doc_id", "t", "text", "copies").mapInArrow(
        _windows(bitmap(shared, "hash", bits), bits, width, period, cover), "high long, low int, doc_id long, t long, start int, n int"
    )
    repeated = stored(windows.groupBy("high", "low").agg(F.sum("n").alias("rows")).where("rows > 1"))
    covered = join_unique(windows.where("n = 1").drop("n"), repeated, ["high", "low"], "left_semi", "rows")
    lists = covered.groupBy("doc_id", "t").agg(F.collect_list("start").alias("starts")).select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "starts")
    done = attach(rows, lists, "starts", "doc_id")
    return done.select("doc_id", "text", "copies", "starts").mapInArrow(_cut(width), "doc_id long, n_words long, n_removed long, kept string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, k, sha256(array_to_string(w[k:k + {WIDTH - 1}], ' ')) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - {WIDTH - 2})) AS k FROM d)),
r AS (SELECT rid, k FROM (SELECT rid, k, count(*) OVER (PARTITION BY g) AS n FROM p) WHERE n > 1),
gone AS (SELECT DISTINCT rid, unnest(range(k, k + {WIDTH})) AS k FROM r),
wd AS (SELECT rid, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n FROM wd ANTI JOIN gone USING (rid, k) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""

QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLES = {"op7_substring_dedup": ORACLE_SQL}
