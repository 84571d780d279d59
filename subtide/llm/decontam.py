"""Benchmark decontamination by a prefix-filtered set join.

A window is ``width`` consecutive words of an item, or a whole shorter item; its
set of shingles is its word pairs (the word itself for a one-word window). For a
document to hold a window it must hold all of its shingles, so one necessary
prefix token is enough: the shingle that is rarest in the corpus, counted over
all documents. Documents are joined on that token alone; the token's place in
the window and the window's length bound where it may lie, and the words
themselves are compared in the end.

Only a bitmap travels with the tasks: some sixteen bits a token, up to 2**``MOST_BITS``. Past
some sixteen million tokens it lets more places through to the join; results are the
same. Items of equal words are one group; the index of windows, the windows' groups and
the groups' items are each broadcast where their own counted rows are at most ``BROADCAST_ROWS``; beyond,
they are joined by shuffle.

Defined results: null and empty texts have no words and no windows; equal items
share windows and each is reported; a null item_id marks hits but is no item;
repeated document rows each give a row; an empty benchmark leaves all clean; an empty
table gives no rows; extra columns are ignored; a long text is handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.llm import words as W
from subtide.llm.lineage import stored

WIDTH = 10
LEAST_BITS, MOST_BITS = 20, 28
#: A row holds one window (some 100 bytes) or one item's id, so this is some 20 MB.
BROADCAST_ROWS = 150_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def groups(items: DataFrame) -> DataFrame:
    """(item_id, words, grp): the words of each item that has some, and a name that items of equal words share."""
    w = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    return items.select("item_id", w.alias("words")).where(F.size("words") > 0).withColumn("grp", F.sha2(F.array_join("words", " "), 256))


def windows(grouped: DataFrame, width: int = WIDTH) -> DataFrame:
    """(grp, window, n): distinct windows of each group of equal items, words joined by one space."""
    lists = grouped.groupBy("grp").agg(F.first("words").alias("w"))
    cut = F.when(F.size("w") < width, F.array(F.array_join("w", " "))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, width), " "))
    )
    return lists.select("grp", F.explode(cut).alias("window"), F.least(F.size("w"), F.lit(width)).alias("n")).distinct()


def bits_for(tokens: int) -> int:
    """The size of a bitmap of so many tokens, as a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, (16 * tokens).bit_length()))


def _shingles(hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word pairs, by first word, and whether the pair stays in its row."""
    pairs = np.zeros(len(hashes), np.uint64)
    if len(hashes) > 1:
        with np.errstate(over="ignore"):
            pairs[:-1] = W.mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    inside = np.ones(len(hashes), bool)
    last = before[1:] - 1
    inside[last[last >= 0]] = False
    return pairs, inside


def _single(hashes: np.ndarray) -> np.ndarray:
    return W.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))


def _window_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, n) -> (window, n, token, place): every shingle of each window."""
    for batch in batches:
        for row, raw, offsets in W.slices(batch["window"]):
            starts, ends, before = W.spans(raw, offsets, W.SPACES)
            h = W.word_hashes(raw, starts, ends)
            pairs, inside = _shingles(h, before)
            lone = np.zeros(len(h), bool)
            counts = np.diff(before)
            lone[before[:-1][counts == 1]] = True
            at = np.flatnonzero(inside | lone)
            owner = np.searchsorted(before, at, "right") - 1
            take = pa.array(owner + row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["window"].take(take), batch["n"].take(take),
                    pa.array(np.where(lone[at], _single(h[at]), pairs[at]).view(np.int64)),
                    pa.array((at - before[owner]).astype(np.int32)),
                ],
                names=["window", "n", "token", "place"],
            )


def bitmap(tokens: DataFrame, column: str, bits: int) -> bytes:
    """A bitmap of the low ``bits`` bits of the values: 2**bits / 8 bytes, whatever their number."""
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    parts = (
        tokens.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p"))
        .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    )
    whole = bytearray(1 << (bits - 3))
    for r in parts:
        whole[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["m"]
    return bytes(whole)


def _in(mask: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    low = h & np.uint64((1 << bits) - 1)
    return (mask[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _document_tokens(batch_text: pa.Array):
    for row, raw, offsets in W.slices(batch_text):
        low = W.LOWER[raw]
        starts, ends, before = W.spans(low, offsets, W.NON_ALNUM)
        h = W.word_hashes(low, starts, ends)
        pairs, inside = _shingles(h, before)
        yield row, low, starts, ends, before, h, pairs, inside


def _counter(mask: bytes, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(mask, np.uint8)
        for batch in batches:
            for _, _, _, _, _, h, pairs, inside in _document_tokens(batch["text"]):
                one = _single(h)
                both = np.concatenate([pairs[inside & _in(table, pairs, bits)], one[_in(table, one, bits)]])
                values, n = np.unique(both, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    return run


def index(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """(window, n, token, place): each distinct window of ``cut`` under its rarest shingle.

    Windows with a shingle that no document has are left out: they occur nowhere.
    """
    distinct = cut.select("window", "n").distinct()
    tokens = stored(distinct.mapInArrow(_window_tokens, "window string, n int, token long, place int"))
    bits = bits_for(tokens.count())
    counts = (
        docs.select("text").mapInArrow(_counter(bitmap(tokens, "token", bits), bits), "token long, n long")
        .groupBy("token").agg(F.sum("n").alias("df"))
    )
    ranked = tokens.join(counts, "token", "left").select("window", "n", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "place").alias("t"))
    best = ranked.groupBy("window", "n").agg(F.min("t").alias("t")).where("t.df > 0")
    return stored(best.select("window", "n", "t.token", "t.place"))


def _candidates(mask: bytes, bits: int, width: int):
    """Documents -> (rid, doc_id, text_hash, n_words, found[]): places whose token is in the bitmap, with words around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(mask, np.uint8)
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for row, low, starts, ends, before, h, pairs, inside in _document_tokens(batch["text"]):
                n = len(before) - 1
                one = _single(h)
                p, q = np.flatnonzero(inside & _in(table, pairs, bits)), np.flatnonzero(_in(table, one, bits))
                at = np.concatenate([p, q])
                token = np.concatenate([pairs[p], one[q]])
                order = np.argsort(at, kind="stable")
                at, token = at[order], token[order]
                owner = np.searchsorted(before, at, "right") - 1
                first = np.maximum(before[owner], at - width + 1)
                last = np.minimum(before[owner + 1], at + width)
                around = [b" ".join([low[starts[i] : ends[i]].tobytes() for i in range(a, b)]) for a, b in zip(first, last, strict=True)]
                found = pa.StructArray.from_arrays(
                    [
                        pa.array((at - before[owner]).astype(np.int32)),
                        pa.array((first - before[owner]).astype(np.int32)),
                        pa.array(token.view(np.int64)),
                        pa.array(around, pa.binary()).cast(pa.string()),
                    ],
                    names=["at", "first", "token", "around"],
                )
                bounds = np.zeros(n + 1, np.int32)
                np.cumsum(np.bincount(owner, minlength=n), out=bounds[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(rid, rid + n)), batch["doc_id"].slice(row, n), batch["text_hash"].slice(row, n),
                        pa.array(np.diff(before).astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), found),
                    ],
                    names=["rid", "doc_id", "text_hash", "n_words", "found"],
                )
                rid += n

    return run


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_words, n_hit, items (sorted strings), contaminated.

    ``text_hash`` is xxhash64 of the text; with doc_id it finds the row again.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    grouped = stored(groups(items))
    cut = stored(windows(grouped, width))
    idx = index(docs, cut)
    size = idx.count()
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    bits = bits_for(size)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Stored, as rows are named by their place in a task: a task run again might number them otherwise.
    found = stored(docs.mapInArrow(
        _candidates(bitmap(idx, "token", bits), bits, width),
        f"rid long, doc_id {kind}, text_hash long, n_words long, found array<struct<at:int,first:int,token:long,around:string>>",
    ))
    flat = found.select("rid", "doc_id", "text_hash", "n_words", F.explode_outer("found").alias("c")).select(
        "rid", "doc_id", "text_hash", "n_words", "c.at", "c.first", "c.around",
        F.coalesce("c.token", F.xxhash64("rid")).alias("token"),
    )
    # Positional bound: the window starts `place` words before the token, within the words at hand.
    start = F.col("at") - F.col("place")
    inside = F.slice(F.split("around", " "), F.greatest(start - F.col("first") + 1, F.lit(1)), F.col("n"))
    joined = flat.join(small(idx, size), "token", "left")
    hit = F.col("around").isNotNull() & (start >= F.col("first")) & (start + F.col("n") <= F.col("n_words")) & (F.array_join(inside, " ") == F.col("window"))
    hits = joined.select("rid", "doc_id", "text_hash", "n_words", F.when(hit, F.col("window")).alias("window"), F.when(hit, start).alias("start"), "n").distinct()
    # Rows without a hit keep a key of their own, so that they do not meet in one task.
    keyed = hits.withColumn("window", F.coalesce("window", F.concat(F.lit("\n"), F.col("rid").cast("string"))))
    named = keyed.join(small(cut.select("window", "grp"), cut.count()), "window", "left")
    held = named.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", (F.col("start") + F.col("n")).alias("end"))))).alias("spans"),
        F.sort_array(F.collect_set("grp")).alias("grps"),
    )
    # Documents that hold the same groups hold the same items: each such set is spelt out once.
    held = stored(held.withColumn("held", F.sha2(F.array_join("grps", ""), 256)))
    sets = held.where(F.size("grps") > 0).groupBy("held").agg(F.first("grps").alias("grps")).select("held", F.explode("grps").alias("grp"))
    ids = grouped.select("grp", F.col("item_id").cast("string").alias("item")).where("item IS NOT NULL").distinct()
    lists = stored(sets.join(small(ids, grouped.count()), "grp").groupBy("held").agg(F.sort_array(F.collect_set("item")).alias("items")))
    total = lists.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
    per = held.join(small(lists, total), "held", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["to"], x["end"]).alias("to"), (a["n"] + F.greatest(x["end"] - F.greatest(a["to"], x["start"]), F.lit(0))).alias("n")),
        lambda a: a["n"],
    )
    return per.select("doc_id", "text_hash", "n_words", covered.alias("n_hit"), "items", "spans").withColumn("contaminated", F.col("n_hit") > 0)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table against the whole ``benchmark`` table."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs.select("doc_id", "text"), items.select("item_id", "text")).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}')"

ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS n,
               array_to_string(w[k:k + least(len(w), {WIDTH}) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WIDTH}, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT rid, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
       FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes)),
hit AS (SELECT rid, k, pos.n, item_id FROM pos JOIN win ON pos.g = win.g AND pos.n = win.n),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM hit) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""

QUERIES = {"op1_decontamination": op1_decontamination}
ORACLES = {"op1_decontamination": ORACLE_SQL}
