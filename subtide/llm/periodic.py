"""Periodic runs of words by a scan of all lags.

A lag's scan compares the array of word numbers with itself shifted by the lag
and takes the lengths of the stretches of equal places: a stretch of L places at
lag q is L + q words of period q. A run has at least ``min_exp`` periods, so lags
to n / min_exp are enough, and a stretch belongs to its smallest lag: with four
periods or more a smaller period of it divides q, so it is found, with the same
ends, at that lag too.

Texts of up to ``LONG_BYTES`` are scanned where they are read, many at once: their
arrays are laid one after another, the longest first, so that a lag's texts are a
prefix. Longer ones are parted into ranges of lags, about ``WORK`` comparisons
each, which Spark deals to all tasks; their runs meet again by document.

Defined results: a null or empty text has no words and no runs; a null doc_id has
no rewriting; equal rows give equal rows, each its own; an empty table gives no
rows; extra columns are ignored; a text of any length is handled whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.llm import words as W
from subtide.llm.lineage import stored

MIN_EXP, MIN_WORDS = 4, 6
#: Texts of more bytes are dealt by ranges of lags.
LONG_BYTES = 1 << 16
#: Comparisons of a range of lags, and the fewest lags of one (each ships the document's array).
WORK, FEWEST_LAGS = 1 << 25, 512


def planted_order(doc_id: object, n: int) -> np.ndarray | None:
    """Each word's place in the original text where a document is rewritten: one in ten, by its number's hash, repeats from a place on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g, order = h // 10, np.arange(n)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order[a:] = a + np.arange(n - a) % p
    return order


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers (from 0)."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int32)


def scan(ids: np.ndarray, low: int, high: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, lag) of the long stretches at each lag from ``low`` to below ``high``.

    ``ends[q]``, where given, is how far the texts reach that are long enough for lag q.
    """
    starts, lengths, lags = [], [], []
    for q in range(low, high):
        reach = ids if ends is None else ids[: ends[q]]
        need = max(MIN_WORDS - q, (MIN_EXP - 1) * q)
        same = reach[q:] == reach[:-q]
        if len(same) < need or np.count_nonzero(same) < need:
            continue
        at = np.flatnonzero(same)
        if not (at[need - 1 :] - at[: len(at) - need + 1] == need - 1).any():
            continue
        cut = np.flatnonzero(np.diff(at) != 1)
        first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
        keep = last - first + 1 >= need
        starts.append(first[keep])
        lengths.append(last[keep] - first[keep] + 1 + q)
        lags.append(np.full(int(keep.sum()), q))
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(starts), np.concatenate(lengths), np.concatenate(lags)


def smallest(starts: np.ndarray, lengths: np.ndarray, lags: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), one per stretch with its smallest lag, by start, then period."""
    order = np.lexsort((lags, lengths, starts))
    rows = np.stack([starts, lengths, lags], 1)[order]
    if len(rows):
        rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def digest(words: list[bytes], runs: np.ndarray) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of one text with its runs."""
    best: tuple = (None,) * 4
    if len(runs):
        # Different exponents of under 2**26 words differ as doubles too, and equal ones are equal.
        k = int(np.lexsort((runs[:, 2], runs[:, 0], -(runs[:, 1] / runs[:, 2])))[0])
        start, length, period = (int(x) for x in runs[k])
        best = (start, length, period, 1000 * length // period)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(edge) > 0
    kept = b" ".join([w for w, x in zip(words, gone.tolist(), strict=False) if not x]) if len(runs) else b" ".join(words)
    return (len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_TYPES = [pa.int64()] * 5 + [pa.string()] * 2
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _rows(ids: list, found: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", *_NAMES])


def _rewritten(doc_id: object, text: bytes) -> list[bytes]:
    found = text.split()
    order = planted_order(doc_id, len(found))
    return found if order is None else [found[i] for i in order.tolist()]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts scanned at all their lags where they lie."""
    for batch in batches:
        names = batch["doc_id"].to_pylist()
        for row, raw, offsets in W.slices(batch["text"], 1 << 20):
            data = raw.tobytes()
            texts = [_rewritten(names[row + k], data[a:b]) for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))]
            yield _rows(batch["doc_id"].slice(row, len(texts)), _found(texts))


def _found(texts: list[list[bytes]]) -> list[tuple]:
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    laid, shift = [], 0
    for k in order.tolist():
        ids = numbered(texts[k]) + shift  # no number in two texts, so no stretch leaves its text
        shift += len(ids)
        laid.append(ids)
    whole = np.concatenate(laid) if laid else np.zeros(0, np.int32)
    before = np.concatenate([[0], np.cumsum(sizes[order])])
    most = int(sizes.max(initial=0)) // MIN_EXP
    # How many texts, the longest first, have at least MIN_EXP periods of each lag.
    enough = np.searchsorted(-sizes[order], -np.maximum(MIN_EXP * np.arange(most + 1), MIN_WORDS), "right")
    starts, lengths, lags = scan(whole, 1, most + 1, before[enough])
    owner = np.searchsorted(before, starts, "right") - 1
    out: list[tuple] = [()] * len(texts)
    by = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[by], np.arange(len(texts) + 1))
    for j, k in enumerate(order.tolist()):
        at = by[cuts[j] : cuts[j + 1]]
        out[k] = digest(texts[k], smallest(starts[at] - before[j], lengths[at], lags[at]))
    return out


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, doc_id, text) -> (rid, low, high, ids): a document's array with each range of its lags."""
    for batch in batches:
        for rid, doc_id, text in zip(batch["rid"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"], strict=True):
            ids = numbered(_rewritten(doc_id, text.as_buffer().to_pybytes()))
            wide = max(FEWEST_LAGS, -(-WORK // max(1, len(ids))))
            for low in range(1, len(ids) // MIN_EXP + 1, wide):
                high = min(low + wide, len(ids) // MIN_EXP + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rid], pa.int64()), pa.array([low], pa.int32()), pa.array([high], pa.int32()), pa.array([ids.tobytes()], pa.binary())],
                    names=["rid", "low", "high", "ids"],
                )


def _scan_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rid, low, high, ids in zip(batch["rid"].to_pylist(), batch["low"].to_pylist(), batch["high"].to_pylist(), batch["ids"], strict=True):
            found = scan(np.frombuffer(ids.as_buffer(), np.int32), low, high)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found[0]), rid, np.int64)), *[pa.array(x.astype(np.int64)) for x in found]], names=["rid", "start", "length", "period"]
            )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for doc_id, text, runs in zip(batch["doc_id"].to_pylist(), batch["text"], batch["runs"].to_pylist(), strict=True):
            rows = np.array([(r["start"], r["length"], r["period"]) for r in runs or []], np.int64).reshape(-1, 3)
            found.append(digest(_rewritten(doc_id, text.as_buffer().to_pybytes()), rows[np.lexsort((rows[:, 2], rows[:, 0]))]))
        if found:
            yield _rows(batch["doc_id"], found)


def periodic_runs(docs: DataFrame, long_bytes: int = LONG_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, the count and best of its runs and digests of all runs and of the words kept."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = F.octet_length("text")
    short = docs.where(size <= long_bytes).mapInArrow(_whole, f"doc_id {kind}, {RESULT}")
    # Stored, so that a row's number stays its own.
    long = stored(docs.where(size > long_bytes)).withColumn("rid", F.monotonically_increasing_id())
    parts = long.select("rid", "doc_id", "text").mapInArrow(_ranges, "rid long, low int, high int, ids binary").repartition("rid", "low")
    found = parts.mapInArrow(_scan_ranges, "rid long, start long, length long, period long")
    runs = found.groupBy("rid", "start", "length").agg(F.min("period").alias("period")).groupBy("rid").agg(
        F.collect_list(F.struct("start", "length", "period")).alias("runs")
    )
    far = long.join(runs, "rid", "left").select("doc_id", "text", "runs").mapInArrow(_digests, f"doc_id {kind}, {RESULT}")
    return short.unionByName(far)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table, every text whole."""
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLES: dict[str, str] = {}
