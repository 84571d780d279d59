"""JSON documents that are arrays, read by byte ranges.

A range alone cannot tell whether it starts within a string or how deep. So a
first scan gives, for each of the three states in which a range may start (outside a
string, within one, after a backslash in one), the state it ends in, how the depth changes and
how many commas lie at each depth. These are composed in order per document,
which gives every range its state, its depth and the number of elements before it. A second
scan then cuts the elements out. An element belongs to the range that holds the bracket
or comma before it; its task reads on to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.functions.folds import collected
from subtide.sources.storage import located

#: Bytes of a range; a task holds some thirty times as much for one at a time.
RANGE = 4 << 20
#: Ranges are dealt to as many tasks as there are, up to this.
MOST_TASKS = 20_000
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2

_QUOTE, _BACKSLASH, _COMMA = 0x22, 0x5C, 0x2C
_DEPTH = np.zeros(256, np.int8)
_DEPTH[[0x5B, 0x7B]] = 1
_DEPTH[[0x5D, 0x7D]] = -1
_BLANK = b" \t\r\n"


def _lex(a: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """(depth change at each byte, outside strings; commas there are told by ``a``), the state after it. Bytes within strings are -128."""
    slash = a == _BACKSLASH
    at = np.arange(len(a))
    before = np.maximum.accumulate(np.where(slash, -1, at)) if len(a) else at
    # The backslashes right before each byte; those before the range count one where it starts escaped.
    run = at - 1 - np.concatenate([[-1], before[:-1]])[: len(a)]
    if state == ESCAPED:
        run = run + (run == at)
    quote = (a == _QUOTE) & (run % 2 == 0)
    within = (np.cumsum(quote) + (state != OUTSIDE)) % 2 == 1
    change = np.where(within | quote, np.int8(-128), _DEPTH[a])
    if not len(a):
        return change, state
    if not within[-1]:
        return change, OUTSIDE
    tail = int(run[-1] + 1) if slash[-1] else 0
    return change, ESCAPED if tail % 2 else INSIDE


def _summary(a: np.ndarray, state: int) -> dict:
    change, out = _lex(a, state)
    outside = change > -128
    depth = np.cumsum(np.where(outside, change, 0), dtype=np.int32)
    commas = depth[outside & (a == _COMMA)]
    levels, n = np.unique(commas, return_counts=True)
    return {"state": out, "change": int(depth[-1]) if len(depth) else 0, "levels": levels.tolist(), "commas": n.tolist()}


_SUMMARY = pa.list_(pa.struct([("state", pa.int32()), ("change", pa.int32()), ("levels", pa.list_(pa.int32())), ("commas", pa.list_(pa.int64()))]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, at, size) -> what the range does from each state."""
    for batch in batches:
        for path, at, size in zip(*[batch[c].to_pylist() for c in ("path", "at", "size")], strict=True):
            fs, name = located(path)
            with fs.open_input_file(name) as f:
                a = np.frombuffer(f.read_at(size, at), np.uint8)
            made = [_summary(a, s) for s in (OUTSIDE, INSIDE, ESCAPED)]
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at], pa.int64()), pa.array([made], _SUMMARY)], names=["path", "at", "does"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, at, size, state, depth, commas, length) -> (path, row_id, value) of the elements that begin in the range."""
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("path", "at", "size", "state", "depth", "commas", "length")]
        for path, at, size, state, depth, commas, length in zip(*columns, strict=True):
            fs, name = located(path)
            with fs.open_input_file(name) as f:
                rows, values = _cut(f, path, at, size, state, depth, commas, length)
            for k in range(0, len(rows), 2000):
                part = pa.array(values[k : k + 2000], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(rows[k : k + 2000], pa.int64()), part], names=["path", "row_id", "value"])


def _cut(f, path: str, at: int, size: int, state: int, depth: int, commas: int, length: int) -> tuple[list[int], list[bytes]]:
    data = f.read_at(size, at)
    if at == 0:
        head = data.removeprefix(b"\xef\xbb\xbf").lstrip(_BLANK)
        if not head.startswith(b"["):
            raise ValueError(f"{path} is not a JSON array")
    # Until the element that the range's last separator begins is over, or only blanks are left.
    while True:
        a = np.frombuffer(data, np.uint8)
        change, _ = _lex(a, state)
        deep = depth + np.cumsum(np.where(change > -128, change, 0), dtype=np.int32)
        comma = (change > -128) & (a == _COMMA) & (deep == 1)
        opening, closing = (change == 1) & (deep == 1), (change == -1) & (deep == 0)
        marks = np.flatnonzero(comma | opening | closing)
        begun = marks[(marks < size) & ~closing[marks]]
        if not len(begun) or (marks > begun[-1]).any() or at + len(data) >= length:
            break
        data += f.read_at(min(max(1 << 16, len(data) - size), length - at - len(data)), at + len(data))
    shut = np.flatnonzero(closing)
    if len(shut) and data[shut[0] + 1 : size].strip(_BLANK):
        raise ValueError(f"{path}: text after the array, at byte {at + int(shut[0]) + 1}")
    rows, values = [], []
    ends = np.searchsorted(marks, begun, "right")
    for k, (m, e) in enumerate(zip(begun.tolist(), ends.tolist(), strict=True)):
        end = int(marks[e]) if e < len(marks) else len(data)
        number = commas + 1 + int(np.count_nonzero(comma[:size][: m + 1]))
        text = data[m + 1 : end].strip(_BLANK)
        if not text and opening[m] and e < len(marks) and closing[marks[e]]:
            continue  # an array without elements
        rows.append(number)
        values.append(text)
    return rows, values


def _starts(does: Column) -> Column:
    """For each range in order, the state, depth and commas at depth 1 before it, and after the last."""

    def step(a: Column, x: Column) -> Column:
        d = F.get(x["does"], a["state"])
        here = F.get(d["commas"], (F.array_position(d["levels"], (1 - a["depth"]).cast("int")) - 1).cast("int"))
        return F.struct(
            d["state"].alias("state"), (a["depth"] + d["change"]).alias("depth"), (a["n"] + F.coalesce(here, F.lit(0).cast("long"))).alias("n"), x["at"].alias("at")
        )

    begin = F.struct(F.lit(OUTSIDE).alias("state"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("at"))
    kind = "struct<state:int,depth:int,n:bigint,at:bigint>"
    before = lambda a, x: F.struct(a["state"].alias("state"), a["depth"].alias("depth"), a["n"].alias("n"), x["at"].alias("at"))
    return collected(does, begin, step, before, kind)


def json_array_elements(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(path, row_id, value): the text of each element of the JSON arrays at ``path``, numbered from 1 within its document.

    A document that is no array, or is not over at its end, fails the read.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    at = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))
    # A number of its own: rows of a few bytes stand for megabytes, and would be put together into few tasks.
    tasks = min(listed.agg(F.coalesce(F.sum(F.ceil(F.col("length") / size)), F.lit(0))).first()[0] + 1, MOST_TASKS)
    ranges = listed.select("path", "length", F.explode(at).alias("at")).withColumn("size", F.least(F.lit(size), F.col("length") - F.col("at"))).repartition(tasks, "path", "at")
    does = ranges.select("path", "at", "size").mapInArrow(_scan, "path string, at long, does array<struct<state:int,change:int,levels:array<int>,commas:array<bigint>>>")
    ordered = does.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("at", "does"))).alias("does"))
    last = F.struct(F.lit(-1).cast("long").alias("at"), F.col("does")[0]["does"].alias("does"))
    whole = ordered.withColumn("starts", _starts(F.concat("does", F.array(last))))
    end = F.element_at("starts", -1)
    over = (end["depth"] == 0) & (end["state"] == OUTSIDE)
    checked = F.when(over, F.slice("starts", 1, F.size("starts") - 1)).otherwise(F.raise_error(F.concat("path", F.lit(" is cut off, or its brackets do not match"))))
    starts = whole.select("path", F.explode(checked).alias("s")).select("path", "s.at", "s.state", "s.depth", F.col("s.n").alias("commas"))
    begun = ranges.join(starts, ["path", "at"]).select("path", "at", "size", "state", "depth", "commas", "length")
    return begun.repartition(tasks, "path", "at").mapInArrow(_elements, "path string, row_id long, value string")


def read_json_array(spark: SparkSession, path: str, element: str, size: int = RANGE) -> DataFrame:
    """(row_id, element fields) of JSON documents that are arrays of objects; row ids start at 1.

    An element that is not such an object fails the read with its document and number.
    """
    read = F.from_json("value", element.strip().removesuffix(">") + ",_bad:string>", {"columnNameOfCorruptRecord": "_bad"})
    parsed = json_array_elements(spark, path, size).withColumn("e", read)
    good = F.col("value").startswith("{") & F.try_parse_json("value").isNotNull() & F.col("e").isNotNull() & F.col("e._bad").isNull()
    checked = F.when(good, F.col("e").dropFields("_bad")).otherwise(
        F.raise_error(F.concat(F.lit("element "), F.col("row_id"), F.lit(" of "), F.col("path"), F.lit(" is not an object of the schema")))
    )
    return parsed.select("row_id", checked.alias("e")).select("row_id", "e.*")
