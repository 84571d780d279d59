"""Cross-document byte dedup by merging shard Burrows-Wheeler transforms.

What can repeat is found first. Each string of ``LENGTH`` bytes belongs to the
cell named by the smallest hash of its 24-byte grams; equal strings share a
cell, and consecutive strings of one cell form a fragment. Cells are counted over
all documents. Fragments of a cell with more than ``HEAVY`` of them are stored, and
their strings are dealt again from there, by the smallest hash of their 44-byte
grams, so that a common phrase in many surroundings makes many small cells; the
documents are not read for it a second time. Only fragments of cells that occur twice
or more go on.

Fragments are shuffled by cell. In a task they come in batches of whole cells of
some ``BATCH`` bytes and are dealt to shards by document. Each shard gets its own
Burrows-Wheeler transform over its different fragments. The shards' transforms
are then merged: an interleave vector, which
says from which shard each suffix in the merged order comes, is refined by two
characters a round from the transforms alone, without sorting the suffixes
again; a round touches only what the round before has parted. Where a round first parts two neighbours their common prefix is known to
within the round; intervals that ``LENGTH`` characters leave whole are the
repeated strings, and the smallest doc_id in an interval is the first.

A cell of 44-byte grams that still has more than ``HEAVY`` fragments is one
passage in as many places: its strings are dealt by their own hash (128 bits) and
the first document of each is a minimum with map-side combining, so no task
gathers it. Texts that recur whole take part once. What travels with the tasks
are Bloom filters of at most ``MOST_BITS`` bits; past that, more fragments are
shuffled, with equal results.

Defined results: a null or empty text has no bytes; texts shorter than
``LENGTH`` lose nothing; a null doc_id counts as larger than any, and null ones
as equal; rows that repeat a doc_id do not remove each other; an empty table
gives no rows; extra columns are ignored; a long text is handled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.llm import words as W
from subtide.llm.lineage import join_unique, stored
from subtide.llm.substring import attach, with_copies

LENGTH = 50
GRAM, FINE = 24, 44
HEAVY = 20_000
BATCH = 1 << 18
SHARDS = 2
#: A filter has 8 to 16 bits for each cell, of which a cell sets three, and 16 MB at most.
MOST_BITS, CELL_BITS = 27, 8
#: First bits of the three places that a cell has in a filter.
PLACES = (0, 18, 37)
#: Fragments hold at most so many strings, however periodic the text.
RUN = 128
LAST = 2**63 - 1
FRAGMENT = "cell long, d long, t long, start long, text binary"


# The transform of a shard and the merge ------------------------------------


def transform(code: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of strings written one after the other, each with an end.

    ``code`` holds characters from 1 and 0 for the ends, which lie at ``ends``. The
    order is by ``depth`` characters at least, an end the smallest and nothing
    after it: eight at once, then by doubling of ranks. Suffixes that agree that
    far may come in any order, as they lie in one interval.
    """
    n = len(code)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
    key = code.astype(np.uint64)
    for i in range(1, 8):
        key <<= np.uint64(8)
        key[: n - i] |= np.where(left[: n - i] >= i, code[i:], 0).astype(np.uint64)
    order = np.argsort(key)
    reach = 8
    while reach < depth:
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        key = rank * (rank[order[-1]] + 1)
        key[: n - reach] += np.where(left[: n - reach] >= reach, rank[reach:], 0)
        order = np.argsort(key)
        reach *= 2
    return order


def merge(pairs: list[np.ndarray], lasts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, parted): the merged order of the shards' suffixes by ``depth`` characters, two a round.

    ``pairs`` are the shards' transforms: by suffix order, the two characters
    before each suffix as one number, its high byte the earlier; 0 where a string starts
    within them. ``lasts`` are the last characters of the shards' strings.
    ``interleave`` holds shard numbers. ``parted`` is, for neighbours, the
    characters before the round that told them apart, ``depth`` where none did.

    A block holds the suffixes that are equal as far as the rounds have come, by
    shard and rank. The suffixes two characters longer than those of one block,
    with the same two characters, are one block as well, so a round touches only
    what lengthens the blocks that the round before has parted.
    """
    sizes, heads = np.array([len(p) for p in pairs]), np.array([len(x) for x in lasts])
    n, ended = sizes.sum(), heads.sum()
    begin = np.cumsum(sizes) - sizes
    tails = [x.astype(np.uint16) << np.uint16(8) for x in lasts]
    longer = np.full(n, -1, np.int32)  # the suffix two characters longer, -1 where its string starts within them
    for lo, k, tail, p in zip(begin, heads, tails, pairs, strict=True):
        order = np.argsort(np.concatenate([tail, p]), kind="stable")[2 * k :] - k
        rank = np.flatnonzero(order >= 0)
        longer[lo + order[rank]] = lo + k + rank
    # The first round: bare ends, then by two characters; a single character before an end is no other's equal.
    number = np.arange(len(pairs), dtype=np.uint8)
    first, pair = np.repeat(number, heads), np.concatenate(pairs)
    keys = np.concatenate([*tails, pair])
    order = np.argsort(keys, kind="stable")[2 * ended :]
    shard = np.concatenate([first, np.concatenate([first, np.repeat(number, sizes)])[order]])
    keys, lone = keys[order], order < ended
    apart = np.ones(n, bool)
    apart[ended + 1 :] = (keys[1:] != keys[:-1]) | lone[1:] | lone[:-1]
    common = np.where(apart, 0, depth).astype(np.int16)
    suffix, place = np.empty(n, np.int32), np.empty(n, np.int32)
    for s, (lo, size) in enumerate(zip(begin, sizes, strict=True)):
        suffix[shard == s] = np.arange(lo, lo + size)
    place[suffix] = np.arange(n)
    active = np.arange(n)
    for done in range(2, depth, 2):
        x, block = suffix[active], np.cumsum(apart[active], dtype=np.int32)
        order = np.argsort(pair[x], kind="stable")
        x, block = longer[x[order]], block[order]
        inside = x >= 0
        x, block = x[inside], block[inside]
        at = np.sort(place[x])  # whole blocks keep their places together
        suffix[at], place[x] = x, at
        head = apart[at]
        fresh = np.zeros(len(at), bool)
        fresh[1:] = ~head[1:] & (block[1:] != block[:-1])
        if not fresh.any():
            break
        common[at[fresh]], apart[at[fresh]] = done, True
        heads_at = np.flatnonzero(head)
        parted = np.logical_or.reduceat(fresh, heads_at)
        active = at[np.repeat(parted, np.diff(np.append(heads_at, len(at))))]
    return (np.searchsorted(begin, suffix, "right") - 1).astype(np.uint8), common


def first_owner(strings: pa.Array, owner: np.ndarray, length: int, shards: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(owners, offsets): for every byte of the strings the smallest owner of an equal string of ``length`` bytes.

    ``shards`` are the numbers of strings in each shard, in their order. Bytes too
    close to their string's end keep the string's own owner.
    """
    k = len(strings)
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + k + 1].astype(np.int64)
    text = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    ends = offsets[1:] + np.arange(k)
    code = np.zeros(len(text) + k, np.uint16)
    inside = np.ones(len(code), bool)
    inside[ends] = False
    present = np.flatnonzero(np.bincount(text, minlength=256))
    rank = np.zeros(256, np.uint16)
    rank[present] = np.arange(1, len(present) + 1)  # at most 255 different bytes: UTF-8 has no FF
    code[inside] = rank[text]
    before = np.zeros(len(code) + 2, np.uint16)
    before[2:] = code
    pair = (before[:-2] << np.uint16(8)) | before[1:-1]
    pair[(before[:-2] == 0) | (before[1:-1] == 0)] = 0
    cuts = np.unique(np.cumsum([0, *shards]))
    parts = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = offsets[a] + a, offsets[b] + b
        parts.append((lo, transform(code[lo:hi], ends[a:b] - lo, length), code[ends[a:b] - 1]))
    shard, common = merge([pair[lo:][order] for lo, order, _ in parts], [last for *_, last in parts], length)
    place = np.empty(len(shard), np.int64)  # in the strings with their ends
    for s, (lo, order, _) in enumerate(parts):
        place[shard == s] = order + lo
    whose = np.repeat(owner, np.diff(offsets) + 1)[place]
    heads = np.flatnonzero(common < length)
    least = np.minimum.reduceat(whose, heads)
    result = np.empty(len(shard), np.int64)
    result[place] = np.repeat(least, np.diff(np.append(heads, len(shard))))
    return result[inside], offsets


# Cells and fragments ---------------------------------------------------------


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values, from those of runs twice as long each time."""
    least, reach = values, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def _filter(cells: DataFrame) -> tuple[bytes, int]:
    """A Bloom filter of the column ``cell`` and its number of bits as a power of two."""
    bits = min(MOST_BITS, max(15, ceil(log2(CELL_BITS * (cells.count() + 1)))))
    places = F.array(*(F.shiftrightunsigned("cell", p).bitwiseAND(F.lit((1 << bits) - 1)) + 1 for p in PLACES))
    parts = (
        cells.select(F.explode(places).alias("place")).select(F.bitmap_bucket_number("place").alias("b"), F.bitmap_bit_position("place").alias("p"))
        .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    )
    whole = bytearray(1 << (bits - 3))
    for r in parts:
        whole[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["m"]
    return bytes(whole), bits


def _passes(bloom: tuple[bytes, int], cells: np.ndarray) -> np.ndarray:
    """Which cells the filter has; some that it was not made of, too."""
    table, bits = np.frombuffer(bloom[0], np.uint8), bloom[1]
    found = np.ones(len(cells), bool)
    for p in PLACES:
        place = (cells >> np.uint64(p)) & np.uint64((1 << bits) - 1)
        found &= (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return found


def _stretches(cell: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the runs of valid strings of one cell."""
    edge = ~valid
    edge[1:] |= (cell[1:] != cell[:-1]) | ~valid[:-1]
    edge[0] = True
    at = np.flatnonzero(edge)
    inside = valid[at]
    return at[inside], np.append(at[1:], len(cell))[inside]


def _fragments(column: pa.Array, length: int, gram: int):
    """Per slice: (row, raw, row offsets, first bytes, numbers of strings, cells) of the fragments."""
    for row, raw, offsets in W.slices(column):
        n = len(raw)
        none = np.zeros(0, np.int64)
        if n < length:
            yield row, raw, offsets, none, none, none.view(np.uint64)
            continue
        cell = _least(W.sliding_hashes(W._byte_table(0)[raw], gram), length - gram + 1)
        valid = np.ones(len(cell), bool)
        for end in offsets[1:].tolist():
            valid[max(end - length + 1, 0) : end] = False
        head, stop = _stretches(cell, valid)
        count = stop - head
        pieces = -(-count // RUN)
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(head, pieces) + part * RUN
        yield row, raw, offsets, first, np.minimum(np.repeat(stop, pieces) - first, RUN), W.mix(cell[first])


def _count_cells(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *_, cells in _fragments(b["text"], length, gram):
                values, n = np.unique(cells, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["cell", "n"])

    return run


def _emit(cells_in: tuple[bytes, int], cells_out: tuple[bytes, int] | None, length: int, gram: int):
    """Fragments of the cells that the first filter has and the second has not; ``start`` counts from that of their row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, raw, offsets, first, count, cells in _fragments(b["text"], length, gram):
                take = _passes(cells_in, cells)
                if cells_out:
                    take &= ~_passes(cells_out, cells)
                first, count, cells = first[take], count[take], cells[take]
                owner = np.searchsorted(offsets, first, "right") - 1
                rows = pa.array(owner + row)
                start = b["start"].to_numpy()[owner + row] + first - offsets[owner]
                size = count + length - 1
                to = np.concatenate([[0], np.cumsum(size)])
                data = raw[np.repeat(first - to[:-1], size) + np.arange(to[-1])]
                text = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.view(np.int64)), b["d"].take(rows), b["t"].take(rows), pa.array(start), text], names=["cell", "d", "t", "start", "text"]
                )

    return run


def _single(length: int):
    """The strings of fragments, by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, raw, offsets in W.slices(b["text"]):
                count = np.diff(offsets) - length + 1
                owner = np.repeat(np.arange(len(count)), count)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                first = offsets[owner] + place
                values = W._byte_table(0)[raw]
                hashes = [W.run_hashes(values, first, first + length, s) for s in (0, 1)]
                rows = pa.array(owner + row)
                start = pa.array(b["start"].to_numpy()[owner + row] + place)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(h.view(np.int64)) for h in hashes), b["d"].take(rows), b["t"].take(rows), start], names=["high", "low", "d", "t", "start"]
                )

    return run


def _runs(flag: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of true flags within a group."""
    on = np.zeros(len(flag) + 1, bool)
    on[:-1] = flag
    change = np.ones(len(flag) + 1, bool)
    change[1:-1] = group[1:] != group[:-1]
    begin = on & (change | ~np.concatenate([[False], on[:-1]]))
    first = np.flatnonzero(begin)
    stops = np.flatnonzero(begin | ~on)
    return first, np.append(stops, len(flag))[np.searchsorted(stops, first, "right")] - first


def _resolve(length: int):
    """Whole cells, sorted -> (d, t, start, n): runs of strings that a smaller document has."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        cell, d = table["cell"].to_numpy(), table["d"].to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        several = np.minimum.reduceat(d, heads) < np.maximum.reduceat(d, heads)  # else no smaller document
        table = table.filter(pa.array(np.repeat(several, np.diff(np.append(heads, len(cell))))))
        if not len(table):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names=["d", "t", "start", "n"])
        shard = (W.mix(table["d"].to_numpy().view(np.uint64)) % np.uint64(SHARDS)).astype(np.int64)
        table = table.take(pa.array(np.argsort(shard, kind="stable")))
        sizes = np.bincount(shard, minlength=SHARDS)
        strings, which, seen = [], [], 0
        for lo, size in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
            if size:  # a shard's transform holds each of its different fragments once
                coded = table["text"].slice(lo, size).combine_chunks().dictionary_encode()
                coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
                strings.append(coded.dictionary)
                which.append(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + seen)
                seen += len(coded.dictionary)
        which = np.concatenate(which)
        d, t, at = (table[c].to_numpy() for c in ("d", "t", "start"))
        owner = np.full(seen, LAST, np.int64)
        np.minimum.at(owner, which, d)
        first, offsets = first_owner(pa.concat_arrays(strings), owner, length, [len(x) for x in strings])
        windows = (np.diff(offsets) - length + 1)[which]
        row = np.repeat(np.arange(len(d)), windows)
        place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        to, n = _runs(first[offsets[:-1][which[row]] + place] < d[row], row)
        rows, begin = row[to], place[to]
        return pa.RecordBatch.from_arrays([pa.array(d[rows]), pa.array(t[rows]), pa.array(at[rows] + begin), pa.array(n)], names=["d", "t", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, 2048)
                at += part.num_rows
                if held and size >= BATCH:  # a new batch starts with a new cell
                    cells = part["cell"].to_numpy()
                    new = int(np.searchsorted(cells != held[-1]["cell"][-1].as_py(), True))
                    if new < len(cells):
                        held.append(part.slice(0, new))
                        yield solve(pa.Table.from_batches(held))
                        held, size, part = [], 0, part.slice(new)
                held.append(part)
                size += part["text"].nbytes
        if held and sum(map(len, held)):
            yield solve(pa.Table.from_batches(held))

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone_whole = b["gone"].to_numpy(zero_copy_only=False)
            lists = b["runs"]
            rows = []
            for k, text in enumerate(b["text"]):
                data = (text.as_py() or "").encode()
                n = len(data)
                spans: list[tuple[int, int]] = []
                if gone_whole[k]:
                    spans = [(0, n)] if n >= length else []
                elif lists[k].is_valid:
                    v = lists[k].values
                    a = v.field("start").to_numpy()
                    e = a + v.field("n").to_numpy() + length - 1
                    order = np.argsort(a, kind="stable")
                    a, e = a[order], np.maximum.accumulate(e[order])
                    new = np.concatenate([[True], a[1:] > e[:-1]])
                    spans = list(zip(a[new].tolist(), e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)].tolist(), strict=True))
                kept, at = [], 0
                for x, y in spans:
                    kept.append(data[at:x])
                    at = y
                kept.append(data[at:])
                rest = b"".join(kept)
                rows.append((n, n - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), [{"start": x, "end": y} for x, y in spans]))
            n, r, s, h, p = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(h, pa.string()),
                 pa.array(p, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return run


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, fine: int = FINE, heavy: int = HEAVY) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges).

    ``length`` is even, as the merge takes two characters a round, and no shorter than ``gram`` and ``fine``.
    """
    if length % 2 or length < max(gram, fine):
        raise ValueError(f"length {length} is odd or shorter than a gram of {gram} or {fine} bytes")
    rows = with_copies(docs).withColumn("d", F.coalesce("doc_id", F.lit(LAST)))
    leads = rows.where("lead").select("d", "t", F.lit(0).cast("long").alias("start"), "text")

    def cells(texts: DataFrame, gram: int) -> DataFrame:
        counts = texts.select("text").mapInArrow(_count_cells(length, gram), "cell long, n long")
        return stored(counts.groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1"))

    def over(counted: DataFrame) -> tuple[bytes, int] | None:
        many = counted.where(F.col("n") > heavy)
        return None if many.isEmpty() else _filter(many)

    def emitted(texts: DataFrame, inside: tuple[bytes, int], outside: tuple[bytes, int] | None, gram: int) -> DataFrame:
        return texts.mapInArrow(_emit(inside, outside, length, gram), FRAGMENT)

    shared, passages = cells(leads, gram), None
    again = over(shared)
    fragments = emitted(leads, _filter(shared.where(F.col("n") <= heavy)), again, gram)
    if again:
        dense = stored(emitted(leads, again, None, gram).drop("cell"))
        dealt = cells(dense, fine)
        passages = over(dealt)
        fragments = fragments.unionByName(emitted(dense, _filter(dealt.where(F.col("n") <= heavy)), passages, fine))
    found = fragments.repartition("cell").sortWithinPartitions("cell").mapInArrow(_resolve(length), "d long, t long, start long, n long")
    if passages:
        found = found.unionByName(_passages(emitted(dense, passages, None, fine), length))
    runs = (
        found.groupBy("d", "t").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
        .select(F.col("d").alias("_id"), F.col("t").alias("_t"), "runs")
    )
    done = attach(rows, runs, "runs", "d").withColumn("gone", ~F.col("lead"))
    return done.select("doc_id", "text", "gone", "runs").mapInArrow(
        _cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    )


def _passages(fragments: DataFrame, length: int) -> DataFrame:
    """(d, t, start, n): strings of passages that a smaller document has."""
    single = stored(fragments.mapInArrow(_single(length), "high long, low long, d long, t long, start long"))
    least = single.groupBy("high", "low").agg(F.min("d").alias("least"), F.max("d").alias("most"), F.count(F.lit(1)).alias("rows"))
    least = stored(least.where("least < most").drop("most"))
    firsts = join_unique(single, least, ["high", "low"], "inner", "rows").where("least < d")
    return firsts.select("d", "t", "start", F.lit(1).cast("long").alias("n"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_bytes(docs).drop("spans")


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT rid, doc_id, k, substr(x, 2 * k + 1, {2 * LENGTH}) AS g FROM (SELECT rid, doc_id, x, unnest(range(0, (len(x) // 2 - {LENGTH - 1})::BIGINT)) AS k FROM d)),
f AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT rid, k, coalesce(k - lag(k) OVER (PARTITION BY rid ORDER BY k) > {LENGTH}, true) AS fresh
        FROM s JOIN f USING (g) WHERE doc_id > least),
grp AS (SELECT rid, k, sum(fresh::INT) OVER (PARTITION BY rid ORDER BY k) AS span FROM hit),
sp AS (SELECT rid, span, min(k) AS a, max(k) + {LENGTH} AS e FROM grp GROUP BY rid, span),
per AS (SELECT rid, count(*) AS n_spans, sum(e - a) AS n_removed, list(struct_pack(a := a, e := e) ORDER BY a) AS spans FROM sp GROUP BY rid),
k AS (SELECT d.rid, doc_id, len(x) // 2 AS n, coalesce(n_removed, 0) AS r, coalesce(n_spans, 0) AS s, x, list_concat([0], coalesce(list_transform(spans, lambda p: p.e), [])) AS froms,
             list_concat(coalesce(list_transform(spans, lambda p: p.a), []), [len(x) // 2]) AS tos FROM d LEFT JOIN per USING (rid))
SELECT doc_id, n::BIGINT AS n_bytes, r::BIGINT AS n_removed, s::BIGINT AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(1, len(froms) + 1), lambda i: substr(x, 2 * froms[i] + 1, 2 * (tos[i] - froms[i]))), ''))) AS kept_sha256
FROM k
"""

QUERIES = {"op4_suffix_array_dedup": op4_suffix_array_dedup}
ORACLES = {"op4_suffix_array_dedup": ORACLE_SQL}
