"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint maps to the bit counts of its 32 two-bit segments. The Manhattan
distance of two such vectors never exceeds the Hamming distance of the
fingerprints, so links of at most three differing bits lie within Manhattan
distance three. The grid: the segments fall into six blocks, and vectors within
distance three agree on at least three whole blocks, so each fingerprint goes to
one cell per choice of three blocks. Within a cell, members are compared along
the sorted total bit count (a range of three either side), by the Manhattan
distance of their segment counts, and what it leaves by the fingerprints' bits.
Counts are held in unary (0, 1, 3), in which the Manhattan distance is the number
of differing bits.

Equal fingerprints collapse first. A cell of more than ``CELL`` members is dealt
by a second grid: its other three blocks are halved, and three of the six halves
agree as well. What is still larger is split into blocks whose pairs are separate
units, so no task holds a whole cell; a unit returns a spanning forest of its
links, never its pairs.

Defined results: null and empty texts have fingerprint zero, which links like
any other; rows without a doc_id link like any other, and a component's name is the
smallest doc_id in it, null where it has none; repeated rows are rows of their own;
an empty table gives no rows; extra columns are ignored; a long text is handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.llm import words as W
from subtide.llm.components import components
from subtide.llm.lineage import join_unique, stored

DISTANCE = 3
SHINGLE = 3
BLOCKS = 6
CELL = 4096


def fingerprints_of(column: pa.Array, width: int = SHINGLE) -> np.ndarray:
    """uint64 SimHash of each text: XXH64 (seed 42) of lower-cased word shingles, majority per bit."""
    parts = [np.zeros(0, np.uint64)]
    digest = xxhash.xxh64_intdigest
    for _, raw, offsets in W.slices(column):
        low = W.LOWER[raw]
        starts, ends, before = W.spans(low, offsets, W.SPACES)
        n = len(before) - 1
        out = np.zeros(n, np.uint64)
        parts.append(out)
        if not len(starts):
            continue
        keep = ~W.SPACES[low]
        after = ends[ends < len(low)]
        keep[after[W.SPACES[low[after]]]] = True
        place = np.zeros(len(low) + 1, np.int64)
        np.cumsum(keep, out=place[1:])
        text = np.where(W.SPACES[low], np.uint8(0x20), low)[keep].tobytes()
        counts = np.diff(before)
        shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        last = np.repeat(before[1:], shingles)
        total = np.concatenate([[0], np.cumsum(shingles)])
        first = np.arange(total[-1]) - np.repeat(total[:-1], shingles) + np.repeat(before[:-1], shingles)
        begin = place[starts[first]].tolist()
        end = place[ends[np.minimum(first + width, last) - 1]].tolist()
        h = np.fromiter((digest(text[a:b], 42) for a, b in zip(begin, end, strict=True)), np.uint64, len(begin))
        full = np.flatnonzero(shingles)
        step = 1 << 17  # rows of bits at once
        ones = np.zeros((len(full), 64), np.int64)
        for a in range(0, len(h), step):
            bits = np.unpackbits(h[a : a + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            owner = np.searchsorted(total[full], np.arange(a, a + len(bits)), "right") - 1
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            ones[owner[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        out[full] = np.packbits(ones * 2 > shingles[full][:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return np.concatenate(parts)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"], b["text_hash"], pa.array(fingerprints_of(b["text"]).view(np.int64))], names=["doc_id", "text_hash", "fp"]
        )


def embedding(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, packed as two-bit lanes."""
    m = np.uint64(0x5555555555555555)
    return (fp & m) + ((fp >> np.uint64(1)) & m)


def unary(v: np.ndarray) -> np.ndarray:
    """Embeddings with the lanes 0, 1, 2 written as 0, 1, 3: the Manhattan distance is the number of differing bits."""
    return v | ((v >> np.uint64(1)) & np.uint64(0x5555555555555555))


def _edges(a: int, b: int, n: int) -> list[int]:
    """Masks of ``n`` even runs of the segments [a, b)."""
    cuts = [a + round(i * (b - a) / n) for i in range(n + 1)]
    return [sum(3 << (2 * s) for s in range(x, y)) for x, y in zip(cuts, cuts[1:])]


def _cell_masks(blocks: int, agree: int) -> list[tuple[int, list[int]]]:
    """Masks of the blocks that agree, each with those of its second grid: of the halves of the other blocks as many agree."""
    cuts = [round(i * 32 / blocks) for i in range(blocks + 1)]
    block = _edges(0, 32, blocks)
    found = []
    for chosen in combinations(range(blocks), agree):
        halves = [m for i in range(blocks) if i not in chosen for m in _edges(cuts[i], cuts[i + 1], 2)]
        found.append((sum(block[i] for i in chosen), [sum(c) for c in combinations(halves, len(halves) - (blocks - agree))]))
    return found


def _keys(v: np.ndarray, mask: int, number: int) -> np.ndarray:
    return W.mix((v & np.uint64(mask)) ^ W.mix(np.full(1, number, np.uint64)))


def _cells(blocks: int, distance: int):
    masks = _cell_masks(blocks, blocks - distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b["fp"].to_numpy(zero_copy_only=False)
            v = embedding(fp.view(np.uint64))
            cells = np.concatenate([_keys(v, m, k + 1) for k, (m, _) in enumerate(masks)])
            grid = np.repeat(np.arange(len(masks), dtype=np.int32), len(fp))
            yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(grid), pa.array(np.tile(fp, len(masks)))], names=["cell", "grid", "fp"])

    return run


def _second(blocks: int, distance: int):
    """Members of large cells -> their cells in the second grid."""
    masks = _cell_masks(blocks, blocks - distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, grid, fp = (b[c].to_numpy(zero_copy_only=False) for c in ("cell", "grid", "fp"))
            for k in np.unique(grid).tolist():
                own = np.flatnonzero(grid == k)
                v = embedding(fp[own].view(np.uint64))
                for j, m in enumerate(masks[k][1]):
                    with np.errstate(over="ignore"):
                        keys = W.mix(cell[own].view(np.uint64) + _keys(v, m, j + 1))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp[own])], names=["cell", "fp"])

    return run


def _forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that connect what lies within ``distance``, at most one per member."""
    count = np.bitwise_count(fp)
    order = np.argsort(count, kind="stable")
    fp, count = fp[order], count[order].astype(np.int64)
    counts = unary(embedding(fp))
    n, label = len(fp), np.arange(len(fp))
    high = np.searchsorted(count, count + distance, "right")
    pairs = []
    for a in range(0, n, 256):
        b = min(a + 256, n)
        hi = int(high[b - 1])
        i, j = np.nonzero(np.bitwise_count(counts[a:b, None] ^ counts[None, a:hi]) <= distance)
        i, j = i + a, j + a
        ok = (j > i) & (np.bitwise_count(fp[i] ^ fp[j]) <= distance)
        pairs.append((i[ok], j[ok]))
        if sum(len(p[0]) for p in pairs) > 1 << 20 or b == n:
            i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
            pairs = []
            while len(i):
                x, y = label[i], label[j]
                differ = x != y
                i, j, x, y = i[differ], j[differ], x[differ], y[differ]
                if not len(i):
                    break
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while (label != label[label]).any():
                    label = label[label]
    linked = np.flatnonzero(label != np.arange(n))
    return fp[linked], fp[label[linked]]


def _link(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["members"]
            offsets = lists.offsets.to_numpy()
            fp = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.diff(offsets)
            us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            # Small units together, by the distance of places within the unit; each large one alone.
            owner = np.repeat(np.where(sizes <= 16, np.arange(len(sizes)), -1), sizes)
            f = fp[offsets[0] : offsets[-1]]
            counts = unary(embedding(f))
            for d in range(1, int(min(16, sizes.max(initial=1)))):
                at = np.flatnonzero((owner[:-d] == owner[d:]) & (owner[d:] >= 0))
                at = at[np.bitwise_count(counts[at] ^ counts[at + d]) <= distance]
                at = at[np.bitwise_count(f[at] ^ f[at + d]) <= distance]
                us.append(f[at])
                vs.append(f[at + d])
            for k in np.flatnonzero(sizes > 16):
                u, v = _forest(fp[offsets[k] : offsets[k + 1]], distance)
                us.append(u)
                vs.append(v)
            u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """(u, v): a connecting set of links between the different fingerprints (fp) of ``distinct``."""
    cells = distinct.select("fp").mapInArrow(_cells(blocks, distance), "cell long, grid int, fp long")
    large = stored(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell))
    if large.isEmpty():
        members = cells.groupBy("cell").agg(F.collect_list("fp").alias("members"))
        return members.where(F.size("members") > 1).select("members").mapInArrow(_link(distance), "u long, v long").distinct()
    few = cells.join(large, "cell", "left_anti").select("cell", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "fp")
    finer = stored(cells.join(large, "cell", "left_semi").mapInArrow(_second(blocks, distance), "cell long, fp long"))
    parts = finer.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell).cast("long").alias("parts")).where("parts > 1")
    one = F.coalesce("parts", F.lit(1).cast("long"))
    part, k = F.pmod(F.xxhash64("fp"), one), F.sequence(F.lit(0).cast("long"), one - 1)
    split = finer.join(parts, "cell", "left").withColumn("part", part).select(
        "cell", F.explode(F.transform(k, lambda o: F.struct(F.least(o, F.col("part")).alias("a"), F.greatest(o, F.col("part")).alias("b")))).alias("unit"), "fp"
    )
    units = few.unionByName(split.select("cell", "unit.a", "unit.b", "fp"))
    members = units.groupBy("cell", "a", "b").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    return members.select("members").mapInArrow(_link(distance), "u long, v long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, fp (signed long), component_id."""
    kept = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
        .mapInArrow(_fingerprint, "doc_id long, text_hash long, fp long")
    )
    distinct = stored(kept.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    found = components(links(distinct)).select(F.col("node").alias("fp"), "component")
    linked = stored(distinct.join(found, "fp").select("fp", "least", "component"))
    least = stored(linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("w")))
    ids = join_unique(linked, least, ["component"], "inner", "w").select("fp", "component_id")
    named = stored(distinct.join(ids, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "rows"))
    return join_unique(kept, named, ["fp"], "inner", "rows").select("doc_id", "text_hash", "fp", "component_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_near_dedup": op3_simhash_near_dedup}
ORACLES: dict[str, str] = {}
