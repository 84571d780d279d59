"""SimHash near-dedup at a similarity: segment counts of whole shingle maps, a grid join, exact verification.

Each text has the SimHash of its five-word shingles, and what the operator of ``simhash``
links by its segment counts and grid is verified by whole sets. But a majority fingerprint of
64 bits differs in some ten bits at a Jaccard similarity of 0.8, farther than any exact grid of
it reaches. So beside it each text has the bit map of its lower-cased five-word shingles, two bits
a shingle, for the pairs that lie farther apart, and links are decided by the shingle sets themselves:

* Segments: a text's shingles in order, cut before each shingle whose hash is a
  multiple of the level's ``cut``. An edit of a word spoils the one or two segments it
  lies in, and a pair of similarity 0.8 has at most some a / 40 + 2 edits among a
  shingles, so it shares a good part of its segments; ``1 / KEEP`` of them is asked for.
  Texts of fewer than ``LEVELS[1][0]`` shingles have each shingle as a segment, where
  the bound is exact.
* Grid: all segments are counted over all texts. Of a text's segments, rarest first,
  only as many as could all be spoilt, and one more, open a cell; a passage that many
  texts share comes last and opens none unless most of the text is shared.
* Range: within a cell, the Manhattan distance of the maps' bit counts by 64-bit segment,
  then the Hamming distance of the maps; neither exceeds the symmetric difference of
  the sets, which the similarity bounds.
* Verification: the whole sets of the candidates.

Equal sets, told by 128 bits of two hashes, collapse first. Each text is verified against the most central text of its
cells, then the nearest texts of different components; what then still lies apart is
compared pair by pair. A cell of more than ``CELL``
members is compared in blocks whose pairs are separate units, so no task holds a whole
hot cell; a group of near copies does not emit all its pairs, and no pair comes from two
cells.

Defined results: a text of fewer than five words is one shingle; null, empty and
blank texts have the empty set and are equal to each other; doc_ids play no part, so
null or repeated ones do no harm; repeated rows share a component; an empty table gives
none; extra columns are ignored; a long text is handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm import words as W
from subtide.llm.components import components
from subtide.llm.lineage import HOT, dropped, join_unique, stored
from subtide.llm.simhash import fingerprints_of, links

WIDTH = 5
#: The least similarity as a fraction.
SIMILARITY = (4, 5)
#: (shingles from which the level holds, cut): a text near a level's end takes part in both.
LEVELS = ((1, 1), (64, 4), (256, 8), (1024, 16))
#: A similar pair shares one of so many segments at least.
KEEP = 4
CELL = 4096
#: Text hashes up to this number are broadcast.
BROADCAST_KEYS = 200_000


def shingles_of(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, offsets, first, other hashes) of consecutive texts: shingle hashes in order, and which are the first of their kind in the text."""
    for _, raw, offsets in W.slices(column):
        low = W.LOWER[raw]
        names, before = W.word_names(low, offsets)
        words = names[:, 0]
        n = len(before) - 1
        if not len(words):
            yield np.zeros(0, np.uint64), np.zeros(n + 1, np.int64), np.zeros(0, bool), np.zeros(0, np.uint64)
            continue
        counts = np.diff(before)
        shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        total = np.concatenate([[0], np.cumsum(shingles)])
        owner = np.repeat(np.arange(n), shingles)
        first = np.arange(total[-1]) - total[owner] + before[owner]
        last = np.minimum(first + width, before[owner + 1])
        h = W.run_hashes(words, first, last, seed=1)
        yield h, total, _distinct(h, owner), W.run_hashes(np.ascontiguousarray(names[:, 1]), first, last)


def _distinct(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Flags one of each distinct hash of an owner."""
    with np.errstate(over="ignore"):
        own = W.mix(h + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own)
    fresh = np.ones(len(own), bool)
    fresh[1:] = own[order[1:]] != own[order[:-1]]
    flags = np.zeros(len(own), bool)
    flags[order[fresh]] = True
    return flags


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, values.dtype)
    with np.errstate(over="ignore"):
        np.cumsum(values, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]


def names_of(h: np.ndarray, g: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, second name, number of shingles) of each set: 128 bits, from two independent hashes of its shingles; equal sets have equal names."""
    size = _sums(first.astype(np.int64), offsets)

    def name(x: np.ndarray) -> np.ndarray:
        total = _sums(np.where(first, W.mix(x ^ np.uint64(0x9E3779B97F4A7C15)), np.uint64(0)), offsets)
        with np.errstate(over="ignore"):
            return W.mix(total + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)

    return name(h), name(g), size


def bit_maps(h: np.ndarray, offsets: np.ndarray, size: np.ndarray) -> pa.Array:
    """Per set, the bytes of its map of two to four bits a shingle: a power of two, 64 at least."""
    bits = np.int64(1) << np.ceil(np.log2(np.maximum(2 * size, 64))).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(size)), np.diff(offsets))
    flat = np.zeros(base[-1], np.uint8)
    flat[base[owner] + (h & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)] = 1
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((base // 8).astype(np.int32)), pa.py_buffer(np.packbits(flat, bitorder="little"))])


def segments_of(h: np.ndarray, offsets: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct segments of all texts at a ``cut``."""
    begin = (h >> np.uint64(8)) % np.uint64(cut) == 0
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(begin)
    stop = np.append(at[1:], len(h))
    owner = np.searchsorted(offsets, at, "right") - 1
    with np.errstate(over="ignore"):
        seg = W.mix(W.run_hashes(h, at, stop) + np.uint64(cut))
    keep = _distinct(seg, owner)
    return seg[keep], owner[keep]


def _levels(size: np.ndarray, similarity: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """(cut, texts that take part) per level: a pair meets at the level of its smaller set."""
    num, den = similarity
    least = -(-num * size // den)  # the smallest partner
    ends = [low for low, _ in LEVELS[1:]] + [np.iinfo(np.int64).max]
    for (low, cut), end in zip(LEVELS, ends, strict=True):
        yield cut, (size >= low) & (least < end)


def _nodes(width: int, similarity: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, prints = 0, fingerprints_of(b["text"], width).view(np.int64)
            for h, o, first, g in shingles_of(b["text"], width):
                name, other, size = names_of(h, g, o, first)
                n = len(size)
                seg, owner, cuts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
                for cut, within in _levels(size, similarity) if len(h) else ():
                    if within.any():
                        more, whose = segments_of(h, o, cut)
                        keep = within[whose]
                        seg, owner, cuts = np.append(seg, more[keep]), np.append(owner, whose[keep]), np.append(cuts, np.full(keep.sum(), cut, np.int32))
                order = np.argsort(owner, kind="stable")
                seg, owner, cuts = seg[order], owner[order], cuts[order]
                heads = np.flatnonzero(np.diff(owner, prepend=-1) | np.diff(cuts, prepend=0)) if len(seg) else np.zeros(0, np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.append(heads, len(seg)), pa.int32()), pa.array(seg.view(np.int64)))
                levels = pa.StructArray.from_arrays([pa.array(cuts[heads]), keys], names=["cut", "keys"])
                bounds = np.concatenate([[0], np.cumsum(np.bincount(owner[heads], minlength=n))])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), levels)
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(row, n), b["text_hash"].slice(row, n), pa.array(name), pa.array(other), pa.array(size), pa.array(prints[row : row + n]), bit_maps(h, o, size), lists],
                    names=["doc_id", "text_hash", "name", "other", "size", "fp", "map", "segments"],
                )
                row += n

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, o, first, g in shingles_of(b["text"], width):
                name, other, size = names_of(h, g, o, first)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(h[first].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(other), lists], names=["name", "other", "shingles"])

    return run


def _folded(maps: list[bytes], n: int) -> np.ndarray:
    """The maps as rows of ``n`` bytes; longer ones are folded by halves, which the bit places allow."""
    out = []
    for m in maps:
        a = np.frombuffer(m, np.uint64)
        out.append(np.bitwise_or.reduce(a.reshape(-1, n // 8), axis=0))
    return np.stack(out)


def _pairs(similarity: tuple[int, int], best: bool):
    """Candidate pairs of each unit: all, or for each component only the nearest by its map.

    A pair counts in the first only of the cells that both open.
    """
    num, den = similarity

    def unit(node: np.ndarray, size: np.ndarray, comp: np.ndarray, maps: list[bytes], earlier: list[frozenset[int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(size, kind="stable")
        node, size, comp = node[order], size[order], comp[order]
        maps, earlier = [maps[i] for i in order], [earlier[i] for i in order]
        length = np.array([len(m) for m in maps])
        high = np.searchsorted(size, den * size // num, "right")
        within = np.unique(comp, return_inverse=True)[1]
        nearest, partner, mine = np.full(len(node), np.inf), np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)  # consecutive: a map's length follows the size
            lo, hi = int(own[0]), int(high[own[-1]])
            rows = _folded(maps[lo:hi], int(n))
            counts = np.bitwise_count(rows).astype(np.int16)
            for a in range(lo, int(own[-1]) + 1, 64):
                b = min(a + 64, int(own[-1]) + 1)
                j0 = a - lo
                most = (den - num) * (size[a:b, None] + size[None, a:hi]) // (den + num)
                inside = np.arange(a, hi)[None, :] > np.arange(a, b)[:, None]
                inside &= (np.arange(a, hi)[None, :] < high[a:b, None]) & (comp[a:b, None] != comp[None, a:hi])
                i, j = np.nonzero(inside)
                for c in range(0, len(i), 1 << 14):
                    x, y = i[c : c + (1 << 14)], j[c : c + (1 << 14)]
                    limit = most[x, y]
                    x, y = x + j0, y + j0
                    # Manhattan distance of the segments' bit counts, then of the bits.
                    near = np.abs(counts[x] - counts[y]).sum(axis=1) <= limit
                    x, y, limit = x[near], y[near], limit[near]
                    apart = np.bitwise_count(rows[x] ^ rows[y]).sum(axis=1)
                    near = apart <= limit
                    near[near] = [earlier[p].isdisjoint(earlier[q]) for p, q in zip((x[near] + lo).tolist(), (y[near] + lo).tolist(), strict=True)]
                    x, y = x[near] + lo, y[near] + lo
                    if not best and len(x):
                        yield node[x], node[y]
                    share = apart[near] / np.maximum(limit[near], 1)
                    for p, q in ((x, y), (y, x)) if best else ():
                        group = within[p]
                        np.minimum.at(nearest, group, share)
                        least = share == nearest[group]
                        partner[group[least]], mine[group[least]] = q[least], p[least]
        if best:
            some = np.flatnonzero(np.isfinite(nearest))
            yield node[mine[some]], node[partner[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["members"]
            offsets = lists.offsets.to_numpy()
            flat = lists.values
            node, size, comp = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("node", "size", "comp"))
            maps, opened = flat.field("map"), flat.field("cells")
            for key, a, e in zip(b["key"].to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                earlier = [frozenset(k for k in own if k < key) for own in opened.slice(a, e - a).to_pylist()]
                for u, v in unit(node[a:e], size[a:e], comp[a:e], maps.slice(a, e - a).to_pylist(), earlier):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    return run


def _joined(pairs: DataFrame, sides: DataFrame, side: str, other: str) -> DataFrame:
    """``pairs`` with the columns of ``sides`` (node, ...) for ``side``; a node with many pairs is dealt to several tasks.

    The nodes with more than ``HOT`` pairs are broadcast: one for so many rows of ``pairs`` at most.
    """
    one = F.lit(1).cast("long")
    hot = F.broadcast(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select(side, F.ceil(F.col("n") / HOT).cast("long").alias("parts")))
    salted = pairs.join(hot, side, "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("parts", one))).drop("parts")
    named = sides.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in sides.columns if c != "node"))
    dealt = named.join(hot, side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", one) - 1))).drop("parts")
    return salted.join(dealt, [side, "salt"]).drop("salt")


def verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) of a stored table whose whole sets are similar."""
    num, den = similarity
    both = _joined(_joined(pairs, sets, "u", "v"), sets, "v", "u")
    same = F.size(F.array_intersect("u_shingles", "v_shingles"))
    return stored(both.where((num + den) * same >= num * (F.size("u_shingles") + F.size("v_shingles"))).select("u", "v"))


def cells_of(nodes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(key, node): the cells of each text that another text shares.

    ``nodes`` has (node, segments by level). Rarest first, a text opens cells for as many
    segments as a partner may lack and one more; those that no other text has come
    first and need no cell.
    """
    num, den = similarity
    rows = nodes.select("node", F.explode("segments").alias("s")).select("node", "s.cut", F.size("s.keys").alias("total"), F.explode("s.keys").alias("key"))
    shared = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = join_unique(rows, shared.withColumn("w", F.col("n")), ["key"], "inner", "w")
    per = met.groupBy("node", "cut").agg(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("n", "key"))).alias("s"))
    least = F.when(F.col("cut") == 1, F.ceil(F.lit(num) * F.col("total") / den)).otherwise(F.ceil(F.col("total") / KEEP))
    opened = F.col("total") - least + 1 - (F.col("total") - F.size("s"))
    cells = stored(per.where(opened > 0).select("node", F.explode(F.slice(F.col("s"), F.lit(1), opened.cast("int"))).alias("c")).select("node", F.col("c.key").alias("key")))
    dropped(shared)
    return cells


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v): pairs of ``nodes`` (node, fp) to verify, as the SimHash operator links their fingerprints.

    Sets of one fingerprint are paired with its first, and the first of each fingerprint with those of the
    fingerprints that the operator's embedding and grid link to it: a row a set and a link at most.
    """
    prints = stored(nodes.groupBy("fp").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("w")))
    own = join_unique(nodes.select("fp", F.col("node").alias("v")), prints, ["fp"], "inner", "w").select(F.col("lead").alias("u"), "v")
    leads = prints.select(F.col("fp").alias("node"), "lead")
    linked = _joined(_joined(stored(links(prints.select("fp"))), leads, "u", "v"), leads, "v", "u").select(F.col("u_lead").alias("u"), F.col("v_lead").alias("v"))
    return stored(own.unionByName(linked).where("u <> v").distinct())


def near_copies(docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY, cell: int = CELL) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, component (a name of the component, not a doc_id)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    kept = stored(docs.mapInArrow(_nodes(width, similarity), "doc_id long, text_hash long, name long, other long, size long, fp long, map binary, segments array<struct<cut:int,keys:array<long>>>"))
    # A number for each set, stored with it; the two names tell sets apart.
    nodes = stored(
        kept.groupBy("name", "other").agg(
            F.min("text_hash").alias("text_hash"), F.first("size").alias("size"), F.min("fp").alias("fp"), F.first("map").alias("map"), F.first("segments").alias("segments"), F.count(F.lit(1)).alias("rows")
        ).withColumn("node", F.monotonically_increasing_id())
    )
    cells = cells_of(nodes.select("node", "segments"), similarity)
    counted = stored(cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    used = stored(join_unique(cells, counted.withColumn("w", F.col("n")), ["key"], "inner", "w").select("key", "node", "n"))
    dropped(cells)

    near_prints = fingerprint_pairs(nodes)
    wanted = stored(used.select("node").unionByName(near_prints.select(F.col("u").alias("node"))).unionByName(near_prints.select(F.col("v").alias("node"))).distinct())

    named = stored(nodes.join(wanted, "node", "left_semi").select("text_hash"))
    side = F.broadcast(named) if named.count() <= BROADCAST_KEYS else named
    texts = docs.select("text_hash", "text").join(side, "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
    numbers = nodes.join(wanted, "node", "left_semi").select("name", "other", "node")
    sets = stored(texts.select("text").mapInArrow(_sets(width), "name long, other long, shingles array<long>").join(numbers, ["name", "other"]).select("node", "shingles"))

    sides = stored(nodes.select("node", "size", "map").join(used.groupBy("node").agg(F.collect_list("key").alias("cells")), "node"))

    def candidates(labels: DataFrame, best: bool) -> DataFrame:
        """Pairs of texts that share a cell and have different labels (node, component)."""
        comp = used.join(labels, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("comp"))
        mixed = stored(comp.groupBy("key").agg(F.count(F.lit(1)).alias("w"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "w"))
        parts = F.ceil(F.col("n") / cell).cast("long")
        part = F.pmod(F.xxhash64("node"), F.col("parts"))
        k = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
        units = join_unique(comp, mixed, ["key"], "inner", "w").withColumn("parts", parts).withColumn("part", part).select(
            "key", "node", "comp", F.explode(F.transform(k, lambda o: F.struct(F.least(o, F.col("part")).alias("a"), F.greatest(o, F.col("part")).alias("b")))).alias("unit")
        )
        members = (
            units.join(sides, "node").groupBy("key", "unit")
            .agg(F.collect_list(F.struct("node", "size", "comp", "map", "cells")).alias("members")).where(F.size("members") > 1)
        )
        return stored(members.select("key", "members").mapInArrow(_pairs(similarity, best), "u long, v long").distinct())

    # What the fingerprints link, by whole sets.
    alike = verified(near_prints, sets, similarity)
    # Each text against the most central one (that with most company in its cells) of the cells it opens.
    central = used.groupBy("node").agg(F.sum("n").alias("company"))
    leaders = stored(
        used.join(central, "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("lead"), F.count(F.lit(1)).alias("w")).select("key", F.col("lead.node").alias("lead"), "w")
    )
    met = join_unique(used.select("key", "node"), leaders, ["key"], "inner", "w").where("node <> lead").groupBy(F.col("node").alias("v"), F.col("lead").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    star = verified(stored(met.groupBy("v").agg(F.max(F.struct("n", "u")).alias("b")).select("b.u", "v")), sets, similarity)
    # Of the texts that still lie apart, the nearest of each component of a cell; at last all pairs.
    near = verified(candidates(star.select(F.col("v").alias("node"), F.col("u").alias("component")), True), sets, similarity)
    found = stored(alike.unionByName(star).unionByName(near))
    found = stored(found.unionByName(verified(candidates(components(found), False), sets, similarity)))

    ends = stored(nodes.join(components(found), "node", "left").select("name", "other", F.coalesce("component", "node").alias("component"), "rows"))
    return join_unique(kept.select("doc_id", "text_hash", "name", "other"), ends, ["name", "other"], "inner", "rows").select("doc_id", "text_hash", "component")
