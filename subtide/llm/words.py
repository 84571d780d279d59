"""Vectorised word and hash helpers over Arrow text batches (used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from xxhash import xxh3_128_digest

#: Bytes that part words, as two tables over the 256 byte values.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NON_ALNUM = np.array([b < 0x80 and not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A) for b in range(256)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Text handled at once in a task; a longer text is handled alone. Arrays take some 60 bytes for each.
SLICE_BYTES = (1 << 18) - 4096


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of consecutive rows of at most ``most`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(raw: np.ndarray, offsets: np.ndarray, parting: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row): byte spans of maximal runs of non-parting bytes, within rows."""
    n = len(raw)
    word = np.zeros(n + 2, bool)
    np.logical_not(parting[raw], out=word[1 : n + 1])
    begins = word[1:] & ~word[:-1]
    stops = word[:-1] & ~word[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    if len(edge):
        both = edge[word[edge] & word[edge + 1]]
        begins[both] = True
        stops[both] = True
    starts = np.flatnonzero(begins[: n + 1])
    ends = np.flatnonzero(stops[: n + 1])
    return starts, ends, np.searchsorted(starts, offsets)


def word_names(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, words before each row): the 128-bit XXH3 of each white-space-parted word, as two 64-bit columns."""
    data, counts, parts = raw.tobytes(), [0], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        words = data[a:b].split()
        counts.append(len(words))
        parts.append(b"".join(map(xxh3_128_digest, words)))
    return np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2), np.cumsum(counts)


@lru_cache(maxsize=8)
def _byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64 - 1, 256, np.uint64)


_BASE = {0: 0x9E3779B97F4A7C15, 1: 0xC2B2AE3D27D4EB4F}


#: Powers by seed, as many as were needed so far.
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base modulo 2**64 and of its inverse."""
    if seed not in _POWERS or len(_POWERS[seed][0]) < n:
        size = max(1 << 18, 1 << (n - 1).bit_length())
        base = _BASE[seed] | 1
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[seed] = np.cumprod(up, out=up), np.cumprod(down, out=down)
    up, down = _POWERS[seed]
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run values[start:end], wherever it lies (uint64 values)."""
    up, down = powers(seed, len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])


def sliding_hashes(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """run_hashes of all runs of ``width`` values, without index arrays."""
    up, down = powers(seed, len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        h = total[width:] - total[:-width]
        h *= down[: len(h)]
        return mix(h)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return run_hashes(_byte_table(seed)[raw], starts, ends, seed)
