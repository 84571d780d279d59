"""Vector best-fit packing of tokenised documents into training sequences.

A bin's residual capacity is a vector: tokens, documents and attention cost (the
sum of squared piece lengths). Pieces go in by falling length; of the open bins
that satisfy every constraint, the one whose residual vector is left with the
smallest weighted norm is taken (``select="norm"``), or the one with the largest
weighted dot product of need and residual (``select="dot"``).

Documents are cut only where they exceed a sequence. Whole sequences are closed
where they are tokenised; the other pieces are dealt at random to groups of some
``GROUP`` pieces, each packed by a task of its own, and what lies in the bins
that stay emptier than ``FULL`` is dealt and packed once more. The number of
groups follows the input; a group's size does not.

Defined results: a null or empty text is the end token alone; equal texts and
repeated rows are packed as documents of their own, and so are rows without a
doc_id, whose pieces carry a null one; of pieces of equal length the one read
first goes in first; an empty table gives no sequences; extra columns are ignored;
a long text is tokenised whole and only then cut.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.llm.lineage import stored

GROUP = 8192
FULL = 0.99
#: Bytes of chunks and ids that a generation of a Python worker's cache may hold; it has two.
CACHE_BYTES = 80 << 20
#: Bytes of an entry besides its characters and ids.
ENTRY_BYTES = 160
_MARK = re.compile(r"([.,])(?<=[^\W_].)(?= )")


@dataclass(frozen=True)
class Capacity:
    """Limits of one sequence; the defaults for documents and cost never bind before the tokens do."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    select: str = "norm"


class _Encoder:
    """Ids of a text from a cache of the ids of its space-parted chunks.

    The tokenizer drops white space and never joins over it, so a text's ids are
    those of its chunks in order. Unknown chunks are encoded together: plain
    lower-case words many to a string, by the same model without its
    normaliser, to be cut after each token that ends a word; anything else by
    the tokenizer as it is. A cache that holds ``CACHE_BYTES`` becomes the older
    generation, whose chunks are forgotten unless they are seen again before the next.
    """

    _kept: dict[str, _Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        to_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        rules |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, to_bytes]}}
        self.plain = Tokenizer.from_str(json.dumps(rules))
        suffix = rules["model"]["end_of_word_suffix"]
        vocabulary = self.plain.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.held = 0

    @classmethod
    def of(cls, path: str) -> _Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _encode(self, chunks: list[str]) -> None:
        known = self.cache
        words = [c for c in chunks if c.isalpha() and max(c) < "\u0530" and (c.isascii() and c.islower() or c == c.lower() and is_normalized("NFC", c))]
        other = set(chunks).difference(words)
        for c, e in zip(other, self.tokenizer.encode_batch_fast(list(other), add_special_tokens=False), strict=True):
            known[c] = np.array(e.ids, "<u4").tobytes()
        groups = [words[a : a + 64] for a in range(0, len(words), 64)]
        for group, e in zip(groups, self.plain.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            data, at = ids.tobytes(), 0
            for c, stop in zip(group, (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), strict=True):
                known[c] = data[at:stop]
                at = stop

    def _learn(self, chunks: set[str]) -> None:
        """Finds the ids of chunks not in the cache."""
        fresh = []
        for c in chunks:
            ids = self.older.get(c)
            if ids is None:
                fresh.append(c)
            else:
                self.cache[c] = ids
        self._encode(fresh)
        self.held += sum(ENTRY_BYTES + len(c) + len(self.cache[c]) for c in chunks)

    def forget(self) -> None:
        """Lets go of the cache, so that an idle worker holds none."""
        self.cache, self.older, self.held = {"": b""}, {}, 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.held > CACHE_BYTES:
            self.older, self.cache, self.held = self.cache, {"": b""}, 0
        parts = [_parted(t) for t in texts]
        flat = list(chain.from_iterable(parts))
        found = list(map(self.cache.get, flat))
        unknown = [k for k, v in enumerate(found) if v is None]
        self._learn({flat[k] for k in unknown})
        for k in unknown:
            found[k] = self.cache[flat[k]]
        stops = list(accumulate(map(len, parts), initial=0))
        return [b"".join(found[a:b]) for a, b in zip(stops[:-1], stops[1:], strict=True)]


def _parted(text: str) -> list[str]:
    """Space-parted chunks of a text with the same ids.

    A text within Latin-1 is composed already and lower-cased at once. A comma or
    full stop between a letter or digit and a space is a piece of its own to the
    tokenizer, so it is parted from its word.
    """
    try:
        text.encode("latin-1")
        text = text.lower()
    except UnicodeEncodeError:
        pass
    return _MARK.sub(r" \1", text.replace("\n", " ")).split(" ")


def _cut(path: str, size: int, end: int):
    """Documents -> pieces; a full piece gets a sequence of its own (negative number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder.of(path)
        task = TaskContext.get().partitionId()
        rid, alone = task << 40, -(task << 40) - 1
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                rows = []
                texts = [t or "" for t in part["text"].to_pylist()]
                for k, ids in enumerate(encoder.encode(texts)):
                    ids += tail
                    for piece, a in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[a : a + 4 * size]
                        n = len(own) // 4
                        rows.append((k, rid, piece, a // 4, n, zlib.crc32(own), alone if n == size else None))
                        alone -= n == size
                    rid += 1
                k, r, p, s, n, c, q = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"].take(pa.array(k, pa.int64())), pa.array(r, pa.int64()), pa.array(p, pa.int32()), pa.array(s, pa.int64()),
                        pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(q, pa.int64()),
                    ],
                    names=["doc_id", "rid", "piece", "start", "length", "ids_crc32", "sequence_id"],
                )
        encoder.forget()

    return run


def best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece by vector best-fit decreasing."""
    full = np.array([cap.tokens, cap.documents, cap.cost], float)
    weight = np.array(cap.weights) / full**2
    order = np.argsort(-lengths, kind="stable")
    least = lengths.min(initial=1)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rest = np.zeros((3, 1024))  # residuals of the open bins
    name = np.zeros(1024, np.int64)
    opened = used = 0
    for i in order:
        n = int(lengths[i])
        need = np.array([n, 1.0, float(n) * n])
        r = rest[:, :used]
        fits = np.flatnonzero((r[0] >= need[0]) & (r[1] >= 1) & (r[2] >= need[2]))
        if len(fits):
            if cap.select == "dot":
                k = fits[np.argmax((weight * need) @ r[:, fits])]
            else:
                k = fits[np.argmin(weight @ (r[:, fits] - need[:, None]) ** 2)]
        else:
            if used == rest.shape[1]:
                rest, name = np.concatenate([rest, np.zeros_like(rest)], axis=1), np.concatenate([name, np.zeros_like(name)])
            k, used = used, used + 1
            rest[:, k], name[k] = full, opened
            opened += 1
        bins[i], offsets[i] = name[k], cap.tokens - rest[0, k]
        rest[:, k] -= need
        if rest[0, k] < least or rest[1, k] < 1 or rest[2, k] < least * least:  # closed: the last open bin takes its place
            used -= 1
            rest[:, k], name[k] = rest[:, used], name[used]
    return bins, offsets


def _pack(cap: Capacity):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["rid", "piece"], ignore_index=True)
        bins, offsets = best_fit(pieces["length"].to_numpy(), cap)
        fill = np.bincount(bins, weights=pieces["length"])
        return pieces.assign(sequence_id=pieces["grp"] * (1 << 32) + bins, offset=offsets, filled=fill[bins].astype(np.int64))

    return run


_SCHEMA = "doc_id {kind}, rid long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, filled long"


def _round(pieces: DataFrame, groups: int, first: int, cap: Capacity) -> DataFrame:
    kind = pieces.schema["doc_id"].dataType.simpleString()
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("rid", "piece", F.lit(first)), F.lit(groups)) + F.lit(first))
    return dealt.groupBy("grp").applyInPandas(_pack(cap), "grp long, " + _SCHEMA.format(kind=kind)).drop("grp")


def pack(docs: DataFrame, tokenizer: str, cap: Capacity = Capacity(), end: int = 0, group: int = GROUP) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = stored(
        docs.select("doc_id", "text").mapInArrow(
            _cut(tokenizer, cap.tokens, end),
            f"doc_id {kind}, rid long, piece int, start long, length long, ids_crc32 long, sequence_id long",
        )
    )
    out = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    whole = cut.where("sequence_id IS NOT NULL").withColumn("offset", F.lit(0).cast("long"))
    open_ = cut.where("sequence_id IS NULL").drop("sequence_id")
    groups = max(1, -(-open_.count() // group))
    done = stored(_round(open_, groups, 0, cap))
    late = F.col("filled") < int(FULL * cap.tokens)
    loose = done.where(late).drop("sequence_id", "offset", "filled")
    again = _round(loose, max(1, -(-loose.count() // group)), groups, cap)
    return whole.select(*out).unionByName(done.where(~late).select(*out)).unionByName(again.select(*out))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """The whole ``documents`` table at 2048 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLES: dict[str, str] = {}
