"""Language-model scores by a log-bilinear neural model trained with noise contrast.

Outputs of the network are the ``TOP`` most frequent words (the end of a text is
one) and ``CLASSES`` classes of all other words, by their last two bytes. A word
of a class has its share of the class's training count; Good-Turing's share of
words seen once is kept for words never seen. So the probabilities of all words,
with one unknown word per class, sum to one after every context.

The score of word w after the words u, v is ``E2[u].R[w] + E1[v].R[w] + b[w] - log Z[u, v]``.
The normaliser falls into two factors, sum_w exp(E1[v].R[w]) exp(E2[u].R[w] + b[w]),
so one product of two matrices gives it for all pairs of context words, and each
batch of tokens is scored by gathered products.

Texts are read twice, once for the counts of all words and once to write each text's outputs
(two bytes a token) to a stored table. Training needs no normaliser: each task
reads its documents' outputs once, in two rounds (an eighth of them, then the rest), telling words
from noise drawn by unigram frequency, and the models of a round's tasks are averaged by their tokens, in a
tree of Spark groups. Every training document takes part, as in the word counts.
Only the model (``DIM`` numbers per output), the ``FREQUENT`` commonest words of
at most ``LONGEST`` bytes and class totals travel with tasks, all of fixed size;
rarer words meet their counts in a shuffled join.

Defined results: a null or empty text has the end token alone; a null doc_id is
written as an empty text, so its row is learnt from; repeated rows each count and
each give a row; an empty table gives no rows; a corpus without training rows
has N = V = 0; extra columns are ignored; a long text is handled whole.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.llm import words as W
from subtide.llm.lineage import stored

TOP, CLASSES, DIM = 1536, 512, 32
#: The most words whose counts travel with tasks, and their greatest length in bytes.
FREQUENT, LONGEST = 1 << 17, 48
#: Tokens of a step, noise words of a step, step size, and tokens shuffled together.
STEP, NOISE, RATE, BLOCK = 1024, 64, 0.08, 1 << 16
#: Models averaged in one task.
FAN = 48
END = b""
OUTPUTS = TOP + CLASSES
START = OUTPUTS  # the context before a text

_LOWER = bytes(W.LOWER)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[list[bytes]]]]:
    """(batch, first row, the words of consecutive rows)."""
    for batch in batches:
        for row, raw, offsets in W.slices(batch["text"]):
            low = raw.tobytes().translate(_LOWER)
            yield batch, row, [low[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return made

    for _, _, texts in _texts(batches):
        for found in texts:
            held.update(found)
            held[END] += 1
        if len(held) > 300_000:
            yield out()
    yield out()


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


@dataclass(frozen=True)
class Vocabulary:
    """Counts that travel: ``words`` sorted by count, then bytes; the first ``TOP`` with the end are outputs of their own."""

    words: tuple[bytes, ...]
    counts: np.ndarray
    total: int
    distinct: int
    class_counts: np.ndarray
    class_unknown: np.ndarray  # the share of words never seen within each class
    least: int  # the least count of a word that travels for its count

    def top(self) -> list[bytes]:
        return [END, *[w for w in self.words if w != END][: TOP - 1]]

    def unigram(self) -> np.ndarray:
        """Probability of each output, smoothed."""
        own = dict(zip(self.words, self.counts.tolist(), strict=True))
        n = np.concatenate([[own.get(w, 0) for w in self.top()], np.zeros(TOP - len(self.top())), self.class_counts]) + 0.5
        return n / n.sum()


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the stored counts of all words. At most ``FREQUENT`` words and one row a class come to the driver."""
    whole = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    fits = counts.where(F.length("word") <= LONGEST)
    steps = fits.groupBy(F.floor(F.log2("n") * 8).alias("h")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).collect()
    least, kept = 1 << 62, 0
    for r in sorted(steps, key=lambda r: -r["h"]):
        if kept + r["k"] > FREQUENT:
            break
        least, kept = r["least"], kept + r["k"]
    rows = sorted(((-r["n"], bytes(r["word"])) for r in fits.where((F.col("n") >= least) | (F.col("word") == F.lit(END))).collect()))
    words, n = tuple(w for _, w in rows), np.array([-c for c, _ in rows], np.int64)
    by = counts.groupBy(_class("word").alias("c")).agg(
        F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")
    )
    class_n, once = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by.collect():
        class_n[r["c"]], once[r["c"]] = r["n"], r["once"]
    made = Vocabulary(words, n, whole["n"] or 0, whole["v"], class_n, once, least)
    top = set(made.top())
    for w, c in zip(words, n.tolist(), strict=True):
        if w in top:
            class_n[word_class(w)] -= c
            once[word_class(w)] -= c == 1
    unknown = np.where(class_n > 0, (once + 0.5) / (class_n + once + 1), 1.0)
    return Vocabulary(words, n, made.total, made.distinct, class_n, unknown, least)


def _encoder(vocab: Vocabulary) -> Callable:
    """Documents -> (rid, doc_id, held_out, part, n_tokens, n_known, base_score, within, ids, rest[]).

    ``ids`` are the outputs of the tokens, ``within`` the shares of words in their classes; words of ``rest`` count as unknown here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, places, none = vocab.top(), {w: i for i, w in enumerate(vocab.words)}, len(vocab.words)
        base = np.log10((np.append(vocab.counts, 0) + 0.5) / (vocab.total + 0.5 * (vocab.distinct + 1)))
        own = {w: i for i, w in enumerate(top)}
        outputs, within = np.zeros(none + 1, np.uint16), np.zeros(none + 1)
        for w, i in places.items():
            if w in own:
                outputs[i] = own[w]
            else:
                c = word_class(w)
                outputs[i], within[i] = TOP + c, math.log10((1 - vocab.class_unknown[c]) * vocab.counts[i] / vocab.class_counts[c])
        unknown = np.log10(vocab.class_unknown)
        rid, crc = TaskContext.get().partitionId() << 40, zlib.crc32
        for batch, row, texts in _texts(batches):
            n = len(texts)
            before = np.zeros(n + 1, np.int64)
            np.cumsum([len(t) + 1 for t in texts], out=before[1:])
            flat = [w for t in texts for w in (*t, END)]
            at = np.fromiter(map(places.get, flat, repeat(none)), np.int64, len(flat))
            ids, more = outputs[at], within[at]
            missed = np.flatnonzero(at == none)
            words = [flat[k] for k in missed.tolist()]
            classes = np.array([crc(w[-2:]) % CLASSES for w in words], np.int64)
            real = np.array([w != END for w in words], bool)  # without training rows the end itself has no count
            ids[missed] = np.where(real, TOP + classes, 0)
            more[missed] = np.where(real, unknown[classes], 0)
            bounds, rare, times = [0], [], []
            cuts = np.searchsorted(missed, before)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                found = Counter(words[a:b])
                rare.extend(found)
                times.extend(found.values())
                bounds.append(len(rare))
            lists = pa.ListArray.from_arrays(
                pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], names=["word", "n"])
            )
            sums = lambda x: np.add.reduceat(x, before[:-1])
            data = ids.tobytes()
            coded = pa.array([data[2 * a : 2 * b] for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(rid, rid + n)), *[batch[c].slice(row, n) for c in ("doc_id", "held_out", "part")], pa.array(np.diff(before)),
                    pa.array(sums((at != none).astype(np.int64))), pa.array(sums(base[at])), pa.array(sums(more)), coded, lists,
                ],
                names=["rid", "doc_id", "held_out", "part", "n_tokens", "n_known", "base_score", "within", "ids", "rest"],
            )
            rid += n

    return run


def _coded(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, outputs, tokens before each row) of consecutive rows of a column of outputs."""
    for row, raw, offsets in W.slices(column):
        yield row, np.frombuffer(raw.tobytes(), np.uint16), offsets // 2


def _contexts(ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs two places and one place before each token."""
    u, v = np.full(len(ids), START, np.uint16), np.full(len(ids), START, np.uint16)
    v[1:], u[2:] = ids[:-1], ids[:-2]
    first = before[:-1]
    v[first] = u[first] = START
    second = first + 1
    u[second[second < before[1:]]] = START
    return u, v


class Model:
    """Parameters and, per row, the squared gradients so far (row-wise Adagrad)."""

    SHAPES = (("E1", (OUTPUTS + 1, DIM)), ("E2", (OUTPUTS + 1, DIM)), ("R", (OUTPUTS, DIM)), ("b", (OUTPUTS, 1)))

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES:
            setattr(self, name, flat[at : at + shape[0] * shape[1]].reshape(shape))
            at += shape[0] * shape[1]
        for name, shape in self.SHAPES:
            setattr(self, "sq_" + name, flat[at : at + shape[0]])
            at += shape[0]

    @classmethod
    def initial(cls, unigram: np.ndarray) -> Model:
        """The unigram model: context products start near zero."""
        r = np.random.default_rng(11)
        size = sum(a * b + a for _, (a, b) in cls.SHAPES)
        made = cls(np.zeros(size, np.float32))
        made.E1[:], made.E2[:] = r.normal(0, 0.05, made.E1.shape), r.normal(0, 0.05, made.E2.shape)
        made.R[:] = r.normal(0, 0.05, made.R.shape)
        made.b[:, 0] = np.log(unigram)
        made.flat[-sum(a for _, (a, _) in cls.SHAPES) :] = 1e-3
        return made

    def _add(self, name: str, rows: np.ndarray, grads: np.ndarray) -> None:
        order = np.argsort(rows.astype(np.int16), kind="stable")
        rows = rows[order]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        sums, rows = np.add.reduceat(grads[order], starts, axis=0), rows[starts]
        sq = getattr(self, "sq_" + name)
        sq[rows] += np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
        getattr(self, name)[rows] += RATE * sums / np.sqrt(sq[rows])[:, None]

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> None:
        """One ascent step of the noise-contrastive likelihood; the noise words are shared by the step's tokens."""
        h = self.E1[v] + self.E2[u]
        rw, rn = self.R[w], self.R[noise]
        true = np.einsum("ij,ij->i", h, rw) + self.b[w, 0] - log_noise[w]
        false = h @ rn.T + (self.b[noise, 0] - log_noise[noise])
        g_true = 1 / (1 + np.exp(np.minimum(true, 60)))
        np.negative(false, out=false)
        g_false = np.exp(np.minimum(false, 60, out=false), out=false)
        g_false += 1
        np.divide(-1, g_false, out=g_false)
        gh = g_true[:, None] * rw + g_false @ rn
        both = np.concatenate([w, noise])
        self._add("R", both, np.concatenate([g_true[:, None] * h, g_false.T @ h]))
        self._add("b", both, np.concatenate([g_true, g_false.sum(0)])[:, None])
        self._add("E1", v, gh)
        self._add("E2", u, gh)


def _trainer(flat: bytes, unigram: np.ndarray, turn: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(np.frombuffer(flat, np.float32).copy())
        seen = 0
        r = np.random.default_rng((turn, TaskContext.get().partitionId()))
        grid, log_noise = np.cumsum(unigram), np.log(NOISE * unigram).astype(np.float32)
        held: list[tuple[np.ndarray, ...]] = []

        def learn() -> int:
            u, v, w = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for a in range(0, len(w), BLOCK):
                order = a + r.permutation(min(BLOCK, len(w) - a))
                for k in range(0, len(order), STEP):
                    at = order[k : k + STEP]
                    noise = np.minimum(np.searchsorted(grid, r.random(NOISE)), OUTPUTS - 1).astype(np.uint16)
                    model.step(u[at], v[at], w[at], noise, log_noise)
            return len(w)

        for batch in batches:
            for _, ids, before in _coded(batch["ids"]):
                held.append((*_contexts(ids, before), ids))
                if sum(len(x[0]) for x in held) >= BLOCK:
                    seen += learn()
        if held:
            seen += learn()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([model.flat.tobytes()], pa.binary())], names=["tokens", "model"])

    return run


def _mean(parts: Iterator[tuple[int, bytes]]) -> tuple[int, bytes]:
    total, tokens = None, 0
    for n, flat in parts:
        x = np.frombuffer(flat, np.float32).astype(np.float64) * n
        total = x if total is None else total + x
        tokens += n
    return tokens, (total / tokens).astype(np.float32).tobytes()


def _averaged(table: pa.Table) -> pa.Table:
    tokens, flat = _mean(zip(table["tokens"].to_pylist(), (m.as_py() for m in table["model"]), strict=True))
    return pa.table({"tokens": pa.array([tokens], pa.int64()), "model": pa.array([flat], pa.binary())})


def average(models: DataFrame) -> bytes | None:
    """The mean model by tokens of a stored table of them, in groups of about ``FAN``; one comes to the driver."""
    n = models.count()
    while n > 1:
        groups = math.ceil(n / FAN)
        dealt = models.withColumn("g", F.pmod(F.xxhash64("tokens", "model"), F.lit(groups)))
        models = stored(dealt.groupBy("g").applyInArrow(lambda t: _averaged(t.drop_columns(["g"])), "tokens long, model binary"))
        n = models.count()
    row = models.first()
    return bytes(row["model"]) if row else None


def train(coded: DataFrame, unigram: np.ndarray) -> bytes:
    """A model learnt from all rows of ``coded`` (ids, part): an eighth of them, then the others from there."""
    flat = Model.initial(unigram).flat.tobytes()
    for turn, rows in enumerate((F.col("part") == 0, F.col("part") != 0)):
        made = coded.where(rows).select("ids").mapInArrow(_trainer(flat, unigram, turn), "tokens long, model binary")
        flat = average(stored(made)) or flat
    return flat


@lru_cache(maxsize=1)
def _tables(flat: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products of all near contexts [v, w] and far ones [u, w] with all outputs, and log Z of every pair [u, v] by one matrix product."""
    m = Model(np.frombuffer(flat, np.float32))
    near, far = m.E1 @ m.R.T, m.E2 @ m.R.T + m.b[:, 0]
    a, b = near.max(1, keepdims=True), far.max(1, keepdims=True)
    z = np.exp((far - b).astype(np.float64)) @ np.exp((near - a).astype(np.float64)).T
    return near, far, (np.log(np.maximum(z, 1e-300)) + b + a.T).astype(np.float32)


def log_probabilities(flat: bytes, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Natural log-probability of each output ``w`` after ``u``, ``v``; over all outputs they sum to one."""
    near, far, z = _tables(flat)
    return near[v, w].astype(np.float64) + far[u, w] - z[u, v]


def _scorer(flat: bytes) -> Callable:
    """Coded documents -> (rid, score by the network and the classes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch["within"].to_numpy(zero_copy_only=False).copy()
            for row, ids, before in _coded(batch["ids"]):
                u, v = _contexts(ids, before)
                whole[row : row + len(before) - 1] += np.add.reduceat(log_probabilities(flat, u, v, ids), before[:-1]) / math.log(10)
            kept = [c for c in batch.schema.names if c not in ("ids", "within")]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(whole)], names=[*kept, "score"])

    return run


def _class(word: str) -> Column:
    return (F.crc32(F.expr(f"substring({word}, -2, 2)")) % CLASSES).cast("int")


def lm_scores(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = docs.select("doc_id", "text", (F.crc32(name) % 5 == 1).alias("held_out"), F.pmod(F.xxhash64(name), F.lit(8)).alias("part"))
    counts = stored(docs.where(~F.col("held_out")).select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    vocab = vocabulary(counts)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Stored, so that a row's number stays its own.
    head = f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double"
    coded = stored(docs.mapInArrow(
        _encoder(vocab), f"rid long, doc_id {kind}, held_out boolean, part long, n_tokens long, n_known long, base_score double, within double, "
        "ids binary, rest array<struct<word:binary,n:long>>"
    ))
    flat = train(coded.where(~F.col("held_out")).select("ids", "part"), vocab.unigram())
    scored = coded.select(*[x.split()[0] for x in head.split(", ")], "within", "ids").mapInArrow(_scorer(flat), f"{head}, score double")
    scarce = counts.where((F.col("word") != F.lit(END)) & ((F.col("n") < vocab.least) | (F.length("word") > LONGEST)))
    per = F.array(*[F.lit(float(math.log10((1 - g) / (n * g)))) if n > 0 else F.lit(0.0) for n, g in zip(vocab.class_counts, vocab.class_unknown, strict=True)])
    scarce = scarce.select("word", F.log10(F.col("n") * 2 + 1).alias("more_base"), (F.log10("n") + F.element_at(per, _class("word") + 1)).alias("more_score"))
    rare = coded.select("rid", F.explode("rest").alias("r")).select("rid", "r.word", "r.n").join(scarce, "word")
    corrected = rare.groupBy("rid").agg(
        F.sum("n").alias("more_known"), F.sum(F.col("n") * F.col("more_base")).alias("more_base"), F.sum(F.col("n") * F.col("more_score")).alias("more_score")
    )
    none = F.lit(0.0)
    return scored.join(corrected, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", none)).alias("base_score"), (F.col("score") + F.coalesce("more_score", none)).alias("score"),
    )


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table, learning from all rows that are not held out."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op11_lm_scoring": op11_lm_scoring}
ORACLES: dict[str, str] = {}
