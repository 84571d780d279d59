"""How the sources of a language differ in their words: pair distances and each source's own terms.

Each language keeps the terms of at least ``least_docs`` of its documents. Every
(language, source) group, and the language, gives each kept term the smoothed
share ``1 + floor(10**9 * (count + 5) / (N + 5 * V))``.

Terms are dealt to blocks within their language. A block is a dense int64 matrix
of shares, group by term; broadcasting a group's row against the whole matrix
gives the block's part of the pair distances, and the part matrices are added up
by Spark. Each block also gives every group its fifty best terms, and these short
lists are merged. A block holds about ``CELLS`` numbers whatever the number of sources, so
a common term or a language with a third of all rows meets in no single task.

All arithmetic is exact: the division goes by three digits at a time, so counts to 9 * 10**15 do not overflow.

Defined results: a null text, lang or source is the empty string; a group without
terms gives each kept term the same share; a language without kept terms has pair
values of 0; ties go by the UTF-8 order of the item; repeated rows each count; an empty table gives no
rows; extra columns are ignored; a long text is handled whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subtide.llm import words as W
from subtide.llm.lineage import stored

LEAST_DOCS, BEST, SMOOTH = 30, 50, 5
#: Numbers of a block, and the fewest and most terms of one.
CELLS, FEWEST, MOST = 1 << 18, 256, 4096
#: Distinct terms that a counting task holds before it passes them on.
HELD = 300_000

#: Terms are runs of letters and of anything beyond ASCII; the rest becomes a space.
_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs), added up as far as a task holds them; each group has a row for no term."""
    n: dict[tuple, Counter[bytes]] = {}
    docs: dict[tuple, Counter[bytes]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in n.items():
            terms, seen = list(found), docs[lang, source]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(terms) + 1), pa.string()), pa.array([source] * (len(terms) + 1), pa.string()),
                    pa.array([*terms, b""], pa.binary()).cast(pa.string()),
                    pa.array([*found.values(), 0], pa.int64()), pa.array([*(seen[t] for t in terms), 0], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        n.clear()
        docs.clear()

    for batch in batches:
        names = list(zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True))
        for row, raw, offsets in W.slices(batch["text"]):
            data = raw.tobytes().translate(_TERM)
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                terms, group = data[a:b].split(), names[row + k]
                n.setdefault(group, Counter()).update(terms)
                docs.setdefault(group, Counter()).update(set(terms))
        if sum(map(len, n.values())) > HELD:
            yield from out()
    yield from out()


def shares(counts: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 5) / (N + 5 * V)) by long division, three digits at a time."""
    rest, below = counts + SMOOTH, np.maximum(totals + SMOOTH * kept, 1)
    out, rest = rest // below, rest % below
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // below, rest % below
    return out + 1


def pair_part(p: np.ndarray) -> np.ndarray:
    """Sums over a block's terms of the absolute differences of all pairs of rows (group by group)."""
    rows = max(1, (1 << 22) // max(1, p.size))
    return np.concatenate([np.abs(p[i : i + rows, None, :] - p[None, :, :]).sum(2) for i in range(0, len(p), rows)])


def _tile(table: pa.Table) -> pa.Table:
    """One block of a language, rows (lang, kept, term, source, n) -> its pair part and best terms.

    The rows of no term are the language's sources with their totals; ``kept`` is its number of terms.
    """
    lang, kept = table["lang"][0].as_py(), table["kept"][0].as_py()
    blank = pc.equal(table["term"], "")
    head, rows = table.filter(blank), table.filter(pc.invert(blank))
    sources, totals = head["source"].combine_chunks(), head["n"].to_numpy()
    names = pc.unique(rows["term"])
    names = names.take(pc.array_sort_indices(names))
    place = lambda c, values: pc.index_in(rows[c], value_set=values).to_numpy()
    counts = np.zeros((len(sources), len(names)), np.int64)
    counts[place("source", sources), place("term", names)] = rows["n"].to_numpy()
    p, q = shares(counts, totals[:, None], kept), shares(counts.sum(0), totals.sum(), kept)
    part = pair_part(p)
    i, j = np.nonzero(~np.eye(len(sources), dtype=bool))
    owner, item, value = [i], [sources.take(pa.array(j))], [part[i, j]]
    for g in range(len(sources)):
        more = np.flatnonzero((counts[g] > 0) & (p[g] > q))
        best = more[np.argsort(q[more] - p[g, more], kind="stable")[:BEST]]  # ties stay in the order of terms
        owner.append(np.full(len(best), g))
        item.append(names.take(pa.array(best)))
        value.append(p[g, best] - q[best])
    owner = np.concatenate(owner)
    return pa.table({
        "lang": pa.array([lang] * len(owner), pa.string()), "source": sources.take(pa.array(owner)),
        "part": pa.array(["pair"] * len(i) + ["term"] * (len(owner) - len(i)), pa.string()),
        "item": pa.concat_arrays(item), "value": pa.array(np.concatenate(value)),
    })


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (lang, source, text): all pairs of a language's sources, and the best terms of each."""
    blank = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = blank.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )
    within = F.sum("docs").over(Window.partitionBy("lang", "term"))
    kept = stored(counts.withColumn("docs", within).where((F.col("docs") >= least_docs) | (F.col("term") == "")).drop("docs"), "snappy")
    # The rows of no term have every group of a language, and each term is a term of its own.
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = kept.where("term <> ''").select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    sizes = totals.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(terms, "lang", "left").select(
        "lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), F.floor(F.lit(CELLS) / F.col("sources")))).alias("wide")
    ).select("lang", "kept", F.greatest(F.lit(1), F.ceil(F.col("kept") / F.col("wide"))).cast("int").alias("blocks"))
    dealt = kept.where("term <> ''").join(sizes, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    heads = totals.withColumn("term", F.lit("")).join(sizes, "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = heads.unionByName(dealt).groupBy("lang", "block").applyInArrow(_tile, "lang string, source string, part string, item string, value long")
    whole = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return whole.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= BEST))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table, all languages and sources."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n)::HUGEINT AS s FROM f GROUP BY ALL),
p AS (SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000 * (f.n + {SMOOTH})) // (s.s + {SMOOTH} * v.v) AS p
      FROM f JOIN s ON s.lang = f.lang AND s.source = f.source JOIN v ON v.lang = f.lang),
l AS (SELECT f.lang, f.term, 1 + (1000000000 * (sum(f.n)::HUGEINT + {SMOOTH})) // (any_value(m.m) + {SMOOTH} * any_value(v.v)) AS q
      FROM f JOIN (SELECT lang, sum(s)::HUGEINT AS m FROM s GROUP BY ALL) AS m ON m.lang = f.lang JOIN v ON v.lang = f.lang GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
      FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
      UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - l.q FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE p.n > 0 AND p.p > l.q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM u QUALIFY part = 'pair' OR rank <= {BEST}
"""

QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLES = {"op13_source_divergence": ORACLE_SQL}
