"""Relevance and fuzzy search over titles and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75
#: Bytes of query terms that travel to every task; beyond it they are joined with the counted tokens.
MOST_BYTES = 8 << 20


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    """Lower-cased tokens of a text; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def weighted_text(parts: Sequence[tuple[Column, int]]) -> Column:
    """One search text in which each part is repeated by its weight; null parts count as empty."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c, n in parts for _ in range(n)])


def synonyms_text(listed: Column) -> Column:
    """The elements of a JSON list joined by spaces; anything else gives an empty text."""
    return F.concat_ws(" ", F.from_json(listed, "array<string>"))


def format_set(movies: bool = False, ova: bool = False, every: bool = False) -> list[str] | None:
    """The formats that three flags ask for; None means no filter."""
    if every:
        return None
    return ["TV", *(["OVA", "ONA", "TV_SHORT"] if ova else []), *(["MOVIE"] if movies else [])]


def _count_of(tokens: Column, term: str) -> Column:
    return F.size(tokens) - F.size(F.array_remove(tokens, term))


def bm25(docs: DataFrame, key: str, text: Column, terms: Sequence[str], k: float = K1, b: float = B) -> DataFrame:
    """``docs`` with ``score``, for documents that hold any of the distinct ``terms``.

    The terms are counted inside each row, so no token leaves its task; the
    statistics over all documents are one row, joined by broadcast.
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))
    # A generator of one row: the filter below stays above it and does not tokenise again for each term.
    counted = docs.withColumn("_t", tokens(text)).select(
        *docs.columns,
        F.inline(F.array(F.struct(
            F.size("_t").cast("double").alias("_len"),
            *[_count_of(F.col("_t"), t).cast("double").alias(f"_tf{i}") for i, t in enumerate(terms)],
        ))),
    )
    stats = counted.agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_len").alias("_avg"),
        *[F.count_if(F.col(f"_tf{i}") > 0).cast("double").alias(f"_df{i}") for i in range(len(terms))],
    )
    norm = F.lit(k) * (F.lit(1 - b) + F.lit(b) * F.col("_len") / F.col("_avg"))
    score = sum(
        F.ln((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5) + 1) * F.col(f"_tf{i}") * (k + 1) / (F.col(f"_tf{i}") + norm)
        for i in range(len(terms))
    )
    some = F.greatest(*[F.col(f"_tf{i}") for i in range(len(terms))], F.lit(0.0)) > 0
    return counted.where(some).join(F.broadcast(stats)).select(*docs.columns, score.alias("score"))


def _distinct_terms(wanted: DataFrame) -> DataFrame:
    return wanted.select(F.lower("term").alias("term")).where(F.col("term").isNotNull()).distinct()


def postings(docs: DataFrame, key: str, text: Column, wanted: DataFrame | None = None) -> DataFrame:
    """(term, key, tf, length): an inverted index, for many queries at once.

    With ``wanted`` (a table with ``term``) only those terms' postings: up to
    ``MOST_BYTES`` of them, measured first, meet the tokens before any are counted,
    so nothing else is shuffled; more are joined after the count.
    """
    rows = docs.select(key, tokens(text).alias("t")).select(key, F.size("t").alias("length"), F.explode("t").alias("term"))
    counted = lambda r: r.groupBy("term", key, "length").agg(F.count(F.lit(1)).alias("tf"))
    if wanted is None:
        return counted(rows)
    need = _distinct_terms(wanted)
    weight = need.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    if weight <= MOST_BYTES:
        return counted(rows.join(F.broadcast(need), "term", "left_semi"))
    return counted(rows).join(need, "term", "left_semi")


def bm25_bulk(index: DataFrame, docs: DataFrame, key: str, text: Column, wanted: DataFrame, k: float = K1, b: float = B) -> DataFrame:
    """(query_id, key, score) for a table of queries (query_id, term) over an inverted index, whole or of the wanted terms.

    Lengths are counted without cutting the tokens out. The document counts read
    ``tf`` so that they see the same columns of the index as the scores, and one
    shuffle of it serves both.
    """
    n = F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN))
    size = docs.select(n.alias("n")).agg(F.count(F.lit(1)).alias("_n"), F.avg("n").alias("_avg"))
    need = wanted.select("query_id", F.lower("term").alias("term")).distinct()
    hit = index.join(_distinct_terms(wanted), "term", "left_semi")
    df = hit.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("_df"))
    scored = hit.join(df, "term").join(F.broadcast(size)).join(need, "term")
    part = F.ln((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1) * F.col("tf") * (k + 1) / (
        F.col("tf") + k * (1 - b + b * F.col("length") / F.col("_avg"))
    )
    return scored.groupBy("query_id", key).agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int, score: str = "score", tie: str = "id") -> DataFrame:
    """The ``k`` best rows, ties by ``tie`` (H01); a top-k plan, not a full sort."""
    return scored.orderBy(F.desc(score), F.asc(tie)).limit(k)


#: Characters that end a streak at once; others only shorten it.
SEPARATORS = r"[\s._\-/\[\]()]"


def haystack(*parts: Column) -> Column:
    """Lower-cased text of the non-null parts, joined by spaces."""
    return F.lower(F.concat_ws(" ", *parts))


def fuzzy_score(hay: Column, needle: str) -> Column:
    """Ordered-subsequence score of a lower-cased haystack.

    The n-th matched character of a streak counts 10 + n; a separator ends the
    streak and any other character shortens it by one. The needle as a whole
    substring adds 100; every 20 characters beyond its length cost 1. Where the
    needle is no subsequence the score is -10000 plus the characters matched.
    """
    n = needle.strip().lower()
    if not n:
        return F.lit(0).cast("long")
    h = F.coalesce(hay, F.lit(""))
    state = lambda m, streak, s: F.struct(m.alias("m"), streak.alias("streak"), s.alias("s"))
    end = F.aggregate(
        F.split(h, ""),
        state(F.lit(0), F.lit(0), F.lit(0).cast("long")),
        lambda a, c: F.when(a["m"] >= len(n), a)
        .when(c == F.substring(F.lit(n), a["m"] + 1, F.lit(1)), state(a["m"] + 1, a["streak"] + 1, a["s"] + 11 + a["streak"]))
        .when(c.rlike(SEPARATORS), state(a["m"], F.lit(0), a["s"]))
        .otherwise(state(a["m"], F.greatest(F.lit(0), a["streak"] - 1), a["s"])),
    )
    length = F.greatest(F.lit(0), F.char_length(h) - len(n))
    full = end["s"] + F.when(h.contains(n), 100).otherwise(0) - F.floor(length / 20)
    return F.when(end["m"] < len(n), F.lit(-10000) + end["m"]).otherwise(full).cast("long")


def rank_fuzzy(df: DataFrame, haystack: str, needle: str, limit: int | None = None) -> DataFrame:
    """``df`` with ``score``, best first, ties by haystack; non-matches stay at the end."""
    scored = df.withColumn("score", fuzzy_score(F.col(haystack), needle))
    if not needle:
        return scored if limit is None else scored.limit(limit)
    ranked = scored.orderBy(F.desc("score"), F.asc(haystack))
    return ranked if limit is None else ranked.limit(limit)
