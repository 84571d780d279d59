"""Quality rules as a bitmask ledger (native DataFrame operations only).

Every rule is evaluated once per document. The ledger holds the measurements
and one failure bit per rule; policies are versioned masks over those bits, so
a policy change or an ablation never touches the texts again.

Defined results: a null or empty text has no words (all measurements 0, the
short-text bit set). Ties and repeated rows are judged row by row, so equal
texts get equal rows. Columns of the input that clash with the ledger's names, or
with those it works with (_w, _g, _s, _f, _lines), whatever their case, are left out.
An empty table gives an empty ledger; a long text is handled whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_lower", "n_bangs",
)


@dataclass(frozen=True)
class Rule:
    """A named rule; ``fails`` is SQL over the measurements, and its place is its bit."""

    name: str
    fails: str


#: The order fixes the bit of each rule: append, never reorder.
RULES = (
    Rule("short", "n_words < 50"),
    Rule("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 20 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("shouting", "n_words >= 50 AND 100 * n_upper > 70 * (n_upper + n_lower)"),
    Rule("exclamations", "n_words >= 50 AND 100 * n_bangs > 50 * n_words"),
    Rule("word_length", "n_words >= 50 AND (word_chars < 2 * n_words OR word_chars > 30 * n_words)"),
)

#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base": ("short", "repeated_trigrams"),
    "v1": tuple(r.name for r in RULES),
}


def mask_of(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    places = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << places[n] for n in names)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are told apart by a 64-bit hash. A document without equal hashes,
    the common case, stops there; else (hash, place) pairs are sorted and equal
    neighbours give the repeated windows.
    """
    n = F.size(words)
    grams = F.slice(
        F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))),
        F.lit(1), F.greatest(n - 2, F.lit(0)),
    )
    return grams


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements of ``MEASURES`` to each row of ``docs``."""
    t = F.coalesce(F.col(text), F.lit(""))
    clashing = {*MEASURES, "failed_bits", "kept", "_w", "_g", "_s", "_f", "_lines"}
    extra = [f"`{c}`" for c in docs.columns if c.lower() not in clashing]
    words = docs.select(
        *extra,
        F.array_remove(F.split(t, SPACE + "+"), "").alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        (F.char_length(t) - F.regexp_count(t, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit("[a-z]")).cast("long").alias("n_lower"),
        F.regexp_count(t, F.lit("!")).cast("long").alias("n_bangs"),
    )
    hashed = words.withColumn("_g", _repeat_words(F.col("_w")))
    g = F.col("_g")
    pairs = hashed.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct(g)) < F.size(g),
            F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    s = F.col("_s")
    found = pairs.withColumn(
        "_f",
        F.sort_array(
            F.transform(
                F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])),
                lambda x: x["i"],
            )
        ),
    )
    f = F.col("_f")
    covered = F.aggregate(
        F.transform(f, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(f, i + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    measured = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        "n_upper", "n_lower", "n_bangs",
    )
    # A generator of one row: filters on measurements stay above it. Pushed below, they
    # would repeat the array expressions once per reference.
    return found.select(*extra, F.inline(F.array(measured)))


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with measurements and ``failed_bits``: bit i is set where rule i fails."""
    bits = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text).withColumn("failed_bits", bits)


def apply_policy(book: DataFrame, policy: str | tuple[str, ...] = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``kept`` under a policy; reads the ledger's bits only."""
    return book.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy, rules))) == 0)


def ablations(book: DataFrame, policies: dict[str, tuple[str, ...]] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per policy and rule: rejected documents, those failing the rule, and those only it rejects.

    One pass over distinct bit patterns: the ledger is first counted by
    ``failed_bits`` (a partial aggregate of at most 2**rules keys).
    """
    policies = POLICIES if policies is None else policies
    counts = book.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    masks = F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(rules[i].name).alias("rule"), F.lit(1 << i).cast("long").alias("bit"), F.lit(mask_of(names, rules)).cast("long").alias("mask"))
        for p, names in policies.items() for i in range(len(rules)) if mask_of(names, rules) >> i & 1
    ])
    hit = F.col("failed_bits").bitwiseAND(F.col("m.mask"))
    return (
        counts.select("failed_bits", "n", F.explode(masks).alias("m"))
        .groupBy(F.col("m.policy").alias("policy"), F.col("m.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
            F.sum(F.when(hit.bitwiseAND(F.col("m.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failing"),
            F.sum(F.when(hit == F.col("m.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        )
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table through the ledger, judged by policy ``v1``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    book = apply_policy(ledger(docs), "v1")
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed_bits").bitwiseAND(F.lit(mask_of("base"))) != 0).alias("base_failed"),
        "kept", "failed_bits",
    )


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid,
                  {_WORDS} AS w FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
      FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT rid, i + unnest([0, 1, 2]) AS p FROM c WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(l.n_lines, 0)::BIGINT AS n_lines,
             length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
             length(regexp_replace(text, '[^a-z]', '', 'g'))::BIGINT AS n_lower,
             length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_bangs
      FROM d LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)),
b AS (SELECT *, {" + ".join(f"(CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END)" for i, r in enumerate(RULES))} AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       bits & {mask_of("base")} <> 0 AS base_failed, bits & {mask_of("v1")} = 0 AS kept,
       bits::BIGINT AS failed_bits
FROM b
"""

QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES = {"op10_quality_rules": ORACLE_SQL}
