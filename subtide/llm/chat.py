"""Chat formatting with cumulative-snapshot collapse (native DataFrame operations only).

Logs often hold a conversation once per turn, each row set a longer snapshot of
the same dialogue. A rolling hash per turn prefix names every prefix; a
conversation whose whole-dialogue hash is a proper prefix of another one is
dropped by an anti-join, equal conversations collapse onto the smallest id, and
the maximal ones are rendered.

Defined results: turns sort by turn (nulls first), then role and text; wholly
repeated rows of a conversation count once; a null role renders as ``unknown``
and a null text as empty, but nulls keep hashes of their own; a null conv_id is
one conversation with a null id. Only a conversation's own turns are gathered in
one row, and a long conversation is handled whole. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.llm.folds import collected

CHATML = {"turn": ("<|im_start|>", "\n", "<|im_end|>\n"), "control": r"<\|(im_start|im_end)\|>"}
PLAIN = {"turn": ("", ": ", "\n"), "control": None}


def dialogues(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array in order, one rolling prefix hash per turn)."""
    per = turns.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    # Nulls sort last in array_sort of structs' fields only where the whole struct is null; the fields compare nulls first.
    mark = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.char_length(c).cast("string"), F.lit(":"), c))
    digest = lambda last, t: F.sha2(F.concat(last, mark(t["role"]), mark(t["text"])), 256)
    rolling = collected(F.col("turns"), F.lit(""), digest, digest, "string")
    return per.withColumn("prefixes", rolling)


def maximal(convs: DataFrame) -> DataFrame:
    """(conv_id, n_copies): the smallest id of each distinct conversation that prefixes no longer one.

    Proper prefixes are made distinct before the anti-join and whole
    conversations are counted by hash, so both sides have unique keys and a
    first turn or a conversation that fills the log does not skew it.
    """
    whole = convs.select("conv_id", F.element_at("prefixes", -1).alias("hash"))
    proper = convs.select(F.explode(F.slice(F.col("prefixes"), F.lit(1), F.size("prefixes") - 1)).alias("hash")).distinct()
    distinct = whole.groupBy("hash").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    return distinct.join(proper, "hash", "left_anti").select("conv_id", "n_copies")


def render(turns: Column, style: dict = CHATML) -> Column:
    """One string; control tokens inside a text are broken up so that they stay text."""
    before, between, after = style["turn"]
    safe = (lambda c: F.regexp_replace(c, style["control"], "<| $1 |>")) if style["control"] else (lambda c: c)
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(before), safe(F.coalesce(t["role"], F.lit("unknown"))), F.lit(between), safe(F.coalesce(t["text"], F.lit(""))), F.lit(after))),
        "",
    )


def format_chats(turns: DataFrame, style: dict = CHATML) -> DataFrame:
    """(conv_id, n_turns, n_copies, text) of the maximal conversations."""
    convs = dialogues(turns)
    keep = maximal(convs).withColumnRenamed("conv_id", "_keep")
    return convs.join(keep, F.col("conv_id").eqNullSafe(F.col("_keep"))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", render(F.col("turns"), style).alias("text")
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renders the whole ``conversations`` table."""
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


ORACLE_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id,
             list(coalesce('+' || role, '-') || chr(1) || coalesce('+' || text, '-') ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS parts,
             string_agg('<|im_start|>' || regexp_replace(coalesce(role, 'unknown'), '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') || chr(10)
                        || regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') || '<|im_end|>' || chr(10), ''
                        ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
      FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT parts[1:k] AS parts FROM (SELECT parts, unnest(range(1, len(parts))) AS k FROM c)),
d AS (SELECT parts, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY parts)
SELECT d.conv_id, len(d.parts)::BIGINT AS n_turns, d.n_copies, c.text
FROM d JOIN c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.parts = d.parts)
"""

QUERIES = {"op8_chat_formatting": op8_chat_formatting}
ORACLES = {"op8_chat_formatting": ORACLE_SQL}
