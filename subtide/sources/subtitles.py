"""SRT and ASS documents as cue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.functions.text import ass_seconds, ass_to_text, srt_seconds

_TIMING = r"^\s*(\d+:\d{1,2}:\d{1,2}[,.]\d{1,3})\s*-->\s*(\d+:\d{1,2}:\d{1,2}[,.]\d{1,3})(?:[ \t]+(.*))?$"


def parse_srt(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, index, start_s, end_s, text, settings, malformed) of SRT documents.

    A byte-order mark and carriage returns are dropped; a missing index becomes
    the place in the document; a block without a timing line is malformed.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "^﻿", ""), "\r\n?", "\n")
    blocks = F.filter(F.split(clean, r"\n[ \t]*\n+"), lambda b: F.trim(b) != "")
    rows = docs.select(key, F.posexplode(blocks).alias("position", "_b"))
    lines = F.split(F.regexp_replace("_b", r"^\n+|\s+$", ""), "\n")
    r = rows.select(key, "position", lines.alias("_l"))
    numbered = F.get("_l", 0).rlike(r"^\s*\d+\s*$") & ~F.get("_l", 0).contains("-->")
    timing = F.when(numbered, F.get("_l", 1)).otherwise(F.get("_l", 0))
    body = F.slice("_l", F.when(numbered, 3).otherwise(2), F.greatest(F.size("_l"), F.lit(1)))
    t = lambda i: F.regexp_extract(timing, _TIMING, i)
    return r.select(
        key, "position", F.when(numbered, F.trim(F.get("_l", 0)).try_cast("int")).otherwise(F.col("position") + 1).alias("index"),
        srt_seconds(t(1)).alias("start_s"), srt_seconds(t(2)).alias("end_s"), F.array_join(body, "\n").alias("text"),
        F.nullif(F.trim(t(3)), F.lit("")).alias("settings"), (~F.coalesce(timing.rlike(_TIMING), F.lit(False))).alias("malformed"),
    )


def parse_ass(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, start_s, end_s, text, style) of ASS documents' dialogue lines.

    Columns follow the ``Format`` line of ``[Events]``; the last keeps its commas. Lines that do not fit are left out.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "^﻿", ""), "\r\n?", "\n")
    events = F.regexp_extract(clean, r"(?is)\[events\]\s*\n(.*?)(?=\n\[|\z)", 1)
    names = F.transform(F.split(F.regexp_extract(events, r"(?im)^format:\s*(.*)$", 1), ","), lambda x: F.lower(F.trim(x)))
    lines = F.filter(F.split(events, "\n"), lambda x: x.rlike(r"(?i)^dialogue:"))
    rows = docs.select(key, names.alias("_n"), F.posexplode(lines).alias("position", "_x"))
    fields = F.split(F.regexp_replace("_x", r"(?i)^dialogue:\s*", ""), ",")
    n = F.size("_n")
    head = F.slice(fields, F.lit(1), n - 1)
    last = F.array_join(F.slice(fields, n, F.greatest(F.size(fields) - n + 1, F.lit(0))), ",")
    whole = F.when(F.size(fields) >= n, F.map_from_arrays("_n", F.array_append(head, last)))
    r = rows.select(key, "position", whole.alias("_m"))
    get = lambda k: F.try_element_at("_m", F.lit(k))
    out = r.select(key, "position", ass_seconds(get("start")).alias("start_s"), ass_seconds(get("end")).alias("end_s"), ass_to_text(get("text")).alias("text"), F.trim(get("style")).alias("style"))
    return out.where("start_s IS NOT NULL AND end_s IS NOT NULL")


def parse_by_extension(docs: DataFrame, key: str, path: Column, text: str) -> tuple[DataFrame, DataFrame]:
    """(cues, rejected documents): SRT or ASS by extension; others are rejected."""
    from subtide.functions.filenames import extension

    marked = docs.withColumn("_e", extension(path))
    srt = parse_srt(marked.where("_e = 'srt'"), key, text).select(key, "position", "start_s", "end_s", "text")
    ass = parse_ass(marked.where("_e IN ('ass', 'ssa')"), key, text).select(key, "position", "start_s", "end_s", "text")
    bad = marked.where("_e NOT IN ('srt', 'ass', 'ssa')").select(key, F.concat(F.lit("unsupported extension: "), "_e").alias("error"))
    return srt.unionByName(ass), bad
