"""Script metrics and language buckets of subtitle-like texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KANA = r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}]"
HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
VISIBLE = r"[\p{L}\p{N}]"
LATIN, CYRILLIC, HANGUL = r"\p{IsLatin}", r"\p{IsCyrillic}", r"\p{IsHangul}"


@dataclass(frozen=True)
class Thresholds:
    """Defaults of the bucket rules."""

    minimum_lines: int = 2
    minimum_characters: int = 20
    long_line: int = 8
    japanese: float = 0.70
    kana: float = 0.08
    foreign_most: float = 0.15
    foreign_strong: float = 0.50
    bilingual_japanese: float = 0.10
    bilingual_foreign: float = 0.10
    model_japanese: float = 0.60
    model_bilingual: float = 0.15


def metrics(df: DataFrame, text: str, t: Thresholds = Thresholds()) -> DataFrame:
    """``df`` with script counts and ratios of the visible characters; ratios are 0 where there are none."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(VISIBLE))
    base = df.withColumn("_l", lines).withColumn("_t", F.array_join("_l", "\n"))
    n = lambda p: F.regexp_count("_t", F.lit(p))
    long = F.filter("_l", lambda x: F.regexp_count(x, F.lit(VISIBLE)) >= t.long_line)
    c = base.select(
        *df.columns, F.size("_l").alias("substantive_lines"), n(VISIBLE).alias("visible"), F.size(long).alias("long_lines"),
        F.size(F.filter(long, lambda x: ~x.rlike(KANA))).alias("long_lines_without_kana"),
        n(KANA).alias("kana"), n(HAN).alias("han"), n(LATIN).alias("latin"), n(CYRILLIC).alias("cyrillic"), n(HANGUL).alias("hangul"),
    )
    r = lambda x: F.coalesce(F.try_divide(x, F.col("visible")), F.lit(0.0))
    return c.select(
        "*", r(F.col("kana")).alias("kana_ratio"), r(F.col("kana") + F.col("han")).alias("japanese_ratio"), r(F.col("latin")).alias("latin_ratio"),
        r(F.col("latin") + F.col("cyrillic") + F.col("hangul")).alias("foreign_ratio"),
        F.coalesce(F.try_divide("long_lines_without_kana", "long_lines"), F.lit(0.0)).alias("long_no_kana_ratio"),
    )


def bucket(t: Thresholds = Thresholds()) -> Column:
    """The bucket that scripts alone decide, null where a line model must be asked."""
    c = F.col
    return (
        F.when((c("substantive_lines") < t.minimum_lines) | (c("visible") < t.minimum_characters), "insufficient_text")
        .when((c("japanese_ratio") >= t.japanese) & (c("kana_ratio") >= t.kana) & (c("foreign_ratio") <= t.foreign_most), "japanese")
        .when((c("foreign_ratio") >= t.foreign_strong) & (c("japanese_ratio") < t.bilingual_japanese), "non_japanese")
    )


def bucket_by_model(sampled: Column, japanese: Column, t: Thresholds = Thresholds()) -> Column:
    """The bucket of an ambiguous text from a model's sampled lines and their Japanese share."""
    both = (japanese >= t.model_bilingual) & (F.col("japanese_ratio") >= t.bilingual_japanese) & (F.col("foreign_ratio") >= t.bilingual_foreign)
    return F.when(sampled == 0, "unknown").when(japanese >= t.model_japanese, "japanese").when(both, "bilingual").otherwise("non_japanese")
