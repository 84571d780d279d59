"""The corpus pipeline: quality, near-duplicates, decontamination, secrets, packing.

Each stage takes all its predecessor kept and returns the columns of
``documents``; the last returns packed pieces. Rows are named by doc_id and the
hash of their text, so a repeated doc_id does no harm.

Defined results, for every stage: a null or empty text is rejected by the quality
stage, and by itself each later stage keeps one such row, uncontaminated, unmasked
and packed as the end token; a null doc_id is a row like any other; repeated rows are
judged alike, and the near-duplicate stage leaves one; an empty table gives none;
extra columns are left out; a long text is handled whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.llm import decontam, nearcopies, packing, quality, secrets
from subtide.llm.lineage import scope, shared_dir, stored
from subtide.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Row keys (some 30 bytes each) up to this number are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 200_000


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, hash of text) is not in ``keys`` (doc_id, text_hash)."""
    keys = stored(keys.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    side = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(side, same, "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that policy ``v1`` of the quality ledger accepts."""
    book = quality.apply_policy(quality.ledger(docs), "v1")
    return book.where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies (five-word shingles, Jaccard similarity of 0.8 or more).

    It is the row of the smallest doc_id (null last), and of its texts the smallest hash.
    """
    ship(spark)
    found = nearcopies.near_copies(docs)
    rows = stored(found.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies")))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "copies")).alias("b"))
    keep = best.select("b.doc_id", "b.text_hash", "b.copies")
    same = F.col("rows.doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("rows.text_hash") == F.col("keep.text_hash"))
    gone = rows.alias("rows").join(keep.alias("keep"), same, "left_anti")
    kept = without(docs, gone)
    repeated = stored(keep.where("copies > 1"))
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    once = without(kept, repeated)
    named = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    twice = kept.join(repeated.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), named, "left_semi")
    return once.select(*COLUMNS).unionByName(twice.dropDuplicates(["doc_id", "text"]).select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    ship(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontam.decontaminate(docs, items)
    return without(docs, found.where("contaminated")).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document and masks the secrets in its text; n_chars follows the new text."""
    found = secrets.scan(docs, secrets.train(secrets.default_samples(spark)))
    masked = secrets.redact(found)
    length = F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", length).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    import public_tokenizers

    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: Fingerprints, the trained model and the tokenizer have no SQL form; the tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again, and what it needed is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
