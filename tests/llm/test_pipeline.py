"""The corpus pipeline against brute force on its own stages' definitions."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from subtide.llm import pipeline
from subtide.llm.lineage import stored


def test_stages_keep_clean_documents_and_act(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for name, stage in pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], sf_dir)))
        if name != "best_fit_packing":
            assert tables[-1].columns == list(pipeline.COLUMNS)
    ids = [{r["doc_id"] for r in t.select("doc_id").collect()} for t in tables]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and len(ids[1]) < len(ids[0]) and ids[4] == ids[3] == ids[5]
    from subtide.llm import decontam, quality, secrets
    from tests.llm.test_nearcopies import brute_components

    kept = quality.apply_policy(quality.ledger(docs)).where("kept")
    assert ids[1] == {r["doc_id"] for r in kept.collect()}
    rows = sorted(tables[1].select("doc_id", "text").collect())
    assert ids[2] == {rows[k]["doc_id"] for k in brute_components([r["text"] for r in rows])}
    found = decontam.decontaminate(tables[2], spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert ids[3] == {r["doc_id"] for r in found.where("NOT contaminated").collect()}
    again = secrets.scan(tables[4], secrets.train(secrets.default_samples(spark)))
    assert again.where(F.size("spans") > 0).count() == 0


def test_repeated_and_unnamed_rows(spark, docs, no_docs):
    kept = pipeline.near_duplicate_stage(spark, docs, "")
    named = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert len(named) == len(set(named)) and 1 in named and 2 not in named
    assert pipeline.near_duplicate_stage(spark, no_docs, "").count() == 0
    assert pipeline.quality_stage(spark, no_docs, "").count() == 0
    assert pipeline.secret_stage(spark, no_docs, "").count() == 0


def test_decontamination_stage_on_odd_rows(spark, docs, no_docs, corpus, tmp_path):
    """Nulls in both tables, repeated rows and ids, blanks, a long text, an empty table, a column that clashes."""
    from tests.llm.test_operators import ALNUM_WORDS, lower

    passage = " ".join(ALNUM_WORDS.findall(lower(corpus[4][1]))[5:40])
    items = [(1, passage), (1, passage), (2, "WORD"), (None, None), (4, "")]
    spark.createDataFrame(items, "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    windows = set()
    for _, t in items:
        w = ALNUM_WORDS.findall(lower(t))
        windows |= {tuple(w[k : k + 10]) for k in range(max(0, len(w) - 10) + 1)} if w else set()

    def clean(text):
        w = ALNUM_WORDS.findall(lower(text))
        return not any(tuple(w[k : k + len(g)]) == g for g in windows for k in range(len(w) - len(g) + 1))

    kept = pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert kept.columns == list(pipeline.COLUMNS)
    want = Counter((i, t) for i, t in corpus if clean(t))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want
    assert want[2, corpus[1][1]] == 2 and want[None, None] == 1 and 0 < sum(want.values()) < len(corpus)
    assert pipeline.decontamination_stage(spark, no_docs, str(tmp_path)).count() == 0


def test_packing_stage_on_odd_rows(spark, docs, no_docs, corpus):
    """Every row is packed once, null ids, nulls, blanks and repeated rows included; long texts are cut at 2048 tokens alone."""
    from tests.llm.test_operators import _tokenizer

    _, tokenizer = _tokenizer()
    want = Counter()
    for i, t in corpus:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048))
    got = pipeline.packing_stage(spark, docs, "").collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert max(r["piece"] for r in got) > 0 and sum(r["doc_id"] is None for r in got) == 2
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048
    assert pipeline.packing_stage(spark, no_docs, "").count() == 0


def test_registered_queries_run(spark, sf_dir):
    from subtide.llm import registry

    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())
