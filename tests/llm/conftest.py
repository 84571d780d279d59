from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string"


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text) with nulls, blanks, ties, repeats, near copies, shared passages and a long text."""
    import random

    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(r.randint(1, 9))) for _ in range(300)]
    words = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, other = words(60), words(45)
    base = words(120)
    rows = [(1, base), (2, base), (2, base), (3, base + " end"), (4, "x " + passage + " " + words(30)), (5, words(10) + "\n" + passage), (6, None), (7, ""), (8, "  \n "), (9, "Word"), (10, "word")]
    rows += [(11, other + " " + words(5) + " " + other), (12, words(4000)), (13, (words(3) + " ") * 40), (14, words(80).upper() + "!"), (None, base), (None, None), (16, passage[:200])]
    rows += [(100 + i, words(r.randint(1, 90))) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    full = [(i, t, "en", "s", len(t or ""), "clash") for i, t in corpus]
    return spark.createDataFrame(full, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def key(row):
    return tuple("" if v is None else str(v) for v in row)
