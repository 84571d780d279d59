"""License scans: Aho-Corasick over phrases and tags, shunting-yard over expressions.

One automaton finds notice phrases at word boundaries of the normalised text
and identifier tags in the raw text. What follows a tag is parsed as an
expression (``or`` binds least, then ``and``, then ``with``) and evaluated to the
labels it names and a permissiveness score: ``or`` takes the larger score,
``and`` the smaller, ``with`` raises the left side halfway to one. A document's
score is the smallest of its notices' scores, and 0 where it has none. A phrase
within a longer one (the base phrase in a lesser licence's name) adds its label, but
the longer phrase alone counts for the score.

Defined results: a null or empty text has no words, labels or score; a malformed
expression falls back to the identifiers in it, joined by ``and``; an unknown
identifier has no label and a score of 0, so ``and`` gives 0 with it and ``or`` passes it
over; an expression of unknown identifiers alone is passed over; repeated rows are
judged row by row; an empty table gives no rows; extra columns are left out; a long text
is handled whole, in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from subtide.llm import words as W

#: Phrase -> label. These three are the base.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases, in words of the normalised text.
MORE = {
    "lesser general public license": "lgpl", "library general public license": "lgpl", "affero general public license": "agpl",
    "bsd license": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "isc license": "isc", "zlib license": "zlib",
    "mozilla public license": "mpl", "eclipse public license": "epl", "boost software license": "bsl",
    "apache software license": "apache", "released under the mit": "mit", "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd", "cc0": "cc0", "public domain dedication": "cc0", "unlicense": "unlicense",
    "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc", "cc by nc nd": "cc-by-nc",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "proprietary",
}
#: Start of a lower-cased identifier -> label; the longest that fits counts.
IDENTIFIERS = {
    "mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "0bsd": "bsd", "isc": "isc", "zlib": "zlib",
    "mpl": "mpl", "epl": "epl", "bsl": "bsl", "unlicense": "unlicense", "cc0": "cc0", "cc-by": "cc-by", "cc-by-sa": "cc-by-sa",
    "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd",
}
#: How freely text under a label may be used.
PERMISSIVE = {
    "cc0": 1.0, "unlicense": 1.0, "mit": 0.95, "isc": 0.95, "zlib": 0.95, "bsl": 0.95, "bsd": 0.9, "apache": 0.9, "cc-by": 0.8, "mpl": 0.6, "epl": 0.6,
    "cc-by-sa": 0.5, "lgpl": 0.4, "gpl": 0.3, "agpl": 0.2, "cc-by-nd": 0.15, "cc-by-nc": 0.1, "proprietary": 0.0,
}
TAGS = ("spdx-license-identifier:", "license-expression:")

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_PIECE = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_SEPARATE = bytes(0x20 if W.NON_ALNUM[b] else W.LOWER[b] for b in range(256))


@lru_cache(maxsize=4096)
def label_of(identifier: str) -> str | None:
    low = identifier.lower()
    fit = [k for k in IDENTIFIERS if low == k or low.startswith((k + "-", k + "+"))]
    return IDENTIFIERS[max(fit, key=len)] if fit else None


def postfix(pieces: list[str]) -> list[str] | None:
    """The expression in postfix order by the shunting-yard method; None if malformed."""
    out, held, operand = [], [], True
    for p in pieces:
        op = p.lower()
        if p == "(" and operand:
            held.append(p)
        elif p == ")" and not operand:
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif op in _PRECEDENCE and not operand:
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[op]:
                out.append(held.pop())
            held.append(op)
            operand = True
        elif p not in "()" and op not in _PRECEDENCE and operand:
            out.append(p)
            operand = False
        else:
            return None
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(text: str, begin: int = 0, end: int | None = None) -> tuple[frozenset[str], float] | None:
    """(labels, score) of the expression at text[begin:end]; None where it names no known licence."""
    pieces = []
    for m in _PIECE.finditer(text, begin, len(text) if end is None else end):  # two names in a row end the expression
        p = m[0].rstrip(".") or m[0]
        name = p not in "()" and p.lower() not in _PRECEDENCE
        if name and pieces and pieces[-1] not in "(" and pieces[-1].lower() not in _PRECEDENCE:
            break
        pieces.append(p)
    while pieces and pieces[-1].lower() in (*_PRECEDENCE, "("):
        pieces.pop()
    order = postfix(pieces)
    if order is None:
        known = [x for x in map(label_of, pieces) if x]
        return (frozenset(known), min(PERMISSIVE[x] for x in known)) if known else None
    stack: list[tuple[frozenset[str], float]] = []
    for p in order:
        if p not in _PRECEDENCE:
            label = label_of(p)
            stack.append((frozenset([label]), PERMISSIVE[label]) if label else (frozenset(), 0.0))
            continue
        b, a = stack.pop(), stack.pop()
        if p == "with":
            stack.append((a[0], (a[1] + 1) / 2 if a[0] else 0.0))
        else:
            stack.append((a[0] | b[0], (max if p == "or" else min)(a[1], b[1])))
    return stack[0] if stack and stack[0][0] else None


@lru_cache(maxsize=1)
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for p, label in (BASE | MORE).items():
        phrases.add_word(f" {p} ", (len(p), label, p in BASE))
    for t in TAGS:
        tags.add_word(t, len(t))
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan_text(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    raw = (text or "").encode()
    parts = raw.translate(_SEPARATE).split(b" ")
    words = [w for w in parts if w]
    flat = f" {b' '.join(words).decode('latin-1')} "
    phrases, tags = _automata()
    starts, base, labels, score = [], set(), set(), 1.0
    at = seen = 0
    found = sorted((end - n, -end, label, is_base) for end, (n, label, is_base) in phrases.iter(flat))
    reach = 0
    for begin, end, label, is_base in found:  # begin: the phrase's first character, after its space
        inner = -end <= reach  # within a longer phrase
        if inner and not is_base:
            continue
        reach = max(reach, -end)
        seen, at = seen + flat.count(" ", at, begin), begin
        labels.add(label)
        if not inner:
            score = min(score, PERMISSIVE[label])
        if is_base:
            starts.append(seen - 1)
            base.add(label)
    if b":" in raw:
        low = raw.translate(_LOWERED).decode("latin-1")
        for end, _ in tags.iter(low):
            stop = low.find("\n", end)
            got = evaluate(low, end + 1, stop if stop >= 0 else len(low))
            if got:
                labels |= got[0]
                score = min(score, got[1])
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), score if labels else 0.0,
    )


_LOWERED = bytes(W.LOWER)
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    for b in batches:
        rows = [scan_text(t.as_py()) for t in b["text"]]
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id and the columns of ``SCHEMA``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, {SCHEMA}")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_license_scans": op5_license_scans}
ORACLES: dict[str, str] = {}
