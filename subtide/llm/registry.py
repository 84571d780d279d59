"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from subtide.llm import bwt, chat, decontam, divergence, html, licenses, lm, packing, periodic, quality, secrets, simhash, substring

MODULES = (decontam, packing, simhash, bwt, licenses, html, substring, chat, secrets, quality, lm, periodic, divergence)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
