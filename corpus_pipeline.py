"""Corpus preparation from documents to training sequences."""

from __future__ import annotations

from subtide.llm import pipeline

STAGES = pipeline.STAGES
ORACLE_SQL = pipeline.ORACLE_SQL
run = pipeline.run
