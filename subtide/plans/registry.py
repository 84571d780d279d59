"""Registry of the library's own queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of queries; each registers its own by ``query``.
MODULES = ("search", "crosswalk", "inventory", "intervals", "text", "cleaning", "statistics", "upkeep", "parsing", "projections", "records", "builds", "desync", "reach", "stores")

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``, with the DuckDB SQL for its rows where SQL can express it."""

    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = fn
        if sql:
            _ORACLES[name] = sql
        return fn

    return register


def _load() -> None:
    for m in MODULES:
        import_module(f"subtide.plans.{m}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _QUERIES["j01_search_bm25_topk"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
