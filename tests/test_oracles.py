"""Every query of the library with an oracle gives the oracle's rows."""

from __future__ import annotations

import glob
import math
import os

import pytest

from subtide.plans import registry

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(float(v))
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, sf_dir, oracle, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(_cell, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    rel = oracle.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    place = [rel.columns.index(c) for c in columns]
    want = sorted(tuple(_cell(r[i]) for i in place) for r in rel.fetchall())
    assert got == want


def test_entry_points_import_and_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
