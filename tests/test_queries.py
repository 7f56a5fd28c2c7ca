"""Every registered query of the library: it runs, and gives what its SQL gives."""

from __future__ import annotations

import math

import duckdb
import pytest

from palimpsest.plans.all_queries import ORACLES, QUERIES

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool | str):
        return str(value)
    if isinstance(value, list | tuple):
        return str([plain(x) for x in value])
    if hasattr(value, "isoformat"):
        return value.isoformat(sep=" ")
    return round(float(value), 5) + 0.0


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_sql(name, spark, db):
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.columns, got.collect()) == canonical(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark):
    df = QUERIES[name](spark, SF)
    assert len(df.collect()) > 0
