"""Every catalogue query that has SQL gives the same rows in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from siltstone.plans import catalog


def plain(value):
    return (None if math.isnan(value) else round(value, 6)) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(data).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'" if p.is_dir() else f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(name, spark, data, duck):
    ours = catalog.QUERIES[name](spark, data)
    theirs = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    place = [theirs.columns.index(c) for c in sorted(theirs.columns)]
    a = sorted((tuple(plain(r[c]) for c in sorted(ours.columns)) for r in ours.collect()), key=str)
    b = sorted((tuple(plain(r[i]) for i in place) for r in theirs.fetchall()), key=str)
    assert a == b


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
