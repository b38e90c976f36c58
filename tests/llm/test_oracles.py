"""The queries that have SQL give the same rows in DuckDB."""

from __future__ import annotations

from pathlib import Path

import pytest

from siltstone.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(name, spark, data):
    con = pytest.importorskip("duckdb").connect()
    for p in Path(data).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'" if p.is_dir() else f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    ours, theirs = QUERIES[name](spark, data), con.sql(ORACLE_SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    place = [theirs.columns.index(c) for c in sorted(theirs.columns)]
    assert sorted(tuple(r[c] for c in sorted(ours.columns)) for r in ours.collect()) == sorted(tuple(r[i] for i in place) for r in theirs.fetchall())
