"""Streaming ingest gives the state of the whole log."""

from __future__ import annotations

from siltstone.operators import state
from siltstone.operators.store import Store
from siltstone.sources import oplog
from siltstone.streaming import ingest


def test_batches_resolve_to_the_same_state(spark, tmp_path):
    rows = [(i, "d" if i % 7 == 0 else "p", str(i % 11), None if i % 7 == 0 else f"v{i}", None) for i in range(90)]
    log = spark.createDataFrame(rows, oplog.LOG_SCHEMA)
    for part in range(3):
        log.where(f"seq % 3 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.append_batches(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = {(r.k, r.v, r.seq) for r in ingest.current(spark, str(tmp_path / "out")).collect()}
    assert got == {(r.k, r.v, r.seq) for r in state.resolve(log).collect()}


def test_batches_into_a_store(spark, tmp_path):
    rows = [(i, "d" if i % 7 == 0 else "p", str(i % 11), None if i % 7 == 0 else f"v{i}", None) for i in range(90)]
    log = spark.createDataFrame(rows, oplog.LOG_SCHEMA)
    for part in range(3):
        log.where(f"seq % 3 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"), in_order=False)
    ingest.into_store(stream, store, str(tmp_path / "check")).awaitTermination(120)
    expected = {(r.k, r.v, r.seq) for r in state.resolve(log).collect()}
    assert {(r.k, r.v, r.seq) for r in store.state().collect()} == expected
    assert len(store.tables()) == 2
    store.flush(log.where("seq % 3 = 1"))
    assert {(r.k, r.v, r.seq) for r in store.state().collect()} == expected
