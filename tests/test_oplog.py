"""Parsing of workloads and the shapes of logs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone.config import TOMBSTONE, Config
from siltstone.functions.encoding import common_prefix, human_size, size_order, varint_size
from siltstone.operators import state
from siltstone.sources import oplog

LINES = [
    ("", "blank"), ("   ", "blank"), ("p 1 2", "ok"), ("  g   +7 ", "ok"), ("d -3", "ok"), ("r 9 10", "ok"), ("p 1", "unknown"), ("x 1 2", "unknown"),
    ("p 1 2 3", "unknown"), ("p a 2", "parse_error"), ("p 1 b", "parse_error"), ("g 1.5", "parse_error"), ("d 99999999999999999999", "parse_error"), ("r 1 z", "parse_error"),
    ("g", "unknown"), ("P 1 2", "unknown"), ("p\t4\t5", "ok"),
]


def test_parse_classes_and_fields(spark):
    lines = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(LINES)], "seq bigint, line string")
    rows = {r.seq: r for r in oplog.parse_workload(lines).collect()}
    assert [rows[i]["class"] for i in range(len(LINES))] == [c for _, c in LINES]
    assert (rows[2].op, rows[2].k, rows[2].v) == ("p", "1", "2")
    assert (rows[3].op, rows[3].k) == ("g", "7")
    assert (rows[5].op, rows[5].k, rows[5].k2) == ("r", "9", "10")
    assert rows[9].op is None and rows[9].k is None
    assert oplog.operations(oplog.parse_workload(lines)).count() == 5


def test_read_workload_files_in_order(spark, tmp_path):
    (tmp_path / "w.txt").write_text("p 1 2\n\ng 1\nd 1\n")
    lines = oplog.read_workload(spark, str(tmp_path / "w.txt")).orderBy("seq")
    assert [r.line for r in lines.collect()] == ["p 1 2", "", "g 1", "d 1"]


def test_read_workload_numbers_lines_over_files(spark, tmp_path):
    """A large later file, which Spark plans first, still comes last."""
    (tmp_path / "part-000").write_text("p 1 100\n")
    later = ["p 1 200", *(f"p {i} {i}" for i in range(2, 60_000))]
    (tmp_path / "part-001").write_text("\n".join(later) + "\n")
    (tmp_path / "part-002").write_text("d 7\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        lines = oplog.read_workload(spark, str(tmp_path)).cache()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.line for r in sorted(lines.collect(), key=lambda r: r.seq)] == ["p 1 100", *later, "d 7", ""]
    assert {r.seq for r in lines.collect()} == set(range(len(later) + 3))
    state_of = {r.k: r.v for r in state.resolve(oplog.operations(oplog.parse_workload(lines))).collect()}
    assert state_of["1"] == "200" and "7" not in state_of


def test_tombstone_value_is_a_delete(spark):
    log = spark.createDataFrame([(1, "p", "a", TOMBSTONE, None), (2, "p", "b", "x", None), (3, "d", "c", "junk", None)], oplog.LOG_SCHEMA)
    assert [(r.op, r.v) for r in oplog.normalised(log).orderBy("seq").collect()] == [("d", None), ("p", "x"), ("d", None)]


def test_empty_keys_fail(spark):
    log = spark.createDataFrame([(1, "p", "", "x", None)], oplog.LOG_SCHEMA)
    with pytest.raises(Exception, match="empty key"):
        oplog.require_keys(log).collect()


def test_config_is_checked():
    assert Config().widths(9) == [2, 3, 4, 6, 9, 14, 22, 35, 56]
    assert Config().flushes_per_table(6) == [1, 2, 6, 24, 144, 1296, 18144]
    with pytest.raises(ValueError):
        Config(factor=0.9)
    with pytest.raises(ValueError):
        Config(flush_fpr=1.0)


def test_scalar_functions(spark):
    df = spark.createDataFrame([(0,), (127,), (128,), (16383,), (16384,), (2**62,)], "n bigint")
    assert [r[0] for r in df.select(varint_size(F.col("n"))).collect()] == [1, 1, 2, 2, 3, 9]
    pairs = spark.createDataFrame([("abc", "abd"), ("abc", "abc"), ("", "a"), (None, "a"), ("x", "abc")], "a string, b string")
    assert [r[0] for r in pairs.select(common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 3, 0, 0, 0]
    sizes = spark.createDataFrame([(0,), (1023,), (1536,), (10240,), (10241,), (79360,), (8_000_000,)], "n bigint")
    assert [r[0] for r in sizes.select(human_size(F.col("n"))).collect()] == ["0B", "1023B", "1.5KB", "10KB", "11KB", "78KB", "7.7MB"]
    labels = spark.createDataFrame([(x,) for x in ("mixed", "1m", "10k", "2500K", "bloom_1m", "500")], "x string")
    assert [r.x for r in labels.orderBy(*size_order(F.col("x"))).collect()] == ["500", "10k", "1m", "2500K", "bloom_1m", "mixed"]
