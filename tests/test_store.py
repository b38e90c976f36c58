"""The stored tree, its bytes and its command line against plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone import cli
from siltstone.config import Config
from siltstone.functions import encoding
from siltstone.operators import compaction, layout, perf
from siltstone.operators.store import Store, level_rates
from siltstone.sources import folders, oplog


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Nine batches of writes, and what a dictionary says after them."""
    rng = random.Random(4)
    made, live = Store(spark, str(tmp_path_factory.mktemp("store"))), {}
    for batch in range(9):
        rows = []
        for i in range(60):
            seq, k = 60 * batch + i, f"k{rng.randrange(80):02}"
            op = rng.choice("pppd")
            rows.append((seq, op, k, f"v{seq}" if op == "p" else None, None))
            live.pop(k, None)
            if op == "p":
                live[k] = f"v{seq}"
        made.flush(spark.createDataFrame(rows, oplog.LOG_SCHEMA).repartition(3))
    return made, live


def test_state_and_reads(store, spark):
    made, live = store
    assert {r.k: r.v for r in made.state().collect()} == live
    for low, high in (("k10", "k40"), ("k40", "k10"), ("a", "z"), ("k99", "z")):
        assert {r.k: r.v for r in made.range(low, high).collect()} == {k: v for k, v in live.items() if low <= k <= high}
    for k in ("k00", "k41", "nothing", ""):
        assert [r.v for r in made.get(k).collect()] == ([live[k]] if k in live else [])
    probes = spark.createDataFrame([(f"k{i:02}",) for i in range(90)], "k string")
    assert {r.k: (r.found, r.v) for r in made.multi_get(probes).collect()} == {f"k{i:02}": (f"k{i:02}" in live, live.get(f"k{i:02}")) for i in range(90)}


def test_levels_are_the_radix_and_the_deepest_has_no_deletes(store):
    made, live = store
    # Nine flushes: one table of six, one of two, one of one.
    assert [(t.level, t.number) for t in made.tables()] == [(0, 0), (1, 0), (2, 0)]
    rows = {r.level: r for r in made.levels().collect()}
    assert rows[2].deletes == 0 and rows[0].deletes > 0
    entries = {(r.level, r.k) for r in made.entries().collect()}
    assert len(entries) == sum(r.entries for r in rows.values())
    stats = made.stats().first()
    assert stats.logical_pairs == len(live) and stats.level_counts == {f"LEVEL{i}": rows[i].entries for i in (0, 1, 2)}
    assert {r.line.split(":")[2] for r in made.dump().collect()} == {"0", "1", "2"}


def test_point_reads_reach_the_scan(store):
    made, _ = store
    plan = made.get("k41")._jdf.queryExecution().toString()
    assert "EqualTo(k,k41)" in plan or "GreaterThanOrEqual(k,k41)" in plan
    assert made.get("zzz").isEmpty() and not made._between("zzz", "zzz").inputFiles()


def test_delete_segments_is_safe_to_repeat(spark, tmp_path):
    made = Store(spark, str(tmp_path))
    assert made.tables() == [] and made.state().isEmpty() and made.levels().isEmpty() and made.delete_segments() == 0
    for i in range(4):
        made.flush(spark.createDataFrame([(i, "p", f"k{i}", "v", None), (100 + i, "g", "k0", None, None)], oplog.LOG_SCHEMA))
    made.flush(spark.createDataFrame([(9, "g", "k0", None, None)], oplog.LOG_SCHEMA))
    before = {r.k for r in made.state().collect()}
    assert before == {"k0", "k1", "k2", "k3"} and made.delete_segments() > 0 and made.delete_segments() == 0
    assert {r.k for r in made.state().collect()} == before
    assert len(folders.names(spark, f"{tmp_path}/tables")) == len(made.tables())


def test_a_change_that_fails_leaves_the_state(spark, tmp_path):
    made = Store(spark, str(tmp_path))
    made.flush(spark.createDataFrame([(1, "p", "a", "x", None)], oplog.LOG_SCHEMA))
    # A manifest that was never finished.
    spark.createDataFrame([], "level int").write.parquet(f"{tmp_path}/manifest/2")
    folders.delete(spark, f"{tmp_path}/manifest/2/_SUCCESS")
    assert [r.v for r in made.get("a").collect()] == ["x"]
    made.flush(spark.createDataFrame([(2, "p", "a", "y", None)], oplog.LOG_SCHEMA))
    assert [r.v for r in made.get("a").collect()] == ["y"]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """Also after its deletes have been dropped."""
    made = Store(spark, str(tmp_path))
    batches = [spark.createDataFrame(rows, oplog.LOG_SCHEMA) for rows in ([(1, "p", "a", "x", None), (2, "p", "b", "y", None)], [(3, "d", "a", None, None)])]
    for batch in [batches[0], *batches, batches[0], batches[1]]:
        made.flush(batch)
    assert [(r.k, r.v) for r in made.state().collect()] == [("b", "y")] and len(made.tables()) == 1 and made.taken() == 3


def test_deletes_of_everything_leave_no_table(spark, tmp_path):
    made = Store(spark, str(tmp_path))
    for i in range(2):
        made.flush(spark.createDataFrame([(i, "d", "a", None, None)], oplog.LOG_SCHEMA))
    assert made.tables() == [] and made.get("a").isEmpty()


def test_rates_are_the_allocation(spark):
    entries = [300, 0, 6000, 50_000]
    out = layout.filter_allocation(spark.createDataFrame(list(enumerate(entries)), "level bigint, entries bigint"))
    assert [round(r.fpr, 9) for r in sorted(out.collect(), key=lambda r: r.level)] == [round(x, 9) for x in level_rates(entries)]


def test_command_line(spark, tmp_path):
    at = str(tmp_path / "store")
    (tmp_path / "w.txt").write_text("p 1 10\np 2 20\ng 1\nd 2\np 3 30\nbad line here\n")
    assert cli.run(spark, at, "l", str(tmp_path / "w.txt")) == ["ok"]
    assert cli.run(spark, at, "g", "1") == ["1 10"] and cli.run(spark, at, "g", "2") == ["not found"]
    assert cli.run(spark, at, "p", "2", "21") == ["ok"] and cli.run(spark, at, "d", "3") == ["ok"]
    assert cli.run(spark, at, "r", "1", "3") == ["1 10", "2 21"]
    assert cli.run(spark, at, "s")[0] == "logical_pairs 2"
    with pytest.raises(ValueError):
        cli.run(spark, at, "g")


def test_block_bytes_round_trip(spark):
    """Records of one and two varint bytes, characters of several bytes and repeated keys."""
    rows = [(0, f"prefix-{i % 10:03}:suffix-{i:03}", "x" * i) for i in range(300)] + [(1, "é" * i + "日", f"ß{i}") for i in range(40)] + [(2, "same", v) for v in ("a", "b", "b")]
    packed = layout.pack_blocks(spark.createDataFrame(rows, "segment bigint, k string, v string"))
    back = layout.decoded_blocks(layout.encoded_blocks(packed)).collect()
    assert sorted(map(tuple, back)) == sorted((r.segment, r.block, r.place, r.k, r.v) for r in packed.collect())
    sizes = {(r.segment, r.block): r.n for r in layout.encoded_blocks(packed).select("segment", "block", F.octet_length("data").alias("n")).collect()}
    for r in layout.block_summary(packed).collect():
        if r.segment != 1:
            assert sizes[r.segment, r.block] == r.bytes


def test_stored_segments_and_blocks(spark, tmp_path):
    rows = [(i, "p", f"key-{i % 900:05}", "x" * 40, i // 1000) for i in range(3000)]
    entries = spark.createDataFrame(rows, "seq bigint, op string, k string, v string, segment bigint")
    compaction.write_segments(entries, str(tmp_path / "s"))
    held = compaction.read_segments(spark, str(tmp_path / "s"))
    assert held.count() == len({(s, k) for _, _, k, _, s in rows}) and held.inputFiles()
    assert len(held.inputFiles()) <= 4
    block = compaction.read_block(spark, str(tmp_path / "s"), 1, 2).collect()
    packed = {(r.block, r.place): r.k for r in layout.pack_blocks(compaction.flush_segments(entries.where("segment = 1"))).collect()}
    assert [(r.place, r.k) for r in block] == sorted((p, k) for (b, p), k in packed.items() if b == 2)


def test_segment_get_by_its_steps(spark):
    entries = spark.createDataFrame([(0, f"key-{i:05}", str(i)) for i in range(0, 500, 2)], "segment bigint, k string, v string")
    bits, hashes = layout.bloom_size(250, 0.01)
    packed = layout.pack_blocks(entries, Config(block_bytes=512))
    probes = spark.createDataFrame([(0, f"key-{i:05}") for i in range(500)] + [(7, "key-00000")], "segment bigint, k string")
    rows = {(r.segment, r.k): r for r in layout.segment_get(probes, packed, layout.bloom_build(entries, bits, hashes), bits, hashes).collect()}
    assert all(rows[0, f"key-{i:05}"].v == (str(i) if i % 2 == 0 else None) for i in range(500))
    assert not rows[7, "key-00000"].found and sum(r.block is None for r in rows.values()) > 200
    where = {r.k: (r.block, r.place // 16) for r in packed.collect()}
    assert all((rows[0, k].block, rows[0, k].run) == x for k, x in where.items())


def test_metrics_files(spark, tmp_path):
    section = "old\nPerformance counter stats\n {} cycles:u\n 7 instructions:u\n 1.5 seconds time elapsed\n"
    for i in (1, 2, 10):
        (tmp_path / f"bench_run_{i}.txt").write_text(section.format(100 * i))
    metrics = perf.extract(perf.read_logs(spark, str(tmp_path / "*.txt")))
    for name in ("get_bloom_1m", "put_10k"):
        perf.write_metrics(metrics, str(tmp_path / f"logs_{name}_metrics.csv"))
    back = perf.read_metrics(spark, str(tmp_path / "*_metrics.csv")).collect()
    assert {(r.op, r.variant, r.run, r.cycles, r.instructions, r.cache_misses, r.seconds_time_elapsed) for r in back} == {(op, v, i, 100 * i, 7, None, 1.5) for op, v in (("get", "bloom_1m"), ("put", "10k")) for i in (1, 2, 10)}


def test_closed_forms():
    size = lambda n: max(1, -(-n.bit_length() // 7))
    assert math.isclose(encoding.expected_varint_size(16), sum(map(size, range(1 << 16))) / (1 << 16))
    assert round(encoding.expected_varint_size(32), 2) == 4.94
    assert math.isclose(encoding.expected_geometric_varint_size(0.01), sum(0.01 * 0.99**n * size(n) for n in range(30_000)), rel_tol=1e-9)
    assert math.isclose(encoding.expected_shared_prefix(0.5, 16), 15 / 16)
    for bad in (lambda: encoding.expected_geometric_varint_size(0), lambda: encoding.expected_shared_prefix(1, 16)):
        with pytest.raises(ValueError):
            bad()
