"""State and replay against a plain dictionary that runs the log in order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import compaction, layout, replay, state
from siltstone.sources import oplog


def make_log(seed: int, n: int = 400, keys: int = 30) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        op = rng.choices("pgdr", (5, 3, 1, 1))[0]
        k, k2 = str(rng.randrange(-5, keys)), str(rng.randrange(-5, keys))
        out.append((seq, op, k, f"v{seq}" if op == "p" else None, k2 if op == "r" else None))
    return out


def run(log: list[tuple]):
    """The state and every read's answer of a dictionary."""
    now, gets, ranges = {}, {}, {}
    for seq, op, k, v, k2 in log:
        if op == "p":
            now[k] = (v, seq)
        elif op == "d":
            now.pop(k, None)
        elif op == "g":
            gets[seq] = now.get(k, (None,))[0]
        else:
            ranges[seq] = sorted((x, y[0]) for x, y in now.items() if k <= x <= k2)
    return now, gets, ranges


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    log = make_log(request.param)
    return spark.createDataFrame(log, oplog.LOG_SCHEMA).repartition(3), log, run(log)


def test_resolve(case):
    df, _, (now, _, _) = case
    assert {r.k: (r.v, r.seq) for r in state.resolve(df).collect()} == now


def test_reads(case, spark):
    df, _, (now, _, _) = case
    assert [(r.k, r.v) for r in state.get(df, "7").collect()] == ([("7", now["7"][0])] if "7" in now else [])
    probes = spark.createDataFrame([(str(k),) for k in range(-9, 40)], "k string")
    assert {r.k: (r.found, r.v) for r in state.multi_get(df, probes).collect()} == {str(k): (str(k) in now, now.get(str(k), (None,))[0]) for k in range(-9, 40)}
    assert {r.k for r in state.absent(df, probes).collect()} == {str(k) for k in range(-9, 40)} - set(now)
    assert sorted(r.k for r in state.range_scan(df, "1", "2").collect()) == sorted(k for k in now if "1" <= k <= "2")
    assert state.range_scan(df, "9", "10").isEmpty()
    numeric = state.range_scan(df, "-2", "9", end_inclusive=False, key_order="numeric")
    assert sorted(int(r.k) for r in numeric.collect()) == sorted(int(k) for k in now if -2 <= int(k) < 9)
    with pytest.raises(ValueError):
        state.range_scan(df, "1", "2", key_order="random")


def test_range_count(case, spark):
    df, _, (now, _, _) = case
    ranges = [(i, str(a), str(b)) for i, (a, b) in enumerate([(-3, 5), (1, 2), (9, 10), (0, 99)])]
    got = {r.range_id: r.n for r in state.range_count(df, spark.createDataFrame(ranges, "range_id bigint, low string, high string")).collect()}
    assert got == {i: sum(a <= k <= b for k in now) for i, a, b in ranges}


@pytest.mark.parametrize("span", [1, 7, 50, replay.SPAN])
def test_history_in_spans(case, span):
    df, log, (_, gets, _) = case
    assert {r.seq: (r.found, r.v) for r in replay.asof_get(df, span).collect()} == {s: (v is not None, v) for s, v in gets.items()}
    writes = [(seq, k) for seq, op, k, _, _ in log if op in "pd"]
    expected = {(k, seq): min((s for s, x in writes if x == k and s > seq), default=None) for seq, k in writes}
    assert {(r.k, r.valid_from): r.valid_to for r in replay.version_history(df, span).collect()} == expected


def test_replay(case):
    df, log, (_, gets, ranges) = case
    assert {r.seq: r.v for r in replay.asof_get(df).collect()} == gets
    got: dict = {}
    for r in replay.range_replay(df).collect():
        got.setdefault(r.seq, []).append((r.k, r.v))
    assert {s: sorted(x) for s, x in got.items()} == {s: x for s, x in ranges.items() if x}


def test_stats(case, spark):
    df, log, (_, gets, ranges) = case
    parsed = df.withColumn("class", F.lit("ok")).unionByName(spark.createDataFrame([(9999, None, None, None, None, "blank"), (9998, None, None, None, None, "parse_error")], oplog.LOG_SCHEMA + ", class string"))
    s = replay.workload_stats(parsed).first()
    assert (s.total_lines, s.put_success, s.delete_success) == (len(log) + 2, sum(x[1] == "p" for x in log), sum(x[1] == "d" for x in log))
    assert (s.get_success, s.get_fail) == (sum(v is not None for v in gets.values()), sum(v is None for v in gets.values()))
    assert (s.range_success, s.range_fail, s.parse_errors) == (sum(map(bool, ranges.values())), sum(not x for x in ranges.values()), 1)


def test_compaction_changes_nothing(case):
    df, log, (now, _, _) = case
    cut = len(log) // 3
    runs = [compaction.flush_segments(layout.by_position(df.where(p))).drop("segment") for p in (f"seq < {cut}", f"seq >= {cut}")]
    keep = compaction.merge_runs(runs, purge=False)
    assert {r.k for r in keep.where("op = 'p'").collect()} == set(now)
    assert keep.count() > compaction.merge_runs(runs, purge=True).count()
    assert {r.k: (r.v, r.seq) for r in compaction.merge_runs(runs, purge=True).collect()} == now


def test_segments_on_disk(case, spark, tmp_path):
    df, _, (now, _, _) = case
    compaction.write_segments(layout.by_position(df.withColumn("seq", F.col("seq") * 10)), str(tmp_path / "s"))
    back = compaction.read_segments(spark, str(tmp_path / "s"))
    assert {r.k: r.v for r in state.resolve(back).collect()} == {k: v for k, (v, _) in now.items()}


def test_empty_log(spark):
    df = spark.createDataFrame([], oplog.LOG_SCHEMA)
    for out in (state.resolve(df), replay.asof_get(df), replay.range_replay(df), replay.version_history(df), state.range_scan(df, "a", "b")):
        assert out.isEmpty()
    assert replay.workload_profile(df).first().puts == 0


def test_predicate_on_key_reaches_the_scan(spark, data):
    log = oplog.from_events(spark.read.parquet(f"{data}/events.parquet"))
    plan = state.range_scan(log, "10", "2")._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "user_id" in scan.split("DataFilters")[1]
    assert "props" not in scan.split("ReadSchema")[1]


def test_ranges_of_skewed_prefixes(spark):
    """Keys that share all but their last bytes spread over buckets; counts and replay are brute force."""
    rng = random.Random(8)
    names = [f"https://example.org/page/{i:05}" for i in range(900)] + ["", "zz", "é", "日"]
    log = [(i, rng.choice("ppppdg"), rng.choice(names)) for i in range(1500)]
    ranges = []
    for i in range(120):
        low, high = rng.choice(names), rng.choice(names)
        ranges.append((1500 + i, low, high) if i % 5 else (1500 + i, "https", "https://zzz"))
    ranges += [(1700, ranges[0][1], ranges[0][2]), (1701, "a", "a")]
    rows = [(i, op, k, f"v{i}" if op == "p" else None, None) for i, op, k in log] + [(i, "r", a, None, b) for i, a, b in ranges]
    df = spark.createDataFrame(rows, oplog.LOG_SCHEMA).repartition(3)
    live = {}
    for i, op, k in log:
        if op == "p":
            live[k] = f"v{i}"
        elif op == "d":
            live.pop(k, None)
    order = {i: sorted((k.encode(), v) for k, v in live.items() if a.encode() <= k.encode() <= b.encode()) for i, a, b in ranges}
    counts = state.range_count(df, spark.createDataFrame(ranges, "range_id bigint, low string, high string"))
    assert {r.range_id: r.n for r in counts.collect()} == {i: len(x) for i, x in order.items()}
    got = {}
    for r in replay.range_replay(df).collect():
        got.setdefault(r.seq, []).append((r.k.encode(), r.v))
    assert {i: sorted(got.get(i, [])) for i in order} == order
    bounds = state.sample_bounds(df.where("op = 'p'").select("k").distinct(), "k")
    held = df.where("op = 'p'").select("k").distinct().groupBy(state.key_bucket(F.col("k"), bounds)).count().collect()
    assert len(held) == len(bounds) + 1 == 8 and max(r["count"] for r in held) < 2 * sum(r["count"] for r in held) / 8
