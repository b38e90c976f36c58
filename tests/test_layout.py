"""Layout operators against simulations in plain Python."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltstone.config import Config
from siltstone.operators import layout, perf, state


def varint(n: int) -> int:
    return max(1, -(-n.bit_length() // 7))


def record(shared: int, k: str, v: str) -> int:
    return varint(shared) + varint(len(k) - shared) + varint(len(v)) + len(k) - shared + len(v)


def lcp(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def pack(entries: list[tuple[str, str]], most: int = 4096, every: int = 16) -> list[tuple]:
    out, block, n, size, last = [], 0, 0, 0, ""
    for k, v in sorted(entries):
        if size + record(lcp(last, k), k, v) > most and n:
            block, n, size = block + 1, 0, 0
        restart = n % every == 0
        own = record(0 if restart else lcp(last, k), k, v)
        out.append((block, n, k, own, restart))
        size, n, last = size + own, n + 1, k
    return out


FIXTURES = {
    "wide": [(f"key-{i:05}", "x" * 100) for i in range(100)],
    "mixed": [(f"key-{i:05}", "x" * (1000 if i % 50 == 0 else 10)) for i in range(150)],
    "big": [("large-key", "x" * 1_000_000), ("small", "1")],
    "prefix": [(f"prefix-{i % 10:03}:suffix-{i:03}", f"value-{i}") for i in range(100)],
    "reverse": [(f"key-{i:05}", f"value-{i}") for i in range(49, -1, -1)],
}


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(i, k, v) for i, name in enumerate(FIXTURES) for k, v in FIXTURES[name]]
    return spark.createDataFrame(rows, "segment bigint, k string, v string").cache()


def test_blocks_fences_and_restarts(entries):
    packed = layout.pack_blocks(entries)
    got = {}
    for r in packed.collect():
        got.setdefault(r.segment, []).append((r.block, r.place, r.k, r.bytes, r.restart))
    expected = {i: pack(x) for i, x in enumerate(FIXTURES.values())}
    assert {s: sorted(x) for s, x in got.items()} == expected
    fences = {(r.segment, r.block): (r.first_key, r.offset) for r in layout.fence_pointers(packed).collect()}
    for s, rows in expected.items():
        at = 4
        for b in sorted({x[0] for x in rows}):
            own = [x for x in rows if x[0] == b]
            assert fences[s, b] == (own[0][2], at)
            at += sum(x[3] for x in own)
    index = {(r.segment, r.block): r["index"] for r in layout.hash_index(packed).collect()}
    assert index[3, 0] == {x[2]: x[1] // 16 for x in expected[3] if x[0] == 0 and x[4] and x[1]}


def test_delta_round_trip(entries):
    from pyspark.sql import Window

    encoded = layout.delta_encode(entries).withColumn("place", F.row_number().over(Window.partitionBy("segment").orderBy("k")))
    back = layout.delta_decode(encoded.select("segment", "place", "lcp", "suffix", "v"))
    assert back.exceptAll(entries).isEmpty() and entries.exceptAll(back).isEmpty()


FENCE_CASES = [
    ("m", {"a": 0, "m": 0, "z": 0}),
    ("e j o t z", {"a": 0, "d": 0, "zz": 4, "e": 0, "j": 1, "o": 2, "g": 0, "l": 1, "r": 2, "w": 3, "i": 0, "j0": 1}),
    ("A E M T Z", {"a": 4, "m": 4}),
    ("a z", {"m": 0}),
]


def test_fence_lookup(spark):
    fences = spark.createDataFrame([(s, b, k) for s, (x, _) in enumerate(FENCE_CASES) for b, k in enumerate(x.split())], "segment bigint, block bigint, first_key string")
    probes = spark.createDataFrame([(s, k) for s, (_, x) in enumerate(FENCE_CASES) for k in x], "segment bigint, k string")
    got = {(r.segment, r.k): r.block for r in layout.fence_lookup(probes, fences).collect()}
    assert got == {(s, k): b for s, (_, x) in enumerate(FENCE_CASES) for k, b in x.items()}


def simulate(flushes: int, widths: list[int]) -> dict[int, tuple[int, int]]:
    """Levels as lists of tables, a full level merged into one table of the next."""
    levels: list[list[list[int]]] = [[] for _ in widths]
    for f in range(flushes):
        table, i = [f], 0
        while True:
            levels[i].append(table)
            if len(levels[i]) < widths[i]:
                break
            table, levels[i] = sum(levels[i], []), []
            i += 1
    return {f: (i, t) for i, tables in enumerate(levels) for t, own in enumerate(tables) for f in own}


@pytest.mark.parametrize("flushes", [1, 2, 15, 23, 24, 150, 151])
def test_level_placement(spark, flushes):
    rows = spark.range(flushes * 2).select(F.floor(F.col("id") / 2).alias("segment"))
    got = {r.segment: (r.level, r.table) for r in layout.level_placement(rows, Config(memtable_entries=2)).collect()}
    assert got == simulate(flushes, Config().widths(8))


@pytest.mark.parametrize("numbers", [[0, 2, 3], [5, 70_000, 70_001, 200_000, 300_000]])
def test_level_placement_ranks_the_full_segments(spark, numbers):
    """Short segments among the full ones, and numbers far apart, leave no gap."""
    rows = [(n,) for n in numbers for _ in range(2)] + [(1,), (70_002,)]
    got = {r.segment: (r.level, r.table) for r in layout.level_placement(spark.createDataFrame(rows, "segment bigint"), Config(memtable_entries=2)).collect()}
    expected = simulate(len(numbers), Config().widths(8))
    assert got == {n: expected[i] for i, n in enumerate(numbers)}


def test_repeated_keys_of_a_segment(spark):
    rows = [(0, "a", "zz"), (0, "a", "b"), (0, "ab", "c"), (0, "a", "b")]
    entries = spark.createDataFrame(rows, "segment bigint, k string, v string")
    got = sorted((r.block, r.place, r.k, r.bytes, r.restart) for r in layout.pack_blocks(entries).collect())
    assert got == pack([(k, v) for _, k, v in rows])
    sizes = sorted((r.k, r.v, r.lcp, r.encoded_size) for r in layout.delta_encode(entries).collect())
    assert sizes == [("a", "b", 0, 5), ("a", "b", 1, 4), ("a", "zz", 1, 5), ("ab", "c", 1, 5)]


def test_distinct_key_segments(spark):
    keys = [str(i * 7 % 13) for i in range(200)]
    expected, segment, seen = [], 0, set()
    for k in keys:
        if len(seen) >= 5:
            segment, seen = segment + 1, set()
        seen.add(k)
        expected.append(segment)
    log = spark.createDataFrame([(i, "p", k, "x", None) for i, k in enumerate(keys)], "seq bigint, op string, k string, v string, k2 string").repartition(3)
    got = layout.by_distinct_keys(log, Config(memtable_entries=5))
    assert got.columns == [*log.columns, "segment"]
    assert [r.segment for r in sorted(got.collect(), key=lambda r: r.seq)] == expected


def test_range_flag_and_get_until(spark):
    rows = [(0, k, "x") for k in "bdf"] + [(1, k, "x") for k in "bcd"] + [(2, "a", "x")]
    df = spark.createDataFrame(rows, "segment bigint, k string, v string")
    assert {r.segment: (r.n, r.flag) for r in state.range_flag(df, "b", "d").collect()} == {0: (2, "FirstKeyFound"), 1: (3, "FullSetFound"), 2: (0, "KeyNotFound")}
    assert {r.segment: r.flag for r in state.range_flag(df, "c", "c").collect()}[0] == "FirstKeyFound"
    got = sorted((r.segment, r.k, r.found) for r in state.get_until(df, "c").collect())
    assert got == [(0, "b", False), (0, "d", False), (0, "f", False), (1, "b", True), (1, "c", True), (2, "a", False)]


def test_bloom_has_no_false_negatives(spark, entries):
    bits, hashes = layout.bloom_size(500, 0.01)
    filters = layout.bloom_build(entries, bits, hashes)
    assert layout.bloom_probe(entries.select("segment", "k"), filters, bits, hashes).where("NOT maybe").isEmpty()
    strangers = spark.range(1000).select(F.lit(0).cast("bigint").alias("segment"), F.concat(F.lit("no-"), F.col("id")).alias("k"))
    assert layout.bloom_probe(strangers, filters, bits, hashes).where("maybe").count() < 50
    with pytest.raises(ValueError):
        layout.bloom_size(10, 1.5)


def test_filter_allocation_guards_empty_levels(spark):
    out = {r.level: r for r in layout.filter_allocation(spark.createDataFrame([(0, 0), (1, 6000)], "level bigint, entries bigint")).collect()}
    assert out[1].unguarded_fpr == 0.999 and out[1].fpr == pytest.approx(0.001)


def test_perf(spark):
    text = "Performance counter stats\n 9 cycles:u\nPerformance counter stats for 'x':\n  12 cycles:u\n 2.5 seconds time elapsed\n"
    logs = spark.createDataFrame([(1, text), (2, "nothing")], "run bigint, content string")
    rows = perf.extract(logs).collect()
    assert [(r.run, r.cycles, r.instructions, r.seconds_time_elapsed) for r in rows] == [(1, 12, None, 2.5)]
    names = spark.createDataFrame([("x/logs_get_bloom_1m_metrics.csv",)], "f string")
    assert tuple(names.select(*perf.labels(F.col("f"))).first()) == ("get", "bloom_1m")
