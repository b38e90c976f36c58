"""Storage layout as relations: segments, levels, blocks, fences, restarts, filters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.config import DEFAULT, Config
from siltstone.functions.encoding import common_prefix, hash_slice, let, record_size, varint_bytes, varint_size
from siltstone.operators.replay import carried

LEVELS = 12


def by_position(log: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The log with ``segment``: exact for logs of distinct keys in dense order, else by operations."""
    return log.withColumn("segment", F.floor(F.col("seq") / config.memtable_entries).cast("bigint"))


def by_distinct_keys(log: DataFrame, config: Config = DEFAULT, streams: list[str] | None = None) -> DataFrame:
    """The writes of a log with ``segment``: a segment ends when it holds the full number of distinct keys.

    Where a segment ends depends on all before it, so a stream's places and keys alone
    are folded in order by one task, which holds one segment's keys and returns where
    segments start; the writes find their segment from that side by side.  ``streams``:
    columns whose values are logs of their own and are folded apart.
    """
    most, streams = config.memtable_entries, streams or []
    writes = log.where(F.col("op").isin("p", "d"))
    kept = writes.select(*streams, "seq", "k")
    ordered = (kept.repartition(*streams) if streams else kept.repartition(1)).sortWithinPartitions(*streams, "seq")
    names = [*streams, "seq", "segment"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, segment, seen = None, 0, set()
        for batch in batches:
            starts = []
            *own, seqs, keys = (c.to_pylist() for c in batch.columns)
            for now, seq, key in zip(zip(*own) if own else repeat(()), seqs, keys):
                if now != stream:
                    stream, segment, seen = now, -1, None
                if seen is None or len(seen) >= most:
                    segment, seen = segment + 1, set()
                    starts.append((*now, seq, segment))
                seen.add(key)
            if starts:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*starts), [*(batch.schema.field(x).type for x in streams), pa.int64(), pa.int64()])], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "k") + ", segment bigint"
    starts = ordered.mapInArrow(fold, schema)
    # One key for the stream, never null.
    key = F.to_json(F.struct(*streams)) if streams else F.lit("")
    marks = starts.select(key.alias("stream key"), "seq", "segment")
    return carried(writes.withColumn("stream key", key), marks, ["stream key"], "segment").drop("stream key")


def segment_sizes(entries: DataFrame) -> DataFrame:
    return entries.groupBy("segment").agg(F.count("*").alias("n"))


def delta_encode(entries: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(segment, k, v, lcp, suffix, sizes): every record against its predecessor in the segment."""
    previous = F.lag("k").over(Window.partitionBy("segment").orderBy("k", "v"))
    prefixed = entries.select("segment", "k", "v", common_prefix(previous, F.col("k")).alias("lcp"))
    unshared = (F.length("k") - F.col("lcp")).cast("bigint")
    return prefixed.select(
        "segment",
        "k",
        "v",
        "lcp",
        F.expr("substring(k, int(lcp) + 1)").alias("suffix"),
        varint_size(F.col("lcp")).alias("shared_size"),
        varint_size(unshared).alias("unshared_size"),
        varint_size(F.length("v")).alias("value_size"),
        record_size(F.col("lcp"), F.length("k"), F.length("v")).cast("bigint").alias("encoded_size"),
    )


def delta_decode(encoded: DataFrame) -> DataFrame:
    """(segment, k, v) from (segment, place, lcp, suffix, v): keys rebuilt in order of place.

    A segment has at most a memtable's entries, so its records fit one array.
    """
    rows = encoded.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("place", "lcp", "suffix", "v"))).alias("rows"))
    strings = lambda kind: F.array().cast(kind).alias("keys")

    def step(acc: Column, r: Column) -> Column:
        key = F.concat(F.substring(acc["last"], F.lit(1), r["lcp"].cast("int")), r["suffix"])
        return let(key, lambda k: F.struct(k.alias("last"), F.concat(acc["keys"], F.array(k)).alias("keys")))

    def run(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["last"].alias("last"), strings("array<string>")), step)
        return let(inner, lambda x: F.struct(x["last"].alias("last"), F.concat(acc["keys"], F.array(x["keys"])).alias("keys")))

    # In two levels, so that appending to an array stays cheap.
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / 32).cast("int")), lambda i: F.slice("rows", i * 32 + 1, F.lit(32)))
    keys = F.flatten(F.aggregate(parts, F.struct(F.lit("").alias("last"), strings("array<array<string>>")), run, lambda acc: acc["keys"]))
    return rows.select("segment", F.inline(F.arrays_zip(keys.alias("k"), F.col("rows.v").alias("v"))))


def pack_blocks(entries: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(segment, block, place, k, v, bytes, restart) of every record by greedy packing.

    A record whose delta-encoded size would pass the block's limit starts a block; a
    block's first and every ``restart_interval``-th record are written whole.  Records
    stand in the order of key and value, also where a key repeats.  The fold runs over one array a segment, which has at most a memtable's entries.
    """
    order = Window.partitionBy("segment").orderBy("k", "v")
    length, value = F.length("k"), F.length("v")
    placed = entries.select("segment", "k", "v", F.lag("k").over(order).alias("previous"), F.row_number().over(order).alias("nth"))
    sized = placed.select("segment", "nth", "k", "v", record_size(common_prefix(F.col("previous"), F.col("k")), length, value).alias("delta"), record_size(F.lit(0), length, value).alias("whole"))
    rows = sized.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("nth", "k", "v", "delta", "whole"))).alias("rows"))
    zero = F.struct(*(F.lit(0).cast("bigint").alias(x) for x in ("n", "bytes", "i")), F.array().cast("array<bigint>").alias("starts"))

    def step(acc: Column, r: Column) -> Column:
        opens = (acc["bytes"] + r["delta"] > config.block_bytes) & (acc["n"] > 0)

        def placed(n: Column) -> Column:
            size = F.when(n % config.restart_interval == 0, r["whole"]).otherwise(r["delta"])
            return F.struct(
                (n + 1).alias("n"),
                (F.when(n == 0, 0).otherwise(acc["bytes"]) + size).cast("bigint").alias("bytes"),
                (acc["i"] + 1).alias("i"),
                F.when(n == 0, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
            )

        return let(F.when(opens, F.lit(0).cast("bigint")).otherwise(acc["n"]), placed)

    # The fold only finds where blocks start; places, restarts and sizes follow from that.
    starts = F.aggregate("rows", zero, step, lambda acc: acc["starts"])
    flat = rows.select("segment", starts.alias("starts"), "rows").select("segment", "starts", F.posexplode("rows").alias("i", "r"))
    placed = flat.select("segment", "i", "r", F.size(F.filter("starts", lambda s: s <= F.col("i"))).alias("nth"), "starts")
    placed = placed.select("segment", "r", (F.col("nth") - 1).cast("bigint").alias("block"), (F.col("i") - F.get("starts", F.col("nth") - 1)).alias("place"))
    restart = F.col("place") % config.restart_interval == 0
    return placed.select("segment", "block", "place", "r.k", "r.v", F.when(restart, F.col("r.whole")).otherwise(F.col("r.delta")).cast("bigint").alias("bytes"), restart.alias("restart"))


def block_summary(packed: DataFrame) -> DataFrame:
    return packed.groupBy("segment", "block").agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"), F.count_if("restart").alias("restarts"))


def fence_pointers(packed: DataFrame) -> DataFrame:
    """(segment, block, first_key, offset): each block's first key and place in the file, after its mark."""
    blocks = packed.groupBy("segment", "block").agg(F.min("k").alias("first_key"), F.sum("bytes").alias("bytes"))
    earlier = Window.partitionBy("segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("segment", "block", "first_key", (F.coalesce(F.sum("bytes").over(earlier), F.lit(0)) + 4).alias("offset"))


def fence_lookup(probes: DataFrame, fences: DataFrame) -> DataFrame:
    """(segment, k, block): the block of its segment that may hold each probe (segment, k).

    A key below the first fence gets block 0.  A segment's fences are one small array.
    """
    arrays = fences.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("block", "first_key"))).alias("fences"))
    below = F.filter("fences", lambda f: f["first_key"] <= F.col("k"))
    return probes.join(arrays, "segment").select("segment", "k", F.greatest(F.size(below) - 1, F.lit(0)).cast("bigint").alias("block"))


def segment_get(probes: DataFrame, packed: DataFrame, filters: DataFrame, bits: int, hashes: int, config: Config = DEFAULT) -> DataFrame:
    """(segment, k, maybe, block, run, found, v) of every probe (segment, k), by the steps of a read.

    The filter rules most absent keys out; a fence tells the block, the last restart
    at or before the key the run in it, and only that run's records are searched.
    Steps that were not taken are null.
    """
    asked = bloom_probe(probes, filters, bits, hashes)
    placed = fence_lookup(asked.where("maybe").select("segment", "k"), fence_pointers(packed))
    numbered = packed.withColumn("run", F.floor(F.col("place") / config.restart_interval))
    restarts = numbered.where("restart").groupBy("segment", "block").agg(F.array_sort(F.collect_list(F.struct("run", F.col("k").alias("first")))).alias("restarts"))
    before = F.filter("restarts", lambda r: r["first"] <= F.col("k"))
    runs = placed.join(restarts, ["segment", "block"]).select("segment", "k", "block", F.greatest(F.size(before) - 1, F.lit(0)).cast("bigint").alias("run"))
    # The newest writes of a segment, so a key is in one record.
    hits = runs.join(numbered.select("segment", "block", "run", "k", "v", F.lit(True).alias("found")), ["segment", "block", "run", "k"], "left")
    return asked.join(hits, ["segment", "k"], "left").select("segment", "k", "maybe", "block", "run", F.coalesce("found", F.lit(False)).alias("found"), "v")


def encoded_blocks(packed: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(segment, block, data): each block's records as bytes, end to end.

    A record is the varints of its shared, unshared and value bytes, the rest of the
    key and the value; keys share whole characters with the one before.
    """
    previous = F.lag("k").over(Window.partitionBy("segment", "block").orderBy("place"))
    whole = F.col("place") % config.restart_interval == 0
    shared = F.when(whole, F.lit(0).cast("bigint")).otherwise(common_prefix(previous, F.col("k")))
    cut = packed.select("segment", "block", "place", "k", "v", shared.alias("shared"))
    rest = F.expr("substring(k, int(shared) + 1)")
    held = F.octet_length(F.expr("substring(k, 1, int(shared))"))
    record = F.concat(*(varint_bytes(n.cast("bigint")) for n in (held, F.octet_length(rest), F.octet_length("v"))), rest.cast("binary"), F.col("v").cast("binary"))
    rows = cut.select("segment", "block", "place", record.alias("record"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "record"))), lambda x: F.hex(x["record"])), "")
    return rows.groupBy("segment", "block").agg(F.unhex(joined).alias("data"))


def decoded_blocks(blocks: DataFrame) -> DataFrame:
    """(segment, block, place, k, v) of the records of (segment, block, data), read one after the other."""

    def varint(data: bytes, at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, block, data in zip(*(c.to_pylist() for c in batch.columns)):
                at, last, keys, values = 0, b"", [], []
                while at < len(data):
                    shared, at = varint(data, at)
                    rest, at = varint(data, at)
                    size, at = varint(data, at)
                    last = last[:shared] + data[at : at + rest]
                    keys.append(last)
                    values.append(data[at + rest : at + rest + size])
                    at += rest + size
                n = len(keys)
                columns = [pa.array([segment] * n, pa.int64()), pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int64()), *(pa.array(x, pa.binary()).cast(pa.string()) for x in (keys, values))]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "block", "place", "k", "v"])

    return blocks.select("segment", "block", "data").mapInArrow(run, "segment bigint, block bigint, place bigint, k string, v string")


def hash_index(packed: DataFrame) -> DataFrame:
    """(segment, block, index): restart keys to restart ordinals; a block's first is not indexed."""
    restarts = packed.where(F.col("restart") & (F.col("place") > 0))
    entry = F.struct("k", (F.col("place") / DEFAULT.restart_interval).cast("bigint").alias("ordinal"))
    return restarts.groupBy("segment", "block").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("index"))


def bloom_size(n: int, fpr: float) -> tuple[int, int]:
    """Bits and hashes of a filter for n keys at a false-positive rate."""
    if not 0 < fpr < 1:
        raise ValueError("the false-positive rate must lie between 0 and 1")
    bits = math.ceil(-n * math.log(fpr) / math.log(2) ** 2)
    return bits, max(1, round(bits / n * math.log(2)))


def hashed_keys(keys: DataFrame) -> DataFrame:
    """(segment, k, h1, h2) of every key, for double hashing."""
    hashed = keys.select("segment", "k", F.md5(F.col("k").cast("binary")).alias("md5"))
    return hashed.select("segment", "k", *(F.conv(F.substring("md5", 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(2)))


def bloom_position(i, bits: int) -> Column:
    return F.pmod(F.col("h1") + i * F.col("h2"), F.lit(bits))


def bloom_build(entries: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(segment, words): each segment's bits as one array of 64-bit words."""
    # Exploding constants, Spark need not test each row's array for being empty.
    every = hashed_keys(entries).select("segment", "h1", "h2", F.explode(F.array(*map(F.lit, range(hashes)))).alias("i"))
    places = every.select("segment", bloom_position(F.col("i"), bits).alias("position"))
    marks = places.select("segment", F.shiftright("position", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("position") % 64).cast("int")).alias("marks"))
    # Every word once without a mark, so that none is missing from the array.
    blank = entries.select("segment").distinct().select("segment", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((bits - 1) // 64).cast("bigint"))).alias("word"), F.lit(0).cast("bigint").alias("marks"))
    words = marks.unionByName(blank).groupBy("segment", "word").agg(F.bit_or("marks").alias("marks"))
    return words.groupBy("segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "marks"))), lambda x: x["marks"]).alias("words"))


def bloom_probe(probes: DataFrame, filters: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(segment, k, maybe) of every probe (segment, k): whether all its bits are set; False without a filter."""

    def is_set(position: Column) -> Column:
        word = F.get("words", F.shiftright(position, 6).cast("int"))
        return F.coalesce(F.call_function("shiftright", word, (position % 64).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))

    placed = hashed_keys(probes).select("segment", "k", F.array(*(bloom_position(i, bits) for i in range(hashes))).alias("positions"))
    return placed.join(filters, "segment", "left").select("segment", "k", F.forall("positions", is_set).alias("maybe"))


def hash_slots(entries: DataFrame) -> DataFrame:
    """(segment, slots, empty, usable, cancelled) of a table of one slot a key: a slot of several keys is cancelled."""
    sizes = entries.groupBy("segment").agg(F.count("*").alias("slots"))
    slots = entries.join(sizes, "segment").groupBy("segment", "slots", F.pmod(hash_slice(F.col("k"), 0), F.col("slots")).alias("slot")).agg(F.count("*").alias("n"))
    used = slots.groupBy("segment", "slots").agg(F.count_if(F.col("n") == 1).alias("usable"), F.count_if(F.col("n") > 1).alias("cancelled"))
    return used.select("segment", "slots", (F.col("slots") - F.col("usable") - F.col("cancelled")).alias("empty"), "usable", "cancelled")


#: Segments whose ranks one task counts.
RANKED = 1 << 16


def ranked(rows: DataFrame, number: str, name: str) -> DataFrame:
    """``rows`` of distinct numbers with ``name``: how many of them are smaller.

    Ranges of numbers are counted first, so ranks within them are found side by side.
    """
    parts = rows.withColumn("part", F.floor(F.col(number) / RANKED))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("part").agg(F.count("*").alias("held")).select("part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(number)) - 1
    return parts.withColumn("place", place).join(before, "part").select(*rows.columns, (F.col("before") + F.col("place")).alias(name))


def level_placement(entries: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(segment, n, level, table): where each full segment lies after all flushes.

    Full levels merge into the next, so the number of flushes written in the mixed
    radix of the widths tells the tables of every level.  A flush, numbered among the
    full segments, lies at the first level whose next one does not cover it yet.
    """
    sizes = segment_sizes(entries).where(F.col("n") >= config.memtable_entries)
    numbered = ranked(sizes, "segment", "flush").join(F.broadcast(sizes.agg(F.count("*").alias("flushes"))), how="cross")
    per = config.flushes_per_table(LEVELS)
    level, table = F.lit(LEVELS - 1), F.lit(0)
    for i in range(LEVELS - 1, -1, -1):
        done = F.floor(F.col("flushes") / per[i + 1]) * per[i + 1]
        here = F.col("flush") >= done
        level = F.when(here, i).otherwise(level)
        table = F.when(here, F.floor((F.col("flush") - done) / per[i])).otherwise(table)
    return numbered.select("segment", "n", level.cast("bigint").alias("level"), table.cast("bigint").alias("table"))


def level_counts(placement: DataFrame) -> DataFrame:
    """(level, tables, entries) of the levels that hold any table."""
    return placement.groupBy("level").agg(F.count_distinct("table").alias("tables"), F.sum("n").alias("entries"))


def stats_dump(entries: DataFrame, placement: DataFrame) -> DataFrame:
    """(level, line): ``key:value:level`` of every entry that is in a level."""
    return entries.join(placement.select("segment", "level"), "segment").select("level", F.concat_ws(":", "k", "v", F.col("level").cast("string")).alias("line"))


def filter_allocation(levels: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(level, entries, bits, fpr, unguarded_fpr): filter bits an entry that minimise wasted reads.

    ``levels``: (level, entries), with empty levels as zeros.  Zero entries count as no
    term of the sum; ``unguarded_fpr`` is what results where they are not guarded and
    every level falls to the largest rate.
    """
    n = F.col("entries")
    term = F.when(n > 0, n * F.log2(n)).otherwise(0.0)
    total = levels.agg(F.sum(n).alias("total"), F.sum(term).alias("terms"), F.bool_or(n == 0).alias("hollow"))
    # One row of totals.
    rows = levels.join(F.broadcast(total), how="cross")
    raw = F.lit(float(config.bits_per_entry)) + F.col("terms") / F.col("total") - F.log2(F.greatest(n, F.lit(1)))
    bits = F.greatest(raw, F.lit(0.0))
    fpr = F.least(F.greatest(F.pow(F.lit(2.0), -bits), F.lit(config.least_fpr)), F.lit(config.most_fpr))
    return rows.select("level", "entries", bits.alias("bits"), fpr.alias("fpr"), F.when(F.col("hollow"), F.lit(config.most_fpr)).otherwise(fpr).alias("unguarded_fpr"))


def amplification(entries: DataFrame, placement: DataFrame) -> DataFrame:
    """Write, read and space amplification of the placed entries.

    Write: times that an entry was written, flush included.  Read: tables that a read
    of an absent key meets.  Space: stored entries for each distinct key.
    """
    written = placement.agg((F.sum(F.col("n") * (F.col("level") + 1)) / F.sum("n")).alias("write_amplification"), F.count_distinct("level", "table").alias("read_amplification"))
    stored = entries.join(placement.select("segment"), "segment", "left_semi")
    space = stored.agg((F.count("*") / F.count_distinct("k")).alias("space_amplification"))
    # Two single rows.
    return written.join(space, how="cross")
