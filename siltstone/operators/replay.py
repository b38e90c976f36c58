"""Replay of a log: every read sees the writes before it and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.encoding import human_size
from siltstone.operators.state import crossed_buckets, key_bucket, sample_bounds


#: Places of the log that one task of a window may hold for a key; longer histories are cut.
SPAN = 1 << 22


def carried(rows: DataFrame, marks: DataFrame, keys: list[str], name: str, span: int = SPAN) -> DataFrame:
    """``rows`` with ``name``: that of the latest mark (keys, seq, name) of the same keys at or before the row's seq.

    Within the keys and a span of places the last mark is carried along; rows before a
    span's first mark take the last one of the keys' earlier spans, of which there is a
    row each.  So the rows of one key spread over tasks.  Keys must not be null.
    """
    own = [F.col(k) for k in keys]
    held = rows.select(*own, "seq", F.struct(*rows.columns).alias("row"), F.lit(None).cast(marks.schema[name].dataType).alias("mark"), F.lit(1).alias("side"))
    both = held.unionByName(marks.select(*own, "seq", F.lit(None).cast(held.schema["row"].dataType).alias("row"), F.col(name).alias("mark"), F.lit(0).alias("side")))
    both = both.withColumn("part", F.floor(F.col("seq") / span))
    before = Window.partitionBy(*keys, "part").orderBy("seq", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = both.withColumn("last", F.last("mark", ignorenulls=True).over(before)).where("side = 1").select(*keys, "part", "row", "last")
    spans = both.groupBy(*keys, "part").agg(F.max(F.when(F.col("side") == 0, F.struct("seq", "mark"))).alias("top"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = spans.select(*keys, "part", F.last("top", ignorenulls=True).over(earlier)["mark"].alias("carry")).where("carry IS NOT NULL")
    return inner.join(carry, [*keys, "part"], "left").select("row.*", F.coalesce("last", "carry").alias(name))


def asof_get(log: DataFrame, span: int = SPAN) -> DataFrame:
    """(seq, k, found, v) of every get, as of its place in the log."""
    return asof(log.where(F.col("op") == "g").select("seq", "k"), log, span)


def asof(reads: DataFrame, log: DataFrame, span: int = SPAN) -> DataFrame:
    """``reads`` (seq, k and other columns) with found and v: what the log's writes before each say of its key."""
    writes = log.where(F.col("op").isin("p", "d") & F.col("k").isNotNull()).select("k", "seq", F.struct("op", "v").alias("write"))
    seen = carried(reads, writes, ["k"], "write", span)
    found = F.coalesce(F.col("write.op") == "p", F.lit(False))
    return seen.select(*reads.columns, found.alias("found"), F.when(found, F.col("write.v")).alias("v"))


def version_history(log: DataFrame, span: int = SPAN) -> DataFrame:
    """(k, v, op, valid_from, valid_to) of every write; valid_to is null for a key's last.

    The next write is found within the key's span, and for a span's last write it is
    the first of the key's next span.
    """
    writes = log.where(F.col("op").isin("p", "d") & F.col("k").isNotNull()).select("seq", "op", "k", "v", F.floor(F.col("seq") / span).alias("part"))
    inner = writes.withColumn("next", F.lead("seq").over(Window.partitionBy("k", "part").orderBy("seq")))
    firsts = writes.groupBy("k", "part").agg(F.min("seq").alias("first"))
    following = firsts.select("k", "part", F.lead("first").over(Window.partitionBy("k").orderBy("part")).alias("after")).where("after IS NOT NULL")
    return inner.join(following, ["k", "part"], "left").select("k", "v", "op", F.col("seq").alias("valid_from"), F.coalesce("next", "after").alias("valid_to"))


def range_reads(log: DataFrame) -> DataFrame:
    """(seq, k): every key that the log ever puts and that lies in a range read, as one read of that key.

    Keys and ranges meet in buckets between keys of a sample, so a bucket holds about
    as many keys whatever their prefixes, and a range is in those only that it crosses.
    """
    keys = log.where((F.col("op") == "p") & F.col("k").isNotNull()).select(F.col("k").alias("key")).distinct()
    bounds = sample_bounds(keys, "key")
    ranges = crossed_buckets(log.where(F.col("op") == "r").select("seq", F.col("k").alias("low"), F.col("k2").alias("high")), "low", "high", bounds)
    hits = ranges.join(keys.withColumn("bucket", key_bucket(F.col("key"), bounds)), "bucket").where(F.col("key").between(F.col("low"), F.col("high")))
    return hits.select("seq", F.col("key").alias("k"))


def range_replay(log: DataFrame) -> DataFrame:
    """(seq, k, v): what every range read of the log returns, as of its place."""
    return asof(range_reads(log), log).where("found").select("seq", "k", "v")


def workload_profile(log: DataFrame) -> DataFrame:
    """Operations by verb, and the size of eight bytes a put."""
    count = lambda op: F.count_if(F.col("op") == op)
    out = log.agg(count("p").alias("puts"), count("g").alias("gets"), count("d").alias("deletes"), count("r").alias("ranges"))
    size = F.col("puts") * 8
    return out.withColumn("data_size_bytes", size).withColumn("data_size", human_size(size))


def workload_stats(parsed: DataFrame) -> DataFrame:
    """Counters of a replay of parsed lines: successes and failures by verb.

    A get fails on an absent key, a range if it returns nothing; puts and deletes
    succeed.  All lines count, blank ones too.
    """
    log = parsed.where(F.col("class") == "ok")
    lines = parsed.agg(
        F.count("*").alias("total_lines"),
        F.count_if(F.col("op") == "p").alias("put_success"),
        F.count_if(F.col("op") == "d").alias("delete_success"),
        F.count_if(F.col("op") == "r").alias("ranges"),
        F.count_if(F.col("class") == "parse_error").alias("parse_errors"),
        F.count_if(F.col("class") == "unknown").alias("unknown_commands"),
    )
    gets = log.where(F.col("op") == "g").select("seq", "k", F.lit(False).alias("ranged"))
    reads = asof(gets.unionByName(range_reads(log).withColumn("ranged", F.lit(True))), log)
    ranged = F.col("ranged")
    seen = reads.agg(
        F.count_if(F.col("found") & ~ranged).alias("get_success"),
        F.count_if(~F.col("found") & ~ranged).alias("get_fail"),
        F.count_distinct(F.when(F.col("found") & ranged, F.col("seq"))).alias("range_success"),
    )
    # Two single rows.
    out = lines.join(seen, how="cross")
    return out.withColumn("range_fail", F.col("ranges") - F.col("range_success")).drop("ranges")
