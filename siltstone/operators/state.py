"""Current state of a log, and reads of it.

The last write of a key wins; a deleted key is absent.  Predicates on keys commute
with this and reach the scan; predicates on values do not and stay above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve(log: DataFrame, keep_tombstones: bool = False) -> DataFrame:
    """(k, v, seq) of each live key, or (k, op, v, seq) of each key with its deletes.

    One partial aggregation before the shuffle keeps a row a key and task.  ``seq``
    must be unique; null keys are not part of the state.
    """
    last = log.where(F.col("op").isin("p", "d") & F.col("k").isNotNull()).groupBy("k").agg(F.max(F.struct("seq", "op", "v")).alias("last"))
    out = last.select("k", F.col("last.op").alias("op"), F.col("last.v").alias("v"), F.col("last.seq").alias("seq"))
    return out if keep_tombstones else out.where(F.col("op") == "p").drop("op")


def get(log: DataFrame, key: str) -> DataFrame:
    """(k, v) of one key, no row if it is absent."""
    return resolve(log.where(F.col("k") == key)).select("k", "v")


def multi_get(log: DataFrame, probes: DataFrame) -> DataFrame:
    """(k, found, v) of every probe row of (k)."""
    state = resolve(log).select("k", "v", F.lit(True).alias("found"))
    return probes.select("k").join(state, "k", "left").select("k", F.coalesce("found", F.lit(False)).alias("found"), "v")


def absent(log: DataFrame, probes: DataFrame) -> DataFrame:
    """Probe rows whose key is not live."""
    return probes.select("k").join(resolve(log).select("k"), "k", "left_anti")


def in_range(k: Column, low, high, end_inclusive: bool = True, key_order: str = "lexicographic") -> Column:
    """Whether a key lies in a range, by bytes or by number."""
    if key_order == "numeric":
        k, low, high = (x.try_cast("bigint") for x in (k, _column(low), _column(high)))
    elif key_order != "lexicographic":
        raise ValueError("key_order must be 'lexicographic' or 'numeric'")
    return (k >= low) & (k <= high if end_inclusive else k < high)


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def range_scan(log: DataFrame, low: str, high: str, end_inclusive: bool = True, key_order: str = "lexicographic") -> DataFrame:
    """(k, v) of the live keys in a range; an inverted range is empty."""
    return resolve(log.where(in_range(F.col("k"), low, high, end_inclusive, key_order))).select("k", "v")


def range_flag(entries: DataFrame, low: str, high: str, by: str = "segment") -> DataFrame:
    """How completely each segment answers a range, with the number of its rows in it.

    ``FullSetFound`` only if the segment's largest key is the range's end: a larger
    key shows that the scan ended within the segment, and nothing at or after the
    start that it holds no part of the range.
    """
    k = F.col("k")
    inside = F.count_if(k.between(low, high))
    flag = (
        F.when((F.max(k) > high) & (F.max(k) >= low), "FirstKeyFound")
        .when(inside == 0, "KeyNotFound")
        .when(F.max(k) == high, "FullSetFound")
        .otherwise("FirstKeyFound")
    )
    return entries.groupBy(by).agg(inside.alias("n"), flag.alias("flag"))


def get_until(entries: DataFrame, high: str, by: str = "segment") -> DataFrame:
    """(segment, k, v, found): each segment's rows up to ``high``, all of them where it lacks that key."""
    found = entries.groupBy(by).agg(F.max(F.col("k") == high).alias("found"))
    return entries.join(found, by).where(~F.col("found") | (F.col("k") <= high)).select(by, "k", "v", "found")


#: Buckets of a range join at most, and keys of the sample for each.
BUCKETS, SAMPLED = 1024, 32


def sample_bounds(keys: DataFrame, key: str) -> list[str]:
    """Keys that split distinct keys into about equal buckets, two for each shuffle partition.

    The sample is of bounded size: the keys of the least hashes, so it depends neither
    on the order nor on the partitions.
    """
    buckets = min(BUCKETS, 2 * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = sorted(r[0] for r in keys.orderBy(F.xxhash64(key)).limit(buckets * SAMPLED).collect())
    return sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)}) if sample else []


def key_bucket(key: Column, bounds: list[str]) -> Column:
    """How many of the bounds are at most the key, found by halving."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(key < bounds[middle], search(lo, middle)).otherwise(search(middle + 1, hi))

    return search(0, len(bounds))


def crossed_buckets(ranges: DataFrame, low: str, high: str, bounds: list[str]) -> DataFrame:
    """Ranges, one row for each bucket that they cross (column ``bucket``); inverted ones have no row."""
    valid = ranges.where(F.col(low) <= F.col(high))
    return valid.withColumn("bucket", F.explode(F.sequence(key_bucket(F.col(low), bounds), key_bucket(F.col(high), bounds))))


def range_count(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, n): live keys in each inclusive range (range_id, low, high).

    The keys up to the range's end less those before its start: distinct ends are
    ranked among the keys of their bucket, and the buckets before add their totals.
    No range meets a key.
    """
    keys = resolve(log).select("k")
    bounds = sample_bounds(keys, "k")
    # Starts stand before equal keys, ends after them.
    ends = ranges.where("low <= high").select(F.explode(F.array(F.struct(F.col("low").alias("k"), F.lit(0).alias("side")), F.struct(F.col("high").alias("k"), F.lit(2).alias("side")))).alias("e")).select("e.*").distinct()
    both = keys.select("k", F.lit(1).alias("side")).unionByName(ends).withColumn("bucket", key_bucket(F.col("k"), bounds))
    is_key = F.when(F.col("side") == 1, 1).otherwise(0)
    before = Window.partitionBy("bucket").orderBy("k", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = both.withColumn("inner", F.sum(is_key).over(before)).where("side <> 1")
    # A row for each bucket, of which there are a fixed number at most.
    totals = both.groupBy("bucket").agg(F.sum(is_key).alias("n"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranks = inner.join(F.broadcast(starts), "bucket").select("k", "side", (F.col("inner") + F.col("before")).alias("rank"))
    low = ranks.where("side = 0").select(F.col("k").alias("low"), F.col("rank").alias("below"))
    high = ranks.where("side = 2").select(F.col("k").alias("high"), F.col("rank").alias("up_to"))
    found = ranges.select("range_id", "low", "high").join(low, "low", "left").join(high, "high", "left")
    n = F.when(F.col("low") <= F.col("high"), F.col("up_to") - F.col("below"))
    return found.select("range_id", F.coalesce(n, F.lit(0)).cast("bigint").alias("n"))
