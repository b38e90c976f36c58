"""Merging of runs, and segments as sorted Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import DEFAULT, Config
from siltstone.operators.layout import pack_blocks
from siltstone.operators.state import resolve


def merge_runs(runs: list[DataFrame], purge: bool) -> DataFrame:
    """(k, op, v, seq): the newest version of every key of all runs.

    Deletes go only where ``purge`` says that no older run lies below.
    """
    merged = resolve(reduce(DataFrame.unionByName, runs), keep_tombstones=True)
    return merged.where(F.col("op") == "p") if purge else merged


def flush_segments(entries: DataFrame) -> DataFrame:
    """Entries with ``segment``, the newest version of a key in each."""
    last = entries.where(F.col("op").isin("p", "d")).groupBy("segment", "k").agg(F.max(F.struct("seq", "op", "v")).alias("last"))
    return last.select("segment", "k", "last.op", "last.v", "last.seq")


def write_segments(entries: DataFrame, path: str, config: Config = DEFAULT) -> None:
    """Segments as Parquet: many in a file, sorted by segment and key, with the number of the block that packing gives.

    Row groups can be skipped by the statistics of segment and key and by Bloom filters
    on the key, whose rate is that of a flush.
    """
    flushed = flush_segments(entries)
    blocks = pack_blocks(flushed, config).select("segment", "k", "block", "place")
    spark = entries.sparkSession
    stored = flushed.join(blocks, ["segment", "k"]).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "segment", "k").sortWithinPartitions("segment", "k")
    options = {"parquet.bloom.filter.enabled#k": "true", "parquet.bloom.filter.fpp#k": str(config.flush_fpr), "parquet.bloom.filter.expected.ndv#k": "100000"}
    stored.write.options(**options).mode("overwrite").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments that ``write_segments`` wrote; filters on segment, block and k reach the scan."""
    return spark.read.parquet(path)


def read_block(spark: SparkSession, path: str, segment: int, block: int) -> DataFrame:
    """(place, k, op, v, seq) of one block in order of place."""
    rows = read_segments(spark, path).where((F.col("segment") == segment) & (F.col("block") == block))
    return rows.select("place", "k", "op", "v", "seq").orderBy("place")
