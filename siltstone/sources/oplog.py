"""Sources of operation logs: (seq, op, k, v, k2), op one of p, g, d, r.

Keys and values are strings and compare byte by byte.  A put of the tombstone
value is a delete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.config import TOMBSTONE

LOG_SCHEMA = "seq bigint, op string, k string, v string, k2 string"

#: Verbs with two operands and with one.
PAIRED, SINGLE = ("p", "r"), ("g", "d")
INTEGER = r"^[+-]?[0-9]+$"


def integer_text(token: Column) -> Column:
    """A 64-bit decimal integer in its plain form, null for anything else."""
    return F.when(token.rlike(INTEGER), token.try_cast("bigint")).cast("string")


def parse_workload(lines: DataFrame) -> DataFrame:
    """(seq, class, op, k, v, k2) of the lines of (seq, line).

    ``class`` is blank, ok, unknown (verb or number of words) or parse_error (an
    operand that is no 64-bit integer).  Only class ok is an operation.
    """
    words = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    parts = lines.select("seq", words.alias("w"))
    word = lambda i: F.get("w", F.lit(i))
    verb = word(0)
    # A generator of one row keeps filters on its columns from repeating the parsing.
    fields = F.struct(verb.alias("verb"), F.size("w").alias("n"), integer_text(word(1)).alias("a"), integer_text(word(2)).alias("b"))
    typed = parts.select("seq", F.inline(F.array(fields)))
    two = F.col("verb").isin(*PAIRED)
    known = two & (F.col("n") == 3) | F.col("verb").isin(*SINGLE) & (F.col("n") == 2)
    good = F.col("a").isNotNull() & (~two | F.col("b").isNotNull())
    kind = F.when(F.col("verb") == "", "blank").when(~known, "unknown").when(~good, "parse_error").otherwise("ok")
    classed = typed.select("seq", kind.alias("class"), "verb", "a", "b")
    ok = F.col("class") == "ok"
    removed = (F.col("verb") == "p") & (F.col("b") == TOMBSTONE)
    return classed.select(
        "seq",
        "class",
        F.when(ok, F.when(removed, "d").otherwise(F.col("verb"))).alias("op"),
        F.when(ok, F.col("a")).alias("k"),
        F.when(ok & (F.col("verb") == "p"), F.col("b")).alias("v"),
        F.when(ok & (F.col("verb") == "r"), F.col("b")).alias("k2"),
    )


def read_workload(spark: SparkSession, path: str) -> DataFrame:
    """Lines (seq, line) of text files; seq numbers them by file name and place in the file.

    Files are cut into splits that come in any order, so each split's lines are counted
    first; a line's number is the count of the splits before plus its place in its own.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line")
    )
    splits = lines.groupBy("file", "start").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    # A row for each split, which the driver lists anyway to plan the scan.
    earlier = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    numbered = splits.select("file", "start", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(F.broadcast(numbered), ["file", "start"]).select((F.col("place") + F.col("shift")).alias("seq"), "line")


def operations(parsed: DataFrame) -> DataFrame:
    """The operations among parsed lines."""
    return parsed.where(F.col("class") == "ok").select("seq", "op", "k", "v", "k2")


def normalised(log: DataFrame) -> DataFrame:
    """A log in which a put of the tombstone value is a delete, and deletes have no value."""
    removed = F.coalesce((F.col("op") == "d") | (F.col("op") == "p") & (F.col("v") == TOMBSTONE), F.lit(False))
    return log.select("seq", F.when(removed, "d").otherwise(F.col("op")).alias("op"), "k", F.when(~removed, F.col("v")).alias("v"), "k2")


def from_pairs(table: DataFrame, seq: str, key: str, value: str) -> DataFrame:
    """A bulk load: every row a put."""
    none = F.lit(None).cast("string")
    return normalised(table.select(F.col(seq).cast("bigint").alias("seq"), F.lit("p").alias("op"), F.col(key).cast("string").alias("k"), F.col(value).cast("string").alias("v"), none.alias("k2")))


def from_events(events: DataFrame) -> DataFrame:
    """The update-heavy log of an event stream: errors delete, views get, the rest put."""
    op = F.when(F.col("event_type") == "error", "d").when(F.col("event_type") == "view", "g").otherwise("p")
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    return events.select(
        F.col("event_id").alias("seq"),
        op.alias("op"),
        F.col("user_id").cast("string").alias("k"),
        F.when(op == "p", cents).alias("v"),
        F.lit(None).cast("string").alias("k2"),
    )


def from_orders(orders: DataFrame) -> DataFrame:
    """The bulk-load log of orders: distinct keys in order of arrival."""
    return from_pairs(orders, "o_orderkey", "o_orderkey", "o_custkey")


def require_keys(log: DataFrame) -> DataFrame:
    """The log; reading a row with an empty or null key fails."""
    bad = F.col("k").isNull() | (F.col("k") == "")
    return log.withColumn("k", F.when(bad, F.raise_error(F.lit("empty key"))).otherwise(F.col("k")))
