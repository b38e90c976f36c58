"""Joins that neither a hot key nor a large table can overload.

Both rest on bitmaps: keys leave marks at their hashed places, and the bitmap, whose
size is fixed beforehand, is broadcast.  A key without a mark is certainly not among
those that made it, so a wrong mark costs time and never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._runtime import free_name, named, shuffle_partitions

#: A bitmap has at most 2**26 places: 2,048 rows of 4 KB.
MOST_BITS, CHUNK_PLACES = 26, 32_768
#: Rows of one key from which it is dealt over ``SPREAD`` salts.
HOT, SPREAD = 512, 64


def bits_for(keys: int) -> int:
    """Places, as a power of two, that leave one in sixteen marked, up to the fixed size."""
    return min(MOST_BITS, max(15, (16 * keys).bit_length()))


def _place(columns: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << bits)) + 1


def bitmap(keys: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """(chunk, marks) of the keys; the places are dealt by chunk first, so no task holds the whole bitmap."""
    place = _place(columns, bits)
    places = keys.select(F.bitmap_bucket_number(place).alias("chunk"), F.bitmap_bit_position(place).alias("place")).distinct()
    return places.repartition(shuffle_partitions(keys.sparkSession), "chunk").groupBy("chunk").agg(F.bitmap_construct_agg("place").alias("marks"))


def flagged(rows: DataFrame, columns: list[str], marks: DataFrame, bits: int, name: str) -> DataFrame:
    """The rows with a column ``name``: whether the bitmap has a mark at the key's place."""
    place = _place(columns, bits)
    chunk, held = free_name(rows.columns, "chunk"), free_name(rows.columns, "marks")
    # The bitmap has 2**bits / 8 bytes at most, so it may be broadcast whatever the keys.
    met = rows.withColumn(chunk, F.bitmap_bucket_number(place)).join(F.broadcast(marks.toDF(chunk, held)), chunk, "left")
    position = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(held, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (position % 8 + 1).cast("int"))) > 0, F.lit(False))
    return met.select(*named(rows.columns), set_.alias(name))


def only_keys(rows: DataFrame, columns: list[str], wanted: DataFrame, count: int) -> DataFrame:
    """The rows whose key may be among the ``count`` wanted ones: what a join then has to shuffle."""
    bits = bits_for(count)
    return flagged(rows, columns, bitmap(wanted, columns, bits), bits, "wanted").where("wanted").drop("wanted")


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, whose rows are few for each key, on ``keys``.

    ``hot``: the keys with many rows in ``many``.  Their rows are dealt over salts by a
    hash of the whole row, and their rows of ``one`` go to every salt.
    """
    bits = 22
    marks = bitmap(hot, keys, bits)
    own = F.pmod(F.xxhash64(*many.columns), F.lit(SPREAD)).cast("int")
    dealt = flagged(many, keys, marks, bits, "hot").select(*many.columns, F.when(F.col("hot"), own).otherwise(0).alias("salt"))
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    copies = flagged(one, keys, marks, bits, "hot").select(*one.columns, F.explode(every).alias("salt"))
    return dealt.join(copies, [*keys, "salt"], how).drop("salt")
