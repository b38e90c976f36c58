"""Sizes and pieces of delta-encoded records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that two strings share from the left; 0 where either is null."""
    shorter = F.least(F.length(a), F.length(b))
    places = F.sequence(F.lit(1), F.greatest(shorter, F.lit(1)))
    same = F.filter(places, lambda i: (i <= shorter) & (F.substring(a, 1, i) == F.substring(b, 1, i)))
    return F.coalesce(F.size(same), F.lit(0)).cast("bigint")


def varint_size(n: Column) -> Column:
    """Bytes of a non-negative 64-bit integer at seven bits a byte; zero takes one."""
    out = F.lit(9)
    for size in range(8, 0, -1):
        out = F.when(n < (1 << 7 * size), size).otherwise(out)
    return out.cast("bigint")


def varint_bytes(n: Column) -> Column:
    """The bytes of a non-negative 64-bit integer, seven bits in each from the lowest, the eighth set on all but the last."""

    def coded(size: int) -> Column:
        parts = [F.shiftright(n, 7 * i).bitwiseAND(F.lit(127)) + (128 if i < size - 1 else 0) for i in range(size)]
        return F.concat(*(F.unhex(F.lpad(F.hex(p), 2, "0")) for p in parts))

    out = coded(9)
    for size in range(8, 0, -1):
        out = F.when(n < (1 << 7 * size), coded(size)).otherwise(out)
    return out


def expected_varint_size(bits: int) -> float:
    """Mean bytes of a uniform integer below ``2**bits``."""
    counts = [(min(bits, 7 * size), size) for size in range(1, -(-bits // 7) + 1)]
    lower, mean = 0, 0.0
    for top, size in counts:
        mean += size * ((1 << top) - lower) / (1 << bits)
        lower = 1 << top
    return mean


def expected_geometric_varint_size(p: float) -> float:
    """Mean bytes of an integer that is n with the probability ``p * (1 - p) ** n``."""
    if not 0 < p <= 1:
        raise ValueError("the probability must lie above 0 and at most at 1")
    # One byte, and one more for every power of 128 that the integer reaches.
    return 1 + sum((1 - p) ** (1 << 7 * size) for size in range(1, 9))


def expected_shared_prefix(p: float, interval: int) -> float:
    """Mean characters that a key shares with the one before, each further one with probability ``p``, but at restarts none."""
    if not 0 <= p < 1 or interval < 1:
        raise ValueError("the probability must lie below 1 and the interval be positive")
    return (1 - 1 / interval) * p / (1 - p)


def record_size(shared: Column, key_length: Column, value_length: Column) -> Column:
    """Bytes of a record whose key shares ``shared`` characters with the one before."""
    suffix = key_length - shared
    return varint_size(shared) + varint_size(suffix) + varint_size(value_length) + suffix + value_length


def human_size(n: Column) -> Column:
    """A byte count with a unit: one decimal below ten, rounded up."""
    out = F.concat(n.cast("string"), F.lit("B"))
    for power, unit in enumerate("KMGTPE", 1):
        scale = 1 << 10 * power
        tenths = F.ceil(n * 10 / scale)
        whole = F.ceil(n / scale)
        text = F.when(tenths < 100, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))).otherwise(whole.cast("string"))
        out = F.when(n >= scale, F.concat(text, F.lit(unit + "B"))).otherwise(out)
    return out


#: Factors of the unit letters of a size label.
UNITS = {"": 1, "k": 1_000, "m": 1_000_000}


def size_order(label: Column) -> tuple[Column, Column, Column]:
    """Sort keys of a label: sizes by number first, then other labels by name."""
    pattern = r"^([0-9]+(?:\.[0-9]+)?)([kKmM]?)$"
    sized = label.rlike(pattern)
    unit = F.lower(F.regexp_extract(label, pattern, 2))
    factor = F.when(unit == "k", UNITS["k"]).when(unit == "m", UNITS["m"]).otherwise(UNITS[""])
    number = F.when(sized, F.regexp_extract(label, pattern, 1).try_cast("double") * factor)
    return F.when(sized, 0).otherwise(1), number, label


def hash_slice(key: Column, part: int) -> Column:
    """Eight hexadecimal digits of a key's MD5 as a number."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 8 * part + 1, 8), 16, 10).cast("bigint")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, for folds whose steps use it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
