"""Sums of doubles that do not depend on the order of rows.

Every double is a whole number of at most 88 bits times 2^(32 b - 55) for a bucket b of its magnitude.  That number is split into four
limbs of 22 bits, and the limbs are summed as longs, exactly, by ordinary partial aggregation (2^41 rows fit).  Equal
buckets are then put together as 38-digit decimals, and the buckets, from the largest down, as doubles.  So the sum is a function of
the values alone, whatever partitions, batches or retries they came through; where all values of a group lie within
one bucket it is the exact sum, rounded once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMBS, BITS = 4, 22


def _pow2(e: Column) -> Column:
    return F.pow(F.lit(2.0), e)


def _scaled(x: Column, e: Column) -> Column:
    """x * 2^e, in two steps, as 2^e alone may be out of a double's range."""
    half = F.floor(e / 2)
    return x * _pow2(half) * _pow2(e - half)


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def bucket(x: Column) -> Column:
    """b with |x| about from 2^(32 b) to 2^(32 b + 32); 0 for zero, NULL for NULL and values that are not finite."""
    return F.when(finite(x), F.when(x == 0, 0).otherwise(F.floor(F.log2(F.abs(x)) / 32)).cast("int"))


def limbs(x: Column, b: Column) -> list[Column]:
    """The limbs of x in its bucket, the most significant first, with the sign of x."""
    y = _scaled(F.abs(x), -32 * b)                      # below 2^33, in steps of at least 2^-55
    out, rest, sign = [], y / 2.0 ** 11, F.when(x < 0, -1).otherwise(1)
    for _ in range(LIMBS):
        whole = F.floor(rest)
        out.append(F.when(finite(x), sign * whole))
        rest = (rest - whole) * 2.0 ** BITS
    return out


def whole_number(sums: list[Column]) -> Column:
    """The limbs' sums as one number."""
    out = F.lit(0).cast("decimal(38,0)")
    for s in sums:
        out = (out * F.lit(1 << BITS).cast("decimal(8,0)")).cast("decimal(38,0)") + s.cast("decimal(19,0)")
        out = out.cast("decimal(38,0)")
    return out


def total(parts: Column) -> Column:
    """The sum of an array of structs (b, s: whole number) with at most one element per magnitude and partial group."""
    zero = F.lit(0).cast("decimal(38,0)")
    down = F.reverse(F.array_sort(F.filter(parts, lambda p: p["b"].isNotNull())))
    value = lambda s, b: _scaled(s.cast("double"), 32 * b - 55)
    start = F.struct(F.lit(None).cast("int").alias("b"), zero.alias("s"), F.lit(0.0).alias("sum"))
    step = lambda acc, p: F.when(
        acc["b"] == p["b"], F.struct(p["b"].alias("b"), (acc["s"] + p["s"]).cast("decimal(38,0)").alias("s"), acc["sum"].alias("sum"))
    ).otherwise(F.struct(p["b"].alias("b"), p["s"].alias("s"), F.when(acc["b"].isNull(), F.lit(0.0)).otherwise(
        acc["sum"] + value(acc["s"], acc["b"])).alias("sum")))
    end = lambda acc: F.when(acc["b"].isNotNull(), acc["sum"] + value(acc["s"], acc["b"]))
    return F.aggregate(down, start, step, end)
