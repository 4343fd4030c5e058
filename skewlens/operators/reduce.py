"""Semi-join reduction: rows that cannot match a set of keys go before an expensive shuffle.

The key set is written once and measured.  While it fits ``limit`` bytes, it is broadcast and the reduction is exact.  A larger
one becomes a Bloom filter of at most ``limit`` bytes (bitmap blocks built by Spark's bitmap aggregates), which lets some other
rows pass.  Where even that filter would be so full that it rejects little, the rows are returned as they are.  So a caller
that needs the exact restriction still applies it after its shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewlens.session import written

#: Bytes that may be broadcast; bytes of a row besides its values; bits of a Spark bitmap.
LIMIT, ROW_BYTES, BLOCK_BITS = 16 << 20, 32, 32768
PROBES = 2


def _slots(cols: Sequence[str], bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(*cols, F.lit(i)), F.lit(bits)) for i in range(PROBES)]


def bloom_blocks(keys: DataFrame, cols: Sequence[str], bits: int) -> DataFrame:
    """(block, bitmap) of a Bloom filter of ``bits`` bits over the keys."""
    slots = keys.select(F.explode(F.array(*_slots(cols, bits))).alias("slot"))
    return (slots.groupBy(F.expr(f"slot div {BLOCK_BITS}").alias("block"))
                 .agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(BLOCK_BITS))).alias("bitmap")))


def might_match(df: DataFrame, blocks: DataFrame, cols: Sequence[str], bits: int) -> DataFrame:
    """The rows whose key may be in the filter (no matching row is lost)."""
    names = df.columns
    for i, slot in enumerate(_slots(cols, bits)):
        df = df.withColumn("_slot", slot).withColumn("_block", F.expr(f"_slot div {BLOCK_BITS}"))
        df = df.join(F.broadcast(blocks.toDF("_block", "_bitmap")), "_block")      # at most bits / 8 bytes
        at = F.pmod("_slot", F.lit(BLOCK_BITS)).cast("int")
        byte = F.conv(F.hex(F.substring("_bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        df = df.where(F.call_function("shiftright", byte, at % 8).bitwiseAND(1) == 1).select(*names)
    return df


def may_match(df: DataFrame, keys: DataFrame, cols: Sequence[str], limit: int = LIMIT) -> DataFrame:
    """The rows of ``df`` that may match ``keys`` on ``cols``; every row that matches is among them.

    Runs one job that writes and measures the distinct keys.  A NULL in a key matches nothing, as in a join.
    """
    known = written(keys.select(*cols).dropna().distinct(), "keys")
    size = sum((F.octet_length(F.col(c).cast("string")) for c in cols), F.lit(ROW_BYTES))
    n, total = known.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if total <= limit:
        return df.join(F.broadcast(known), list(cols), "left_semi").select(*df.columns)
    bits = min(8 * limit // BLOCK_BITS * BLOCK_BITS, max(BLOCK_BITS, 1 << (16 * n).bit_length()))
    if bits < BLOCK_BITS or (1 - math.exp(-PROBES * n / bits)) ** PROBES > 0.5:
        return df
    return might_match(df, written(bloom_blocks(known, cols, bits), "filter"), cols, bits)
