"""Exact de-duplication by two Bloom passes.

Pass 1 hashes every normalised text and finds the slots of a Bloom filter that are hit at least twice.  Each task
sums up the slots of its own rows, once and more than once, as packed lists per stretch of the filter, so what is shuffled is a few bytes
a slot and never more than about the filter's size per task; a stretch's lists are put together (a slot is hit twice if a list
says so or two lists hold it) and its slots hit twice become bitmaps.  Pass 2 probes the bitmaps: a row with a slot that no
other row hit has no equal and passes straight through; only the rest shuffles, grouped by SHA-256 of the whole normalised
text.  False positives of the filter cost shuffle, never correctness.

A filter of more than ``FILTER_BYTES`` is built in parts over ranges of the hash space, and the slim table of hashes, written by
range, is probed range by range, so that no more than that is ever broadcast.

Defined results: a null text counts as empty, and empty texts are equal to each other; of equal texts the
smallest non-null id stays; rows that repeat an id share its decision in :func:`duplicate_groups`, and
:func:`drop_duplicates_exact` returns one row for them; an empty table gives an empty result.  Extra columns
may have any name except those beginning with ``__dd_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewlens.llm.common import SPACE, cut, fresh, pow2_at_least, shards_of, ship_package, text_of
from skewlens.operators.reduce import bloom_blocks
from skewlens.session import scratch_path

#: Bits of one bitmap row; bytes of a filter that may be broadcast; rows whose slots a task holds before it hands them on.
BLOCK_BITS, FILTER_BYTES, HELD = 32768, 64 << 20, 2_000_000
HASHES = 2
#: Bytes of a list of groups that may be broadcast, and of one group in it.
LIST_BYTES, ROW_BYTES = 16 << 20, 120


def normalised(text: str | Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text_of(text), SPACE, " ")


def _slots(sha: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(sha, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def _packed(slots: np.ndarray) -> bytes:
    """Ascending slots as differences, byte by byte, so that a compressor finds the zeros of the upper bytes."""
    return np.diff(slots, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)


def repeated_slots(sha: DataFrame, bits: int, ranges: int = 1) -> DataFrame:
    """Pass 1 over ``__dd_sha`` and ``__dd_range``: (range, block, bitmap) of the slots hit by two or more rows.

    Each of the ``ranges`` has a filter of ``bits`` bits.
    """
    stretch = max(BLOCK_BITS, bits // shards_of(sha.sparkSession) // BLOCK_BITS * BLOCK_BITS)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            slot, n = np.unique(np.concatenate(held), return_counts=True)
            part = slot // stretch
            rows: tuple[list, ...] = ([], [], [])
            for a, b in zip(*(x.tolist() for x in _borders(part))):
                own, twice = slot[a:b] - part[a] * stretch, n[a:b] > 1
                for column, x in zip(rows, (int(part[a]), _packed(own[~twice]), _packed(own[twice]))):
                    column.append(x)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, (pa.int64(), pa.binary(), pa.binary()))],
                                              ["part", "once", "twice"])

        for batch in fresh(batches):
            first = batch.column(0).to_numpy() * (-(-bits // stretch) * stretch)
            held += [first + batch.column(1 + i).to_numpy() for i in range(HASHES)]
            size += batch.num_rows
            if size >= HELD:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros(stretch, bool) for _ in range(2))
        for batch in batches:
            for own, more in zip(batch.column("once"), batch.column("twice")):
                own, more = _unpacked(own.as_py()), _unpacked(more.as_py())
                twice[own[once[own]]] = True
                twice[more] = True
                once[own] = True
                once[more] = True
        per = -(-bits // stretch)
        bitmaps = np.packbits(twice, bitorder="little").reshape(-1, BLOCK_BITS // 8)
        some = np.flatnonzero(bitmaps.any(axis=1))
        part = key[0].as_py()
        block = some + part % per * (stretch // BLOCK_BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), part // per, np.int64)), pa.array(block.astype(np.int64)),
             pa.array([bitmaps[i].tobytes() for i in some], pa.binary())], ["range", "block", "bitmap"])

    ship_package(sha.sparkSession)
    slots = sha.select(F.col("__dd_range").cast("long"), *[s.alias(f"s{i}") for i, s in enumerate(_slots(F.col("__dd_sha"), bits))])
    return slots.mapInArrow(summed, "part bigint, once binary, twice binary").groupBy("part").applyInArrow(
        merged, "range bigint, block bigint, bitmap binary")


def _borders(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.diff(part, prepend=-1))
    return first, np.append(first[1:], len(part))


def probe(df: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Add ``__dd_rep``: whether every slot of the row was hit twice.  The bitmaps take ``bits / 8`` bytes at most and are broadcast."""
    rep = F.lit(True)
    for i, slot in enumerate(_slots(F.col("__dd_sha"), bits)):
        block, bitmap = f"__dd_block{i}", f"__dd_map{i}"
        df = df.withColumn(f"__dd_slot{i}", slot).withColumn(block, F.expr(f"__dd_slot{i} div {BLOCK_BITS}"))
        df = df.join(F.broadcast(bitmaps.select(F.col("block").alias(block), F.col("bitmap").alias(bitmap))), block, "left")
        at = F.pmod(f"__dd_slot{i}", F.lit(BLOCK_BITS)).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.expr("1").cast("int").bitwiseAND(F.call_function("shiftright", byte, at % 8)) == 1
        rep = rep & F.coalesce(hit, F.lit(False))
    df = df.withColumn("__dd_rep", rep)
    return df.drop(*[f"__dd_{k}{i}" for k in ("slot", "block", "map") for i in range(HASHES)])


def probed(docs: DataFrame, id_col: str, text_col: str, bits_per_row: int, filter_bytes: int) -> DataFrame:
    """(__dd_id, __dd_sha, __dd_rep) of every row: both passes over the slim table of hashes.

    While one filter is enough, the table is read twice.  More rows are written by range of their hash, and each
    range is probed with its own filter.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("__dd_id"), F.sha2(normalised(text_col), 256).alias("__dd_sha"))
    slim = cut(slim.withColumn("__dd_range", F.lit(0)), "sha")
    wanted = pow2_at_least(max(BLOCK_BITS, bits_per_row * slim.count()))
    bits = min(wanted, pow2_at_least(max(BLOCK_BITS, 8 * filter_bytes // 2 + 1)))
    ranges = wanted // bits
    if ranges == 1:
        return probe(slim, cut(repeated_slots(slim, bits), "bloom"), bits).drop("__dd_range")
    paths = [scratch_path(spark, name) for name in ("ranges", "probed")]
    dealt = slim.withColumn("__dd_range", F.pmod(F.xxhash64("__dd_sha", F.lit(HASHES)), F.lit(ranges)))
    dealt.write.partitionBy("__dd_range").parquet(paths[0])
    dealt = spark.read.schema(dealt.schema).parquet(paths[0])
    blocks = cut(repeated_slots(dealt, bits, ranges), "bloom")
    for r in range(ranges):
        own = F.col("__dd_range") == r                      # a folder each: a range reads its own rows only
        probe(dealt.where(own), blocks.where(F.col("range") == r), bits).drop("__dd_range").write.mode("append").parquet(paths[1])
    return spark.read.schema(slim.drop("__dd_range").withColumn("__dd_rep", F.lit(True)).schema).parquet(paths[1])


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     bits_per_row: int = 16, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256."""
    rows = probed(docs, id_col, text_col, bits_per_row, filter_bytes)
    straight = rows.where("not __dd_rep").select("__dd_id", F.col("__dd_id").alias("keep_id"),
                                                 F.lit(1).cast("long").alias("group_size"), "__dd_sha")
    again = rows.where("__dd_rep").select("__dd_id", "__dd_sha")
    groups = cut(again.groupBy("__dd_sha").agg(F.min("__dd_id").alias("keep_id"), F.count("*").alias("group_size")),
                 "groups")
    # A group may hold a third of all rows: both sides are plain exchanges, so AQE can split its partition.
    shuffled = again.join(groups, "__dd_sha").select("__dd_id", "keep_id", "group_size", "__dd_sha")
    return straight.unionByName(shuffled).select(
        F.col("__dd_id").alias(id_col), "keep_id", "group_size",
        F.col("__dd_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("__dd_sha").alias("text_sha256"))


def drop_duplicates_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          bits_per_row: int = 16, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows that stay, with all their columns.

    The groups of equal texts are found on the slim table.  While their list is small, no whole text moves at all but one per group; a
    longer list is told apart from the other texts by a Bloom filter, and only its texts shuffle.  Where that filter would
    pass ``filter_bytes`` too, all texts do.
    """
    rows = probed(docs, id_col, text_col, bits_per_row, filter_bytes)
    groups = rows.where("__dd_rep").groupBy("__dd_sha").agg(F.min("__dd_id").alias("__dd_keep"), F.count("*").alias("__dd_n"))
    winners = cut(groups.where("__dd_n > 1").select(F.col("__dd_sha").alias("__dd_wsha"), "__dd_keep"), "winners")
    n = winners.count()
    hashed, same = docs.withColumn("__dd_sha", F.sha2(normalised(text_col), 256)), F.col("__dd_sha") == F.col("__dd_wsha")
    if n * ROW_BYTES <= LIST_BYTES:
        apart, joined = None, hashed.join(F.broadcast(winners), same, "left")
    elif (bits := pow2_at_least(16 * n)) <= 8 * filter_bytes:
        blocks = cut(bloom_blocks(winners, ["__dd_wsha"], bits), "bloom")
        marked = probe(hashed, blocks, bits)
        apart, joined = marked.where("not __dd_rep"), marked.where("__dd_rep").join(winners, same, "left")
    else:
        apart, joined = None, hashed.join(winners, same, "left")
    alone = joined.where("__dd_wsha is null").select(*docs.columns)
    first = joined.where(F.col("__dd_wsha").isNotNull() & F.col(id_col).eqNullSafe(F.col("__dd_keep"))).dropDuplicates(["__dd_sha"])
    out = alone.unionByName(first.select(*docs.columns))
    return out if apart is None else out.unionByName(apart.select(*docs.columns))
