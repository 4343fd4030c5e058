"""Helpers shared by the operators: table access, lineage cuts, shared-folder files, hashing."""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skewlens.session import open_fs, ship_package, written

# The white space of every text contract: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["SPACE", "WORD", "cut", "fresh", "open_fs", "pow2_at_least", "release", "remembered", "shards_of", "ship_package",
           "table", "text_of"]

_slot: list = [None, None]


def remembered(shared, make):
    """``make(shared.value)``, kept by this Python worker for the tasks that share the broadcast value, and for no others."""
    if _slot[0] is not shared.value:
        release()
        _slot[:] = shared.value, make(shared.value)
    return _slot[1]


def release() -> None:
    """Forget what an earlier task left in this worker, and give freed memory back to the system.

    Workers outlive their stage, and an executor's memory holds all of them.
    """
    _slot[:] = None, None
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def fresh(batches: Iterable, *memos: dict) -> Iterator:
    """The batches of a task that keeps nothing for later ones; its ``memos`` are emptied at its end."""
    release()
    yield from batches
    for memo in memos:
        memo.clear()
    release()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: a lineage cut that survives lost executors."""
    return written(df, name)


def text_of(col: str | Column) -> Column:
    """A text with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def pow2_at_least(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n))))


def shards_of(spark: SparkSession, least: int = 8) -> int:
    """Partition count for hand-dealt data: that of the session's shuffles, which the caller sizes to the input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
