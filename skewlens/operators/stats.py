"""Per-group statistics: average and maximum of each measured column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewlens.operators.exact_sum import LIMBS, bucket, finite, limbs, total, whole_number
from skewlens.schemas import METRICS, STAGE_KEYS


def exact_avg(col: str | Column) -> Column:
    """sum/count on an integral column: the sum is exact, so both engines agree bit for bit."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c) / F.count(c)


def group_skew_stats(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per group with ``avg_<m>`` (double) and ``max_<m>`` for every metric.

    All aggregates are algebraic, so each is computed partially before the shuffle:
    a group holding a third of the rows costs one partial row per input partition.  Sums of doubles are exact
    (``operators.exact_sum``), so an average does not depend on the order or the partitions of the rows.
    """
    real = [m for m in metrics if isinstance(df.schema[m].dataType, (T.DoubleType, T.FloatType))]
    if real:
        return _real_stats(df, keys, metrics, real)
    aggs = []
    for m in metrics:
        aggs += [exact_avg(m).alias(f"avg_{m}"), F.max(m).alias(f"max_{m}")]
    return df.groupBy(*keys).agg(*aggs)


def _real_stats(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], real: Sequence[str]) -> DataFrame:
    """:func:`group_skew_stats` with double metrics: limbs per magnitude, then one row per group."""
    x = {m: F.col(m).cast("double") for m in real}
    df = df.select(*keys, *metrics, *[bucket(x[m]).alias(f"_b_{m}") for m in real])
    df = df.select("*", *[c.alias(f"_{i}_{m}") for m in real for i, c in enumerate(limbs(x[m], F.col(f"_b_{m}")))])
    first, last = [], []
    for m in metrics:
        first += [F.count(m).alias(f"_n_{m}"), F.max(m).alias(f"_max_{m}")]
        if m in real:
            first += [F.sum(f"_{i}_{m}").alias(f"_{i}_{m}") for i in range(LIMBS)]
            # Infinities and NaN give the same sum in any order.
            first.append(F.sum(F.when(~finite(x[m]), x[m])).alias(f"_odd_{m}"))
            number = whole_number([F.col(f"_{i}_{m}") for i in range(LIMBS)])
            parts = F.collect_list(F.struct(F.col(f"_b_{m}").alias("b"), number.alias("s")))
            whole = F.coalesce(F.sum(f"_odd_{m}"), total(parts))
        else:
            first.append(F.sum(m).alias(f"_sum_{m}"))
            whole = F.sum(f"_sum_{m}")
        n = F.sum(f"_n_{m}")
        last += [F.when(n > 0, whole / n).alias(f"avg_{m}"), F.max(f"_max_{m}").alias(f"max_{m}")]
    return df.groupBy(*keys, *[f"_b_{m}" for m in real]).agg(*first).groupBy(*keys).agg(*last)


def _cap(name: str) -> str:
    return name[0].upper() + name[1:]


def stage_partials(tasks: DataFrame, keys: Sequence[str] = STAGE_KEYS) -> DataFrame:
    """Per stage attempt: ``sum_<m>``, ``n_<m>`` and ``max_<m>`` of every metric.

    Partials of disjoint task sets merge exactly (``merge_partials``).
    """
    aggs = []
    for m in METRICS:
        aggs += [F.sum(m).alias(f"sum_{m}"), F.count(m).alias(f"n_{m}"), F.max(m).alias(f"max_{m}")]
    return tasks.groupBy(*keys).agg(*aggs)


def merge_partials(partials: DataFrame) -> DataFrame:
    """Combine partials of the same stage attempt (sums add up, maxima take the largest)."""
    aggs = []
    for m in METRICS:
        aggs += [F.sum(f"sum_{m}").alias(f"sum_{m}"), F.sum(f"n_{m}").alias(f"n_{m}"),
                 F.max(f"max_{m}").alias(f"max_{m}")]
    return partials.groupBy(*STAGE_KEYS).agg(*aggs)


def finalize_stats(partials: DataFrame) -> DataFrame:
    """Partials -> the statistics columns.

    ``avgDuration`` is the exact mean in seconds (double).  ``maxDuration`` is the longest
    task in whole seconds, truncated; since truncation is monotone, truncating the
    maximum equals the maximum of truncated values.
    """
    byte_cols = []
    for m in METRICS[1:]:
        byte_cols += [(F.col(f"sum_{m}") / F.col(f"n_{m}")).alias(f"avg{_cap(m)}"),
                      F.col(f"max_{m}").alias(f"max{_cap(m)}")]
    return partials.select(
        *STAGE_KEYS,
        (F.col("sum_duration") / F.col("n_duration") / 1000).alias("avgDuration"),
        F.expr("max_duration div 1000").alias("maxDuration"),
        *byte_cols,
    )


def stage_stats(tasks: DataFrame) -> DataFrame:
    """Per stage attempt: average and maximum duration (seconds) and byte counters."""
    return finalize_stats(stage_partials(tasks))


STATS_COLUMNS = STAGE_KEYS + [
    "avgDuration", "maxDuration", "avgBytesRead", "maxBytesRead", "avgBytesWritten",
    "maxBytesWritten", "avgShuffleBytesRead", "maxShuffleBytesRead",
    "avgShuffleBytesWritten", "maxShuffleBytesWritten",
]

# Metric display names, in report order, with their statistics columns
# and unit: (metric label, avg column, max column, unit).
STAT_METRICS = [
    ("Duration (HH:mm:ss)", "avgDuration", "maxDuration", "seconds"),
    ("Bytes Read", "avgBytesRead", "maxBytesRead", "bytes"),
    ("Bytes Written", "avgBytesWritten", "maxBytesWritten", "bytes"),
    ("Shuffle Bytes Read", "avgShuffleBytesRead", "maxShuffleBytesRead", "bytes"),
    ("Shuffle Bytes Written", "avgShuffleBytesWritten", "maxShuffleBytesWritten", "bytes"),
]
