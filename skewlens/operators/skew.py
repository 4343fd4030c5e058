"""Significance gate, skew predicate, per-metric flags, ratio and the ranked stage measure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewlens.functions.format import display_ratio
from skewlens.operators.jobs import attach_job_ids
from skewlens.operators.stats import STAT_METRICS
from skewlens.session import written

# Fixed values of the analysis.
DEFAULT_THRESHOLD = 3.0
GATE_ABSOLUTE_SECONDS = 60      # a stage whose longest task runs >= 60 s always counts
GATE_RELATIVE_SHARE = 0.2       # ... or >= 0.2 x the longest task of the whole app


def app_max_duration(stats: DataFrame) -> DataFrame:
    """Longest ``maxDuration`` per app (one row per app, partial-aggregated)."""
    return stats.groupBy("app_id").agg(F.max("maxDuration").alias("maxDurationAllStages"))


def with_significance(stats: DataFrame, copy: bool = True) -> DataFrame:
    """Add ``maxDurationAllStages`` and ``isSignificant`` (the gate), per app.

    The statistics are written once (``copy=False``: they are a copy already), so that the maximum does not compute
    them a second time.  It is joined back on ``app_id``; adaptive execution turns this into
    a broadcast join once the per-app side is measured small, and otherwise splits a
    skewed app's partition.  An app with no stages simply has no rows.
    """
    stats = written(stats, "stats") if copy else stats
    joined = stats.join(app_max_duration(stats), "app_id")
    gate = ((F.col("maxDuration") >= GATE_ABSOLUTE_SECONDS)
            | (F.col("maxDuration") >= F.lit(GATE_RELATIVE_SHARE) * F.col("maxDurationAllStages")))
    return joined.withColumn("isSignificant", gate)


def skew_predicate(threshold: float, pairs: Sequence[tuple[str, str]] | None = None) -> Column:
    """Any metric whose maximum exceeds ``threshold`` x its (untruncated) average."""
    pairs = pairs or [(avg, mx) for _, avg, mx, _ in STAT_METRICS]
    clauses = [F.col(mx) > F.lit(float(threshold)) * F.col(avg) for avg, mx in pairs]
    out = clauses[0]
    for c in clauses[1:]:
        out = out | c
    return out


def flag_skew(stats: DataFrame, pairs: Sequence[tuple[str, str]], threshold: float = DEFAULT_THRESHOLD,
              gate: Column | None = None) -> DataFrame:
    """Generic filter: rows where some ``max > threshold * avg`` (and the gate, if given)."""
    cond = skew_predicate(threshold, pairs)
    return stats.filter(cond if gate is None else gate & cond)


def skewed_stages(stats: DataFrame, threshold: float = DEFAULT_THRESHOLD, copy: bool = True) -> DataFrame:
    """Stage attempts that pass the significance gate and show skew on any metric.

    The statistics are written once (``copy=False``: they are a copy already).  A stage whose longest task takes
    ``GATE_ABSOLUTE_SECONDS`` passes whatever its app's maximum is; only the skewed stages below that are joined with it.
    """
    stats = written(stats, "stats") if copy else stats
    skewed = flag_skew(stats, [(a, m) for _, a, m, _ in STAT_METRICS], threshold)
    decided = skewed.where(F.col("maxDuration") >= GATE_ABSOLUTE_SECONDS)
    open_ = skewed.where(F.col("maxDuration") < GATE_ABSOLUTE_SECONDS).join(app_max_duration(stats), "app_id")
    passed = open_.where(F.col("maxDuration") >= F.lit(GATE_RELATIVE_SHARE) * F.col("maxDurationAllStages"))
    return decided.unionByName(passed.select(*stats.columns))


def metric_flag(avg: str, mx: str, unit: str, threshold: float) -> Column:
    """Per-metric flag: duration compares against the exact average, byte metrics
    against the average truncated to a whole number of bytes."""
    base = F.col(avg) if unit == "seconds" else F.col(avg).cast("long")
    return F.col(mx) > F.lit(float(threshold)) * base


FLAG_NAMES = ["durationSkewed", "bytesReadSkewed", "bytesWrittenSkewed",
              "shuffleBytesReadSkewed", "shuffleBytesWrittenSkewed"]


def metric_flags(stats: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    return stats.select(*stats.columns, *[
        metric_flag(avg, mx, unit, threshold).alias(name)
        for name, (_, avg, mx, unit) in zip(FLAG_NAMES, STAT_METRICS)])


def skew_ratio(max_col: str = "maxDuration", avg_col: str = "avgDuration") -> Column:
    """max / avg as double; NaN when the average is 0 (0/0), as JVM arithmetic gives."""
    return F.when(F.col(avg_col) != 0, F.col(max_col) / F.col(avg_col)) \
            .otherwise(F.lit(float("nan")))


def metric_aggregates(threshold: float = DEFAULT_THRESHOLD) -> Column:
    """array<struct<metric, unit, avg, max, isSkewed, displayRatio>> in report order.

    ``avg`` is truncated to whole seconds / bytes, as printed; ``displayRatio`` divides
    the printed values.
    """
    items = []
    for name, avg, mx, unit in STAT_METRICS:
        avg_whole = F.col(avg).cast("long")
        items.append(F.struct(
            F.lit(name).alias("metric"),
            F.lit(unit).alias("unit"),
            avg_whole.alias("avg"),
            F.col(mx).cast("long").alias("max"),
            metric_flag(avg, mx, unit, threshold).alias("isSkewed"),
            display_ratio(F.col(mx), avg_whole).alias("displayRatio"),
        ))
    return F.array(*items)


def metric_long(stats: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                keys: Sequence[str] = ("app_id", "stageId", "attemptId")) -> DataFrame:
    """Long form: one row per stage attempt x metric."""
    return (stats.select(*keys, F.posexplode(metric_aggregates(threshold)).alias("metricIndex", "m"))
                 .select(*keys, "metricIndex", "m.*"))


def rank_order() -> list[Column]:
    """Highest ``skewRatio`` first; negating keeps NaN last (``desc()`` would put it first)."""
    return [(-F.col("skewRatio")).asc(), F.col("app_id").asc(), F.col("stageId").asc(),
            F.col("attemptId").asc()]


def stage_skew(stats: DataFrame, stage_jobs: DataFrame, threshold: float = DEFAULT_THRESHOLD,
               ordered: bool = True, copy: bool = True) -> DataFrame:
    """Skewed stage attempts as measures, highest duration skew first (NaN last).

    ``stats`` may already carry ``jobIds`` (see ``analyze_tasks``); otherwise they are
    attached to the few skewed rows only.  ``copy`` as in :func:`skewed_stages`.
    """
    skewed = skewed_stages(stats, threshold, copy)
    if "jobIds" not in skewed.columns:
        skewed = attach_job_ids(skewed, stage_jobs)
    measures = skewed.select(
        "app_id", "stageId", "stageName", "attemptId", "stageStatus", "jobIds",
        F.lit(0).cast("long").alias("stageDuration"),
        F.col("numTasks").alias("taskCount"),
        skew_ratio().alias("skewRatio"),
        metric_aggregates(threshold).alias("taskAgg"),
    )
    return measures.orderBy(*rank_order()) if ordered else measures
