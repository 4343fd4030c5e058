"""Composed analyses: payloads -> statistics -> ranked skew report.

Plans are lazy, but for ``analyze_tasks`` (and ``analyze``): they write the ids of the listed stages, to measure them, and
the per-stage statistics once to the checkpoint folder before returning the report plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewlens.functions.format import stage_block
from skewlens.operators.jobs import attach_job_ids, stage_to_jobs
from skewlens.operators.reduce import may_match
from skewlens.operators.skew import DEFAULT_THRESHOLD, stage_skew
from skewlens.operators.stats import stage_stats
from skewlens.operators.tasks import dedup_tasks, explode_tasks
from skewlens.schemas import METRICS, STAGE_KEYS
from skewlens.session import written
from skewlens.sources.payloads import required_jobs, required_stages


def stats_from_tasks(tasks: DataFrame, task_key: str = "taskId") -> DataFrame:
    """Flat task rows -> one attempt per task -> per-stage-attempt statistics.

    Only the columns the statistics need cross the de-duplication shuffle; the
    tie-breakers are then the metrics themselves, so the result stays deterministic
    when a lost partition is recomputed.
    """
    needed = STAGE_KEYS + [task_key, "attempt", "status"] + METRICS
    return stage_stats(dedup_tasks(tasks.select(*needed), task_key))


def stats_from_stages(stages: DataFrame, mode: str = "fail") -> DataFrame:
    """Stage-attempt payloads -> statistics (explode, de-duplicate, aggregate).

    ``mode="fail"``: a malformed or incomplete document fails the action.  ``mode="trusted"``: the documents were
    checked before (``required_stages``, whose quarantine mode also returns the bad ones); then they may have been read with
    the statistics' fields only (``read_stages(..., paths=STATS_PATHS)``).
    """
    used = ["taskId", "attempt", "status", *METRICS]
    return stats_from_tasks(explode_tasks(_checked(stages, required_stages, mode), columns=used))


def _checked(payloads: DataFrame, check, mode: str) -> DataFrame:
    if mode not in ("fail", "trusted"):
        raise ValueError(f"unknown mode {mode!r}")
    return check(payloads, "fail") if mode == "fail" else payloads


def with_report_block(measures: DataFrame) -> DataFrame:
    """Add the rendered text block of each measure."""
    return measures.withColumn("block", stage_block(
        F.col("stageId"), F.col("attemptId"), F.col("jobIds"), F.col("taskCount"),
        F.col("stageStatus"), F.col("stageName"), F.col("taskAgg")))


STAGE_ID = ["app_id", "stageId"]


def analyze_tasks(tasks: DataFrame, stage_jobs: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                  only_job_stages: bool = True, ordered: bool = True, reduce: bool = True) -> DataFrame:
    """Flat task rows + stage->jobs -> ranked measures with their report block.

    Task rows of stages that no job lists go before the de-duplication shuffle (``reduce=False``: they went before; see
    ``operators.reduce``).  The per-stage statistics (one row per stage attempt) are written
    once to the session's checkpoint folder: the gate, the skew filter and the report all
    read them, so the task-level shuffle runs once and a lost executor does not re-run it.
    ``ordered=False`` leaves out the sort, for sinks that have no order.
    """
    if only_job_stages and reduce:
        tasks = may_match(tasks, stage_jobs, STAGE_ID)
    # Job ids are attached to the per-stage statistics, a table orders of magnitude smaller
    # than the tasks; keeping only stages some job lists is then a filter on that column.
    # Restricting the statistics equals restricting the task rows (stageId is a grouping key), so
    # what the reduction lets pass goes here.
    stats = attach_job_ids(stats_from_tasks(tasks), stage_jobs)
    if only_job_stages:
        stats = stats.filter(F.size("jobIds") > 0)
    stats = written(stats, "stats")
    # Sort the compact measures, then render: the range-partitioned sort samples its input
    # before shuffling it, and the text would otherwise be built on both passes.
    return with_report_block(stage_skew(stats, stage_jobs, threshold, ordered, copy=False))


def analyze(jobs: DataFrame, stages: DataFrame, threshold: float = DEFAULT_THRESHOLD, mode: str = "fail") -> DataFrame:
    """Job + stage-attempt payloads -> ranked skewed stages with the report text.

    Only stages listed by some job are analysed; each measure carries its job ids.  ``mode`` as in
    :func:`stats_from_stages`: nothing is dropped unseen.
    """
    stage_jobs = stage_to_jobs(_checked(jobs, required_jobs, mode))
    # Documents of stages that no job lists go before their tasks are exploded; in mode "fail" they are checked nevertheless.
    listed = may_match(_checked(stages, required_stages, mode), stage_jobs, STAGE_ID)
    return analyze_tasks(explode_tasks(listed), stage_jobs, threshold, reduce=False)
