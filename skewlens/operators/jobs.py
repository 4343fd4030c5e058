"""Stage <-> job lookups, kept as DataFrames so nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_job_pairs(jobs: DataFrame) -> DataFrame:
    """(app_id, stageId, jobId): one row per stage id listed by a job, duplicates kept."""
    return jobs.select("app_id", "jobId", F.explode("stageIds").alias("stageId")) \
               .select("app_id", "stageId", "jobId")


def jobs_by_stage(pairs: DataFrame) -> DataFrame:
    """(app_id, stageId, jobId) pairs -> one row per stage with its ascending job ids.

    A list holds one entry per job that lists the stage, so it is bounded by the
    app's job count; the aggregate is partial before the shuffle.
    """
    return (pairs.groupBy("app_id", "stageId")
                 .agg(F.array_sort(F.collect_list("jobId")).alias("jobIds")))


def stage_to_jobs(jobs: DataFrame) -> DataFrame:
    """Invert job -> stages into stage -> ascending list of job ids (no de-dup).

    A job may be stored as several records (same job fields, a slice of its stage ids
    each); exploding them gives the same pairs.
    """
    return jobs_by_stage(stage_job_pairs(jobs))


def stages_with_jobs(df: DataFrame, stage_jobs: DataFrame) -> DataFrame:
    """Keep rows whose (app_id, stageId) is referenced by some job (left semi join).

    The join strategy is left to adaptive execution: the referenced-stage side is
    measured at run time and broadcast only when it is small.
    """
    return df.join(stage_jobs.select("app_id", "stageId"), ["app_id", "stageId"], "left_semi")


def attach_job_ids(df: DataFrame, stage_jobs: DataFrame) -> DataFrame:
    """Add ``jobIds`` (empty list when no job lists the stage)."""
    return (df.join(stage_jobs.select("app_id", "stageId", "jobIds"), ["app_id", "stageId"], "left")
              .withColumn("jobIds", F.coalesce("jobIds", F.array().cast("array<int>"))))
