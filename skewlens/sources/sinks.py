"""Sinks: the text report, the structured result, and JSON rendering of stats rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewlens.operators.skew import rank_order

REPORT_SEPARATOR = "\n\n"


def stats_json(stats: DataFrame, keys=("app_id", "stageId", "attemptId")) -> DataFrame:
    """Each stats row rendered as compact JSON (all columns, in column order)."""
    body = [c for c in stats.columns if c != "app_id"]
    return stats.select(*keys, F.to_json(F.struct(*body)).alias("json"))


def write_report(report: DataFrame, path: str) -> None:
    """Write report blocks, ranked, separated by a blank line, overwriting ``path``.

    The sort is a range-partitioned shuffle, so part files concatenated in name order
    give the report in rank order; no single task or the driver holds the whole text.
    """
    (report.orderBy(*rank_order()).select("block")
           .write.mode("overwrite").option("lineSep", REPORT_SEPARATOR).text(path))


def write_task_table(tasks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist flat task rows as parquet, one folder per app.

    Parsing nested JSON is the most expensive step of an analysis; converting payloads once
    lets later analyses read only the columns they use, prune apps by folder and skip row
    groups by stage (rows are sorted by stage within each file, so min/max statistics are
    tight).  No shuffle: the sort is within the existing partitions.
    """
    # app_id first: the writer's required ordering (partition column) is already met.
    (tasks.sortWithinPartitions("app_id", "stageId", "attemptId", "taskId")
          .write.mode(mode).partitionBy("app_id").parquet(path))


#: What a bucketed task table is dealt by: with the task in it, a hot stage is spread over all buckets.
BUCKET_KEYS = ["stageId", "taskId"]


def write_bucketed_tasks(tasks: DataFrame, table: str, path: str, buckets: int) -> None:
    """Flat task rows as a catalog table by app, bucketed by stage and task.

    One exchange deals the rows out when the table is written, into one file per bucket and app.  Any de-duplication
    of what ``spark.table(table)`` reads then finds each task's rows in one place: its window and the partial
    statistics need no exchange of task rows, however often the table is analysed.  ``table`` must be a new name.
    """
    (tasks.repartition(buckets, *BUCKET_KEYS)
          .write.partitionBy("app_id").bucketBy(buckets, *BUCKET_KEYS).sortBy(*BUCKET_KEYS)
          .option("path", path).format("parquet").saveAsTable(table))


def convert_stages(stages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One pass over stage payloads: check required fields, explode, write task rows.

    Rows land in ``<path>/valid=true/app_id=<id>/`` (documents with every required field)
    or ``<path>/valid=false/...`` with ``missing`` naming the gaps (a malformed record keeps
    one row with NULL task fields).  Good and quarantined rows come out of the same scan of
    the JSON; ``read_task_table(spark, path, converted=True)`` reads the valid side.
    """
    from skewlens.operators.tasks import flat_task_columns
    from skewlens.schemas import STAGE_KEYS, STAGE_REQUIRED, TASK_REQUIRED
    from skewlens.sources.payloads import missing_fields

    tagged = stages.withColumn("missing", missing_fields(STAGE_REQUIRED, {"tasks": TASK_REQUIRED}))
    rows = tagged.select(
        "app_id", "stageId", "attemptId", F.col("name").alias("stageName"), F.col("status").alias("stageStatus"),
        "numTasks", "missing", F.explode_outer(F.map_values("tasks")).alias("task"))
    flat = rows.select(*STAGE_KEYS, *flat_task_columns("task"), "missing",
                       (F.size("missing") == 0).alias("valid"))
    # Leading with the partition columns satisfies the writer's required ordering, so no
    # second sort is planned and rows stay ordered by stage inside each file.
    (flat.sortWithinPartitions("valid", "app_id", "stageId", "attemptId", "taskId")
         .write.mode(mode).partitionBy("valid", "app_id").parquet(path))


def write_measures(measures: DataFrame, path: str) -> None:
    """The structured result (measures with nested metric list) as parquet by app."""
    measures.write.mode("overwrite").partitionBy("app_id").parquet(path)
