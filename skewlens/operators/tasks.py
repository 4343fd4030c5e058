"""Stage-attempt payloads -> flat task rows, and attempt de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewlens.schemas import FLAT_TASK_COLUMNS, STAGE_KEYS

TASK_COLUMNS = [c for c in FLAT_TASK_COLUMNS if c not in STAGE_KEYS]


def project_stage(stages: DataFrame) -> DataFrame:
    """Keep the stage keys and the task map; ``name``/``status`` become stage-prefixed."""
    return stages.select(
        "app_id", "stageId", "attemptId",
        F.col("name").alias("stageName"), F.col("status").alias("stageStatus"),
        "numTasks", "tasks",
    )


def derive_shuffle_read(remote: Column, local: Column) -> Column:
    """Shuffle bytes read = remote + local bytes read."""
    return remote + local


def flat_task_columns(task: str | None = "task") -> list[Column]:
    """The ten task columns of the flat table, lifted out of a task struct column
    (``task=None``: the task fields are top-level columns)."""
    p = f"{task}." if task else ""
    m = f"{p}taskMetrics"
    return [
        F.col(f"{p}taskId").alias("taskId"),
        F.col(f"{p}attempt").alias("attempt"),
        F.col(f"{p}status").alias("status"),
        F.col(f"{p}duration").alias("duration"),
        F.col(f"{m}.resultSize").alias("resultSize"),
        F.col(f"{m}.jvmGcTime").alias("jvmGcTime"),
        F.col(f"{m}.inputMetrics.bytesRead").alias("bytesRead"),
        F.col(f"{m}.outputMetrics.bytesWritten").alias("bytesWritten"),
        derive_shuffle_read(F.col(f"{m}.shuffleReadMetrics.remoteBytesRead"),
                            F.col(f"{m}.shuffleReadMetrics.localBytesRead")).alias("shuffleBytesRead"),
        F.col(f"{m}.shuffleWriteMetrics.bytesWritten").alias("shuffleBytesWritten"),
    ]


def explode_tasks(stages: DataFrame, with_index: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """One flat row per (stage attempt, task).

    The explode is an inner one: an attempt without tasks yields no rows, exactly as
    the analysis expects.  Map keys (task ids as text) are dropped; values are kept.
    ``with_index`` appends the task's ``index`` (for ``dedup_tasks(task_key="index")``).  ``columns`` names the task
    columns to keep, for documents that were read with a narrowed schema.
    """
    exploded = project_stage(stages).select(
        *STAGE_KEYS, F.explode(F.map_values("tasks")).alias("task"))
    extra = [F.col("task.index").alias("index")] if with_index else []
    kept = [c for name, c in zip(TASK_COLUMNS, flat_task_columns("task")) if columns is None or name in columns]
    return exploded.select(*STAGE_KEYS, *kept, *extra)


def flatten_task_records(records: DataFrame) -> DataFrame:
    """Task-list records (one task object per row, stage ids alongside) -> flat rows.

    A bare task list names its stage attempt but carries no stage name, status or task
    count, so the result has ``app_id, stageId, attemptId`` and the ten task columns.
    """
    return records.select("app_id", "stageId", "attemptId", *flat_task_columns(None))


def status_rank(status: Column) -> Column:
    """1 for a successful attempt, 2 for anything else (NULL included)."""
    return F.when(status.like("SUCCESS"), F.lit(1)).otherwise(F.lit(2))


def latest_attempt(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                   prefer: Column | None = None) -> DataFrame:
    """Keep one row per ``keys``: rows where ``prefer`` is true first (NULL counts as
    false), then the first under ``order`` (a total order gives a deterministic pick).

    ``row_number() = 1`` lets Catalyst insert a partial WindowGroupLimit before the shuffle,
    so a key repeated across many input partitions sends at most one row per partition.
    """
    if prefer is not None:
        order = [F.when(prefer, F.lit(1)).otherwise(F.lit(2)).asc(), *order]
    window = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(window))
              .filter(F.col("_rn") == 1)
              .drop("_rn"))


def _earlier(df: DataFrame, name: str, descending: bool) -> Column:
    """A struct that is the smaller, the earlier ``name`` comes in a window's order (ascending: NULL first, descending: last)."""
    c, kind = F.col(name), df.schema[name].dataType
    if not descending:
        return F.struct(c.isNotNull(), c)
    if isinstance(kind, T.TimestampNTZType):
        c = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', `{name}`)")
    elif isinstance(kind, T.TimestampType):
        c = F.unix_micros(c)
    elif isinstance(kind, T.DateType):
        c = F.unix_date(c)
    elif isinstance(kind, T.BooleanType):
        c = c.cast("int")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.struct(c.isNull(), ~F.isnan(c), -c)
    elif not isinstance(kind, T.IntegralType):
        raise ValueError(f"no descending order of {kind.simpleString()} in an aggregate; rank {name} by a number")
    return F.struct(F.col(name).isNull(), F.bitwise_not(c))          # unlike a minus, without overflow


def latest_by_aggregate(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]],
                        prefer: Column | None = None) -> DataFrame:
    """The same rows as :func:`latest_attempt`, as a mergeable aggregate: the least order struct wins its key.

    ``order`` names columns and whether they descend.  The aggregate is partial before the shuffle, and the result of two
    disjoint inputs is that of their two results put together, so batches can be reduced one by one
    (``streaming``).  Rows that are equal in the whole order are interchangeable only if the order is total.
    """
    first = [] if prefer is None else [~F.coalesce(prefer, F.lit(False))]
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*first, *[_earlier(df, c, down) for c, down in order]))
    return df.groupBy(*keys).agg(best.alias("_best")).select(
        *[F.col(f"_best.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def dedup_order(tasks: DataFrame, keys: Sequence[str]) -> list[tuple[str, bool]]:
    """The order of :func:`dedup_tasks` after the status: the latest attempt, then the other columns as tie-breakers."""
    return [("attempt", True)] + [(c, False) for c in tasks.columns if c not in keys and c != "attempt"]


def merge_tasks(tasks: DataFrame, keys: Sequence[str] = (*STAGE_KEYS, "taskId")) -> DataFrame:
    """:func:`dedup_tasks` as a mergeable aggregate (see :func:`latest_by_aggregate`)."""
    return latest_by_aggregate(tasks, keys, dedup_order(tasks, keys), F.col("status") == "SUCCESS")


def dedup_tasks(tasks: DataFrame, task_key: str = "taskId") -> DataFrame:
    """One row per task of a stage attempt: a successful attempt first, then the latest.

    ``task_key`` names the column that identifies a task within an attempt: ``taskId``
    (default, as the original analysis) or ``index`` (rows from ``explode_tasks(...,
    with_index=True)``), which also folds retries that Spark gave new task ids.
    Remaining columns break ties so the pick never depends on input order, and a
    partition recomputed after an executor loss picks the same rows.
    """
    # Same key set as STAGE_KEYS + task key; high-cardinality integers first so the sort
    # that feeds the window compares on a selective 8-byte prefix (a 25 % faster sort at
    # 10 M rows than with the low-cardinality app id first).
    keys = ["stageId", task_key, "attemptId"] + [k for k in STAGE_KEYS if k not in ("stageId", "attemptId")]
    rest = [c for c in tasks.columns if c not in keys and c != "attempt"]
    order = [status_rank(F.col("status")).asc(), F.col("attempt").desc()] + [F.col(c).asc() for c in rest]
    return latest_attempt(tasks, keys, order).select(*tasks.columns)


# Every decoded task field: (output name, path inside the task struct).  Fixed values: the field names of the
# monitoring REST API.
TASK_FIELD_PATHS = [
    ("taskId", "taskId"), ("attempt", "attempt"), ("launchTime", "launchTime"), ("duration", "duration"),
    ("executorId", "executorId"), ("host", "host"), ("status", "status"),
    ("executorRunTime", "taskMetrics.executorRunTime"), ("resultSize", "taskMetrics.resultSize"),
    ("jvmGcTime", "taskMetrics.jvmGcTime"), ("peakExecutionMemory", "taskMetrics.peakExecutionMemory"),
    ("bytesRead", "taskMetrics.inputMetrics.bytesRead"),
    ("recordsRead", "taskMetrics.inputMetrics.recordsRead"),
    ("bytesWritten", "taskMetrics.outputMetrics.bytesWritten"),
    ("recordsWritten", "taskMetrics.outputMetrics.recordsWritten"),
    ("shuffleRemoteBytesRead", "taskMetrics.shuffleReadMetrics.remoteBytesRead"),
    ("shuffleLocalBytesRead", "taskMetrics.shuffleReadMetrics.localBytesRead"),
    ("shuffleRecordsRead", "taskMetrics.shuffleReadMetrics.recordsRead"),
    ("shuffleBytesWritten", "taskMetrics.shuffleWriteMetrics.bytesWritten"),
    ("shuffleWriteTime", "taskMetrics.shuffleWriteMetrics.writeTime"),
    ("shuffleRecordsWritten", "taskMetrics.shuffleWriteMetrics.recordsWritten"),
]


def task_fields(task: str = "task") -> list[Column]:
    """All 21 decoded task fields, flattened out of three levels of nesting."""
    return [F.col(f"{task}.{path}").alias(name) for name, path in TASK_FIELD_PATHS]


def explode_task_fields(stages: DataFrame) -> DataFrame:
    """Stage attempts -> one row per task with stage ids and all 21 task fields."""
    return (stages.select("app_id", "stageId", "attemptId", F.explode(F.map_values("tasks")).alias("task"))
                  .select("app_id", "stageId", "attemptId", *task_fields("task")))
