"""Declared schemas for job, stage-attempt and task payloads, and the flat task table.

Payloads follow the shape of Spark's monitoring REST API (``/applications/{id}/jobs``
and ``/applications/{id}/stages/{id}?details=true``).  Every reader passes one of these
schemas explicitly, so JSON is never sampled for inference and only declared fields are
parsed; extra payload fields are ignored.
"""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, STR = T.LongType(), T.IntegerType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


TASK_METRICS = _struct(
    executorRunTime=LONG,
    resultSize=LONG,
    jvmGcTime=LONG,
    peakExecutionMemory=LONG,
    inputMetrics=_struct(bytesRead=LONG, recordsRead=LONG),
    outputMetrics=_struct(bytesWritten=LONG, recordsWritten=LONG),
    shuffleReadMetrics=_struct(remoteBytesRead=LONG, localBytesRead=LONG, recordsRead=LONG),
    shuffleWriteMetrics=_struct(bytesWritten=LONG, writeTime=LONG, recordsWritten=LONG),
)

TASK = _struct(
    taskId=LONG,
    index=LONG,         # logical task within the stage (shared by its retries); optional
    attempt=LONG,
    launchTime=STR,
    duration=LONG,
    executorId=STR,
    host=STR,
    status=STR,
    taskMetrics=TASK_METRICS,
)

STAGE_ATTEMPT = _struct(
    stageId=LONG,
    attemptId=INT,
    name=STR,
    status=STR,
    numTasks=INT,
    numCompleteTasks=INT,
    numFailedTasks=INT,
    firstTaskLaunchedTime=STR,
    completionTime=STR,
    tasks=T.MapType(STR, TASK),
)

JOB = _struct(
    jobId=INT,
    name=STR,
    submissionTime=STR,
    completionTime=STR,
    stageIds=T.ArrayType(LONG),
)

# A stand-alone task list carries its stage keys next to each task (one JSON object per
# task); this is the splittable layout for large inputs.
TASK_RECORD = T.StructType(
    [T.StructField(n, t, True) for n, t in (("stageId", LONG), ("attemptId", INT))] + TASK.fields
)

CORRUPT = "_corrupt_record"

# Fields that must be present (non-null) for a record to be accepted.  Stage timestamps
# are the only optional payload fields.
JOB_REQUIRED = ["jobId", "name", "submissionTime", "completionTime", "stageIds"]
STAGE_REQUIRED = [
    "stageId", "attemptId", "name", "status", "numTasks",
    "numCompleteTasks", "numFailedTasks", "tasks",
]
TASK_REQUIRED = [
    "taskId", "attempt", "launchTime", "duration", "executorId", "host", "status",
    "taskMetrics.executorRunTime", "taskMetrics.resultSize", "taskMetrics.jvmGcTime",
    "taskMetrics.peakExecutionMemory",
    "taskMetrics.inputMetrics.bytesRead", "taskMetrics.inputMetrics.recordsRead",
    "taskMetrics.outputMetrics.bytesWritten", "taskMetrics.outputMetrics.recordsWritten",
    "taskMetrics.shuffleReadMetrics.remoteBytesRead",
    "taskMetrics.shuffleReadMetrics.localBytesRead",
    "taskMetrics.shuffleReadMetrics.recordsRead",
    "taskMetrics.shuffleWriteMetrics.bytesWritten",
    "taskMetrics.shuffleWriteMetrics.writeTime",
    "taskMetrics.shuffleWriteMetrics.recordsWritten",
]

def narrowed(struct: T.StructType, paths: list[str]) -> T.StructType:
    """The fields of ``struct`` that ``paths`` name (``a.b``: field b of a, or of the values of a map a)."""
    out = []
    for f in struct.fields:
        below = [p[len(f.name) + 1:] for p in paths if p.startswith(f"{f.name}.")]
        if f.name in paths:
            out.append(f)
        elif below and isinstance(f.dataType, T.MapType):
            out.append(T.StructField(f.name, T.MapType(f.dataType.keyType, narrowed(f.dataType.valueType, below)), True))
        elif below:
            out.append(T.StructField(f.name, narrowed(f.dataType, below), True))
    return T.StructType(out)


# What the statistics use of a stage attempt.
STATS_PATHS = ["stageId", "attemptId", "name", "status", "numTasks"] + [f"tasks.{p}" for p in (
    "taskId", "attempt", "status", "duration", "taskMetrics.inputMetrics.bytesRead", "taskMetrics.outputMetrics.bytesWritten",
    "taskMetrics.shuffleReadMetrics.remoteBytesRead", "taskMetrics.shuffleReadMetrics.localBytesRead",
    "taskMetrics.shuffleWriteMetrics.bytesWritten")]

# Keys identifying one stage attempt; every table carries ``app_id`` first.
STAGE_KEYS = ["app_id", "stageId", "attemptId", "stageName", "stageStatus", "numTasks"]

# The five measured metrics, in report order.
METRICS = ["duration", "bytesRead", "bytesWritten", "shuffleBytesRead", "shuffleBytesWritten"]

# The flat task table: stage keys + task columns carried into de-duplication.
FLAT_TASK_COLUMNS = STAGE_KEYS + [
    "taskId", "attempt", "status", "duration", "resultSize", "jvmGcTime",
    "bytesRead", "bytesWritten", "shuffleBytesRead", "shuffleBytesWritten",
]
