"""Mapping of the driver's test tables onto the task-metrics model.

The ``events`` table stands in for task-end records: a user is a stage, a day of month
decides the stage attempt, an event is one task attempt.  Everything is derived by Spark
from the table, so the work grows with it.

Fixed values of the mapping (shared with the DuckDB oracle):
  app_id     = 'app-' || user_id % 3
  stageId    = user_id;  attemptId = 1 if day(ts) > 15 else 0
  stageName  = 'stage ' || user_id;  stageStatus = 'COMPLETE';  numTasks = 100
  taskId     = props.k;  attempt = event_id;  status = 'FAILED' for 'error' events else 'SUCCESS'
  duration   = round(value * 1000) ms;  bytesRead = round(value * value * 100)
  bytesWritten = k * 1024;  remote shuffle read = round(value * 1000) for 'purchase' else 0
  local shuffle read = k * 100 for 'view' else 0;  shuffleBytesWritten = 1 for 'view' else k * 10 + 2
  resultSize = k * 8;  jvmGcTime = round(value * 50);  recordsRead = k * 3 + 1;  recordsWritten = k * 5 + 2
  shuffleRecordsRead = k * 7 + 3;  writeTime = k * 11 + 4;  shuffleRecordsWritten = k * 13 + 5
The ``gate`` view uses attemptId = (day(ts) - 1) div 3, duration = round(value * 100) and
bytesWritten = k % 10.  Jobs: one per (app, day) with jobId = day and the sorted distinct
users with a 'signup' event that day as stage ids.  The ``large`` jobs view lists only the
users with a signup of value >= 300 that day, so most stages have no job in it.
The ``bare`` stage payloads also have an attempt 2 without tasks ('PENDING') of each user with a 'signup' event.
The ``broken`` lines are those of the damaged view (executorId missing for value >= 300) with these faults:
  stageId % 5 = 0: every duration is a string;  stageId % 7 = 0: no numTasks;  stageId % 11 = 0: status is a number
  stageId % 13 = 0: the line ends too early;  jobId % 5 = 0: no completionTime;  jobId % 7 = 0: jobId is a string
  jobId % 11 = 0: stageIds is a string
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from skewlens.operators.tasks import derive_shuffle_read
from skewlens.schemas import STAGE_KEYS
from skewlens.session import open_fs, path_exists, scratch_path, ship_package

LAUNCH_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'GMT'"

# Declared schemas of the driver tables used here (no footer scan to infer them).
TABLE_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz"),
}


def read_table(spark: SparkSession, sf_dir: str, name: str, scan_partitions: int | None = None) -> DataFrame:
    """Read a driver table with its declared schema.

    ``scan_partitions`` spreads the rows of a table stored as one row group over that many partitions; it is
    the caller's choice and never derived from the data or the cluster.
    """
    reader = spark.read.schema(TABLE_SCHEMAS[name]) if name in TABLE_SCHEMAS else spark.read
    df = reader.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(scan_partitions) if scan_partitions else df


def _round_long(x: Column) -> Column:
    return F.round(x).cast("long")


def _with_k(events: DataFrame) -> DataFrame:
    """Parse ``props.k`` once per row; every derived field reads the parsed column."""
    return events.select("event_id", "ts", "user_id", "event_type", "value",
                         F.get_json_object("props", "$.k").cast("long").alias("k"))


def _stage_columns(view: str) -> dict[str, Column]:
    day = F.dayofmonth("ts")
    attempt_id = (day > 15).cast("int") if view == "task" else F.floor((day - 1) / 3).cast("int")
    return {
        "app_id": F.concat(F.lit("app-"), (F.col("user_id") % 3).cast("string")),
        "stageId": F.col("user_id"),
        "attemptId": attempt_id,
        "stageName": F.concat(F.lit("stage "), F.col("user_id").cast("string")),
        "stageStatus": F.lit("COMPLETE"),
        "numTasks": F.lit(100),
    }


def _task_columns(view: str, damaged: bool = False, event: Column | None = None) -> dict[str, Column]:
    """Every task field as an expression over one event row (names as in the payload), or over the struct ``event``."""
    if view not in ("task", "gate"):
        raise ValueError(view)
    of = F.col if event is None else event.getField
    k, v, et = of("k"), of("value"), of("event_type")
    executor = F.concat(F.lit("exec-"), (k % 8).cast("string"))
    if damaged:
        executor = F.when(v >= 300, F.lit(None).cast("string")).otherwise(executor)
    return {
        "taskId": k,
        "attempt": of("event_id"),
        "launchTime": F.date_format(of("ts"), LAUNCH_FORMAT),
        "duration": _round_long(v * 1000) if view == "task" else _round_long(v * 100),
        "executorId": executor,
        "host": F.concat(F.lit("host-"), (k % 4).cast("string")),
        "status": F.when(et == "error", F.lit("FAILED")).otherwise(F.lit("SUCCESS")),
        "executorRunTime": _round_long(v * 900),
        "resultSize": k * 8,
        "jvmGcTime": _round_long(v * 50),
        "peakExecutionMemory": k * 4096,
        "bytesRead": _round_long(v * v * 100),
        "recordsRead": k * 3 + 1,
        "bytesWritten": k * 1024 if view == "task" else k % 10,
        "recordsWritten": k * 5 + 2,
        "remoteBytesRead": F.when(et == "purchase", _round_long(v * 1000)).otherwise(F.lit(0)).cast("long"),
        "localBytesRead": F.when(et == "view", k * 100).otherwise(F.lit(0)).cast("long"),
        "shuffleRecordsRead": k * 7 + 3,
        "shuffleBytesWritten": F.when(et == "view", F.lit(1)).otherwise(k * 10 + 2).cast("long"),
        "writeTime": k * 11 + 4,
        "shuffleRecordsWritten": k * 13 + 5,
    }


def payload_task(view: str = "task", damaged: bool = False, event: Column | None = None) -> Column:
    """A struct shaped like the payload's task, over one event row or over the struct ``event``.

    ``damaged=True`` drops ``executorId`` from tasks of events with ``value >= 300``
    (a rare, data-driven fault used to exercise the required-field check).
    """
    t = _task_columns(view, damaged, event)
    return F.struct(
        *[t[n].alias(n) for n in ("taskId", "attempt", "launchTime", "duration", "executorId", "host", "status")],
        F.struct(
            *[t[n].alias(n) for n in ("executorRunTime", "resultSize", "jvmGcTime", "peakExecutionMemory")],
            F.struct(t["bytesRead"].alias("bytesRead"), t["recordsRead"].alias("recordsRead")).alias("inputMetrics"),
            F.struct(t["bytesWritten"].alias("bytesWritten"),
                     t["recordsWritten"].alias("recordsWritten")).alias("outputMetrics"),
            F.struct(t["remoteBytesRead"].alias("remoteBytesRead"), t["localBytesRead"].alias("localBytesRead"),
                     t["shuffleRecordsRead"].alias("recordsRead")).alias("shuffleReadMetrics"),
            F.struct(t["shuffleBytesWritten"].alias("bytesWritten"), t["writeTime"].alias("writeTime"),
                     t["shuffleRecordsWritten"].alias("recordsWritten")).alias("shuffleWriteMetrics"),
        ).alias("taskMetrics"),
    )


def _event_rows(events: DataFrame, view: str) -> DataFrame:
    """One row per task attempt: stage fields, and as ``task`` the event that :func:`payload_task` makes one of.

    An event is a tenth of its task, so this is what is shuffled and sorted.
    """
    event = F.struct("event_id", "ts", "event_type", "value", "k")
    return _with_k(events).select(*[c.alias(n) for n, c in _stage_columns(view).items()], event.alias("task"))


def _by_app(df: DataFrame) -> DataFrame:
    """Sorted as a write by app needs it (app_id not null, so that Spark sees it), before the rows grow."""
    return df.withColumn("app_id", F.coalesce("app_id", F.lit(""))).sortWithinPartitions("app_id")


def events_payload_rows(events: DataFrame, view: str = "task", damaged: bool = False) -> DataFrame:
    """One row per task attempt: stage fields plus a ``task`` struct shaped like the payload (see :func:`payload_task`)."""
    return _event_rows(events, view).withColumn("task", payload_task(view, damaged, F.col("task")))


def events_tasks(events: DataFrame, view: str = "task") -> DataFrame:
    """The flat task table for a view: the same field expressions as the payload rows,
    computed directly (no payload struct, no unused fields per row)."""
    t = _task_columns(view)
    flat = {
        "taskId": t["taskId"], "attempt": t["attempt"], "status": t["status"], "duration": t["duration"],
        "resultSize": t["resultSize"], "jvmGcTime": t["jvmGcTime"], "bytesRead": t["bytesRead"],
        "bytesWritten": t["bytesWritten"],
        "shuffleBytesRead": derive_shuffle_read(t["remoteBytesRead"], t["localBytesRead"]),
        "shuffleBytesWritten": t["shuffleBytesWritten"],
    }
    cols = {**_stage_columns(view), **flat}
    return _with_k(events).select(*[c.alias(n) for n, c in cols.items()])


#: A signup of the ``large`` jobs view.
LARGE_SIGNUP = 300


def _signups(events: DataFrame, large: bool = False) -> DataFrame:
    signups = events.filter(F.col("event_type") == "signup")
    if large:
        signups = signups.filter(F.col("value") >= LARGE_SIGNUP)
    return (signups
                  .select(F.concat(F.lit("app-"), (F.col("user_id") % 3).cast("string")).alias("app_id"),
                          F.dayofmonth("ts").alias("jobId"), F.col("user_id").alias("stageId"), "ts"))


def events_stage_job_pairs(events: DataFrame) -> DataFrame:
    """(app_id, stageId, jobId) of the job mapping, straight from the events: each user
    with a signup that day, once per job (a partial-aggregated distinct, no per-job list)."""
    return _signups(events).select("app_id", "stageId", "jobId").distinct()


def events_jobs(events: DataFrame, stages_per_record: int = 10_000, large: bool = False) -> DataFrame:
    """Job payload rows: one job per (app, day) with its signup users as stage ids.

    In this mapping a job's stage list grows with the data, so a job is written as one
    record per range of ``stages_per_record`` consecutive stage ids (same job fields in
    each).  Stage ids of a job are distinct integers, so no record holds more than that
    many; readers explode the records into the same (stage, job) pairs.
    """
    signups, job = _signups(events, large), ["app_id", "jobId"]
    slices = (signups.groupBy(*job, F.floor(F.col("stageId") / stages_per_record).alias("_slice"))
                     .agg(F.array_sort(F.collect_set("stageId")).alias("stageIds")))
    span = signups.groupBy(*job).agg(F.min("ts").alias("s0"), F.max("ts").alias("s1"))     # one row per job
    return slices.join(span, job).select(
        *job, F.concat(F.lit("job "), F.col("jobId").cast("string")).alias("name"),
        F.date_format("s0", LAUNCH_FORMAT).alias("submissionTime"),
        F.date_format("s1", LAUNCH_FORMAT).alias("completionTime"), "stageIds")


def stage_documents(rows: DataFrame, tasks_per_doc: int = 1000, made: Callable[[Column], Column] = lambda task: task) -> DataFrame:
    """Payload rows -> stage-attempt documents with a ``tasks`` map; ``made`` gives the task of the column ``task``.

    A task is made of its (smaller) column only when its document is put together, after the shuffles and the sort.

    A stage attempt with many tasks is split into several documents of about
    ``tasks_per_doc`` tasks (hash of the task key), and rows are dealt out by document, so
    neither a document nor a task's share of them grows with the hottest stage (the join
    before it is one that AQE may split); readers treat the pieces as one attempt.
    """
    keys, task = STAGE_KEYS, made(F.col("task"))
    per_attempt = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum((task["status"] == "SUCCESS").cast("int")).cast("int").alias("numCompleteTasks"),
        F.sum((task["status"] == "FAILED").cast("int")).cast("int").alias("numFailedTasks"),
        F.min(task["launchTime"]).alias("firstTaskLaunchedTime"),
        F.max(task["launchTime"]).alias("completionTime"),
    )

    def entry_key(task: Column) -> Column:
        return F.format_string("%d.%d", task["taskId"], task["attempt"])

    def entry(task: Column) -> Column:
        return F.struct(entry_key(task).alias("key"), task.alias("value"))

    chunked = rows.join(per_attempt, keys).withColumn(
        "_chunk", F.pmod(F.xxhash64(entry_key(task)), F.ceil(F.col("_n") / tasks_per_doc)))
    documents = (chunked.repartition(*keys, "_chunk")
                 .groupBy(*keys, "numCompleteTasks", "numFailedTasks", "firstTaskLaunchedTime", "completionTime", "_chunk")
                 .agg(F.collect_list("task").alias("tasks")))
    return _by_app(documents).select(
        "app_id", "stageId", "attemptId", F.col("stageName").alias("name"), F.col("stageStatus").alias("status"), "numTasks",
        "numCompleteTasks", "numFailedTasks", "firstTaskLaunchedTime", "completionTime",
        F.map_from_entries(F.transform("tasks", lambda t: entry(made(t)))).alias("tasks"))


def bare_attempts(events: DataFrame, tasks: DataType) -> DataFrame:
    """Stage-attempt documents without tasks (a map of type ``tasks``): attempt 2 of each user with a signup."""
    stage = _stage_columns("task") | {"attemptId": F.lit(2)}
    none = {"numCompleteTasks": F.lit(0), "numFailedTasks": F.lit(0), "firstTaskLaunchedTime": F.lit(None).cast("string"),
            "completionTime": F.lit(None).cast("string"), "tasks": F.create_map().cast(tasks)}
    users = events.filter(F.col("event_type") == "signup").select("user_id").distinct()
    return users.select(stage["app_id"].alias("app_id"), stage["stageId"].alias("stageId"), stage["attemptId"].alias("attemptId"),
                        stage["stageName"].alias("name"), F.lit("PENDING").alias("status"), stage["numTasks"].alias("numTasks"),
                        *[c.alias(n) for n, c in none.items()])


def broken_lines(documents: DataFrame, kind: str) -> DataFrame:
    """(app_id, value): the documents as JSON lines, some of them with the faults of the module's docstring."""
    line = F.to_json(F.struct(*[c for c in documents.columns if c != "app_id"]))
    own = F.col("stageId" if kind == "stages" else "jobId")
    changes = [(5, '"duration":(\\d+)', '"duration":"$1"'), (7, '"numTasks":\\d+,', ""),
               (11, '"status":"COMPLETE"', '"status":5')] if kind == "stages" else [
        (5, ',"completionTime":"[^"]*"', ""), (7, '"jobId":(\\d+)', '"jobId":"$1"'), (11, '"stageIds":\\[[^\\]]*\\]', '"stageIds":"all"')]
    for every, found, put in changes:
        line = F.when(own % every == 0, F.regexp_replace(line, found, put)).otherwise(line)
    if kind == "stages":
        line = F.when(own % 13 == 0, F.left(line, F.length(line) - 1)).otherwise(line)
    return documents.select("app_id", line.alias("value"))


def task_records(rows: DataFrame) -> DataFrame:
    """Payload rows -> stand-alone task records (task fields top level, stage ids alongside)."""
    return rows.select("app_id", "stageId", "attemptId", "task.*")


ARRAY_FILE = "tasks.json"
#: As Spark names folders of partitions.
_NO_VALUE, _ESCAPED = "__HIVE_DEFAULT_PARTITION__", re.compile("[\\x00-\\x1f\"#%'*/:=?\\\\\\x7f{\\[\\]^]")


def _folder(key: str, value) -> str:
    return f"{key}={_NO_VALUE if value in (None, '') else _ESCAPED.sub(lambda c: f'%{ord(c[0]):02X}', str(value))}"


def write_arrays(records: DataFrame, keys: list[str], path: str) -> int:
    """Write the JSON lines (keys, value) as one array per key, ``tasks.json`` in a ``key=value`` folder of its own; returns how many.

    There is a folder per stage attempt, so the tasks write the files themselves, one at a time and line by line: Spark's
    writer makes and commits each file and folder in several steps, the last of them one by one on the driver.  Rows of a key
    follow each other in one partition.  A file gets its name when it is whole, so an attempt that fails or runs twice leaves no other.
    """
    spark = records.sparkSession
    ship_package(spark)

    def run(batches):
        fs, top = open_fs(path)
        own = out = at = None
        n = 0

        def done():
            out.write(b"]\n")
            out.close()
            fs.move(f"{at}/{name}", f"{at}/{ARRAY_FILE}")

        for batch in batches:
            *ids, values = (batch.column(c).to_pylist() for c in (*keys, "value"))
            for *key, value in zip(*ids, values):
                if key != own:
                    if out:
                        done()
                    own, n = key, n + 1
                    at, name = "/".join([top, *map(_folder, keys, key)]), f".{uuid.uuid4().hex}"
                    fs.create_dir(at, recursive=True)
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                    out.write(b"[" + value.encode())
                else:
                    out.write(b"\n," + value.encode())
        if out:
            done()
        yield pa.RecordBatch.from_pydict({"n": [n]}, pa.schema([("n", pa.int64())]))

    return records.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0]


_WRITTEN: dict[tuple, str] = {}


def write_payload(spark: SparkSession, sf_dir: str, kind: str, view: str = "task", damaged: bool = False,
                  tasks_per_doc: int = 1000, variant: str = "") -> str:
    """Derive one kind of payload (``jobs``, ``stages`` or ``tasks``) from ``events`` and write it as JSON Lines
    below the shared scratch folder, partitioned by app.  Written once per session and input.

    ``variant``: ``large`` (jobs), ``bare`` (stages) or ``broken`` (jobs, stages; damaged), see the module's docstring;
    ``arrays`` (tasks): one bare JSON array per stage attempt, in ``app_id=/stageId=/attemptId=`` folders.
    """
    if kind == "jobs":                                       # the same whatever the view of the tasks
        view, damaged = "task", False
    key = (spark.sparkContext.applicationId, sf_dir, kind, view, damaged, tasks_per_doc, variant)
    if key not in _WRITTEN or not path_exists(spark, _WRITTEN[key]):
        events = read_table(spark, sf_dir, "events")
        path = scratch_path(spark, f"payloads-{kind}-{view}{'-damaged' if damaged else ''}{variant and '-' + variant}")
        made = partial(payload_task, view, damaged or variant == "broken")
        rows = _event_rows(events, view) if kind != "jobs" else None
        if kind == "jobs":
            payload = events_jobs(events, large=variant == "large")
        elif kind == "stages":
            payload = stage_documents(rows, tasks_per_doc, lambda task: made(event=task))
        elif variant != "arrays":
            payload = task_records(_by_app(rows.select("app_id", "stageId", "attemptId", "task")).withColumn("task", made(event=F.col("task"))))
        if variant == "arrays":
            keys = ["app_id", "stageId", "attemptId"]
            rows = rows.select(*keys, "task").repartition(*keys).sortWithinPartitions(*keys, "task.k", "task.event_id")
            write_arrays(rows.select(*keys, F.to_json(made(event=F.col("task"))).alias("value")), keys, path)
        elif variant == "broken":
            broken_lines(payload, kind).write.partitionBy("app_id").text(path)
        else:
            payload.write.partitionBy("app_id").json(path)
            if variant == "bare":                            # beside them: a union of both would be sorted anew
                bare_attempts(events, payload.schema["tasks"].dataType).write.mode("append").partitionBy("app_id").json(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def write_payloads(spark: SparkSession, sf_dir: str, view: str = "task", damaged: bool = False,
                   tasks_per_doc: int = 1000) -> dict[str, str]:
    """All three kinds (see :func:`write_payload`)."""
    return {kind: write_payload(spark, sf_dir, kind, view, damaged, tasks_per_doc)
            for kind in ("jobs", "stages", "tasks")}
