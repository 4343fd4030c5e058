"""The stage-statistics analysis over a folder that keeps receiving stage payload files.

Each micro-batch is checked (bad documents go to a quarantine folder, by default
``<output>_rejected``), exploded and reduced to the best attempt of each task, and its task rows are written to
``<output>/batch=<epoch>``.  Writing a batch folder with ``overwrite`` makes a replayed epoch
(after a driver or executor failure) replace its own output instead of adding duplicates.
The best attempt is a mergeable aggregate, so batches can be put together at any time:
``compact_stream`` merges everything received so far into one folder, ``<output>_merged/upto=<epoch>``, with one row per
task and one per stage attempt.  ``read_stream_stats`` merges the latest of these with the batches after it, so what it
reads grows with the tasks and the last batches, not with all rows received.  An attempt
split over batches, a document delivered twice and a retry that arrives later all count once.

A stage saved while it runs and again later has the stage fields (name, status, task count) of
its latest batch; they are resolved on rows per stage attempt, after the task rows are aggregated.  Of two equal-ranked
records of one task, the same one is picked always.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skewlens.operators.stats import finalize_stats, stage_partials
from skewlens.operators.tasks import explode_tasks, merge_tasks
from skewlens.schemas import METRICS, STAGE_KEYS
from skewlens.sources.payloads import read_stages_stream, required_stages


ATTEMPT = ["app_id", "stageId", "attemptId"]
FIELDS = [c for c in STAGE_KEYS if c not in ATTEMPT]
TASK = [*ATTEMPT, "taskId"]


def _best(rows: DataFrame) -> DataFrame:
    """One row per task: a successful attempt first, then the latest."""
    return merge_tasks(rows.select(*TASK, "attempt", "status", *METRICS), TASK)


def _latest(fields: DataFrame) -> DataFrame:
    """One row per stage attempt: the fields of its latest batch."""
    best = F.max(F.struct("batch", *FIELDS)).alias("_latest")
    return fields.groupBy(*ATTEMPT).agg(best).select(*ATTEMPT, *[F.col(f"_latest.{c}") for c in ("batch", *FIELDS)])


def _write_batch(output: str, quarantine: str):
    def run(batch: DataFrame, epoch_id: int) -> None:
        batch = batch.persist()
        try:
            good, bad = required_stages(batch, mode="quarantine")
            tasks = explode_tasks(good).select(*STAGE_KEYS, "taskId", "attempt", "status", *METRICS)
            # the batch= folder names the epoch; readers get it back as the ``batch`` column
            merge_tasks(tasks).write.mode("overwrite").parquet(f"{output}/batch={epoch_id}")
            bad.drop("tasks").write.mode("overwrite").json(f"{quarantine}/batch={epoch_id}")
        finally:
            batch.unpersist()
    return run


def start_stage_stats_stream(spark: SparkSession, stages_dir: str, output_dir: str, checkpoint_location: str,
                             quarantine_dir: str | None = None, available_now: bool = False,
                             processing_time: str = "1 minute",
                             max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the query; ``available_now=True`` processes what is there and stops."""
    quarantine_dir = quarantine_dir or f"{output_dir.rstrip('/')}_rejected"
    stream = read_stages_stream(spark, stages_dir, max_files_per_trigger)
    writer = (stream.writeStream.foreachBatch(_write_batch(output_dir, quarantine_dir))
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()


def read_stream_tasks(spark: SparkSession, output_dir: str) -> DataFrame:
    """Task rows written so far, with the ``batch`` that brought them."""
    return spark.read.parquet(output_dir)


def read_stream_partials(spark: SparkSession, output_dir: str) -> DataFrame:
    """What each micro-batch brought: one row of partials per stage attempt and batch."""
    return stage_partials(read_stream_tasks(spark, output_dir), [*STAGE_KEYS, "batch"])


def _merged(output_dir: str) -> str:
    return f"{output_dir.rstrip('/')}_merged"


def _folders(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the complete folders ``<folder>/<name>=<number>``, ascending."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName().startswith(f"{name}=")]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(done(p, "_SUCCESS")))


def _state(spark: SparkSession, output_dir: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """(task rows, stage fields, batches after the merged ones): the latest merged folder and the batches after it."""
    batches, upto = _folders(spark, output_dir, "batch"), _folders(spark, f"{_merged(output_dir)}/fields", "upto")
    last = upto[-1] if upto else -1
    new = [b for b in batches if b > last]
    tasks = fields = None
    if new:
        rows = spark.read.option("basePath", output_dir).parquet(*[f"{output_dir}/batch={b}" for b in new])
        tasks, fields = rows.select(*TASK, "attempt", "status", *METRICS), rows.select(
            *ATTEMPT, F.col("batch").cast("long").alias("batch"), *FIELDS)
    if upto:
        old = [spark.read.parquet(f"{_merged(output_dir)}/{kind}/upto={last}") for kind in ("tasks", "fields")]
        tasks, fields = old if tasks is None else (tasks.unionByName(old[0]), fields.unionByName(old[1]))
    if tasks is None:
        raise FileNotFoundError(f"no batch was written below {output_dir}")
    return tasks, fields, new


def compact_stream(spark: SparkSession, output_dir: str) -> int | None:
    """Merge all batches so far into one row per task and one per stage attempt; returns the last batch merged.

    The stream may run on meanwhile; what comes later is read beside the merged rows.  The fields are written last, and
    only a folder that has them counts, so an interrupted call changes nothing.  Batch folders stay as they are: the
    caller may delete those up to the returned number.
    """
    tasks, fields, new = _state(spark, output_dir)
    if not new:
        return None
    for kind, rows in (("tasks", _best(tasks)), ("fields", _latest(fields))):
        rows.write.mode("overwrite").parquet(f"{_merged(output_dir)}/{kind}/upto={new[-1]}")
    return new[-1]


def read_stream_stats(spark: SparkSession, output_dir: str) -> DataFrame:
    """Statistics of everything processed so far (one row per stage attempt)."""
    tasks, fields, _ = _state(spark, output_dir)
    # Joined per stage attempt: a hot stage's task rows meet the fields only after they are aggregated.
    partials = stage_partials(_best(tasks), ATTEMPT)
    return finalize_stats(partials.join(_latest(fields).drop("batch"), ATTEMPT))
