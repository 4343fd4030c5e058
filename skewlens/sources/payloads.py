"""Readers for saved job / stage-attempt / task-list payloads, and the required-field check.

Layout: ``<root>/<kind>/app_id=<id>/*.json`` — partition discovery turns the folder into
the ``app_id`` column, so a filter on ``app_id`` prunes whole folders.  A folder holding
one application without ``app_id=`` directories is read with ``app_id=...`` (default: the
empty string, never NULL).

``multi_line=False`` (default) reads JSON Lines, which Spark splits across tasks;
``multi_line=True`` reads saved REST responses (one JSON array per file; each file is
parsed whole by one Spark task); ``multi_line="split"`` reads them with several tasks per file
(``sources.arrays``: the files are read twice, for arrays of more than a block or two).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewlens.schemas import (CORRUPT, FLAT_TASK_COLUMNS, JOB, JOB_REQUIRED, STAGE_ATTEMPT, STAGE_REQUIRED,
                              TASK_RECORD, TASK_REQUIRED, narrowed)
from skewlens.sources.arrays import read_arrays


def _read(spark: SparkSession, path: str | list[str], schema: T.StructType, multi_line: bool | str,
          app_id: str | None) -> DataFrame:
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType(), True)])
    if multi_line == "split":
        df = read_arrays(spark, path, with_corrupt, CORRUPT)
    else:
        df = (spark.read.schema(with_corrupt)
              .option("multiLine", multi_line)
              .option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT)
              .json(path))
    # Never NULL: app_id is a join and grouping key downstream (a NULL key would match nothing).
    given = F.lit("" if app_id is None else app_id)
    app = F.coalesce(F.col("app_id").cast("string"), given) if "app_id" in df.columns else given
    return df.select(app.alias("app_id"), *[f.name for f in schema.fields], CORRUPT)


def read_stages_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of stage-attempt payload files (JSON Lines) arriving below ``path``.

    ``app_id`` comes from ``app_id=`` folders (declared in the schema so the file source
    fills it from the path).
    """
    schema = T.StructType([T.StructField("app_id", T.StringType(), True)] + STAGE_ATTEMPT.fields
                          + [T.StructField(CORRUPT, T.StringType(), True)])
    reader = (spark.readStream.schema(schema)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path).withColumn("app_id", F.coalesce(F.col("app_id"), F.lit("")))


TASK_TABLE_SCHEMA = ("stageId bigint, attemptId int, stageName string, stageStatus string, numTasks int, "
                     "taskId bigint, attempt bigint, status string, duration bigint, resultSize bigint, "
                     "jvmGcTime bigint, bytesRead bigint, bytesWritten bigint, shuffleBytesRead bigint, "
                     "shuffleBytesWritten bigint, app_id string")


def read_task_table(spark: SparkSession, path: str, converted: bool = False) -> DataFrame:
    """Flat task rows written by ``write_task_table`` (``app_id`` from the folders).

    ``converted=True`` reads a table written by ``convert_stages``: the filter on its
    ``valid`` partition column means only the ``valid=true`` folders are listed and read.
    """
    schema = TASK_TABLE_SCHEMA + (", valid boolean" if converted else "")
    df = spark.read.schema(schema).parquet(path)
    if converted:
        df = df.filter(F.col("valid"))
    return df.select(*FLAT_TASK_COLUMNS)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Rows set aside by ``convert_stages``, with ``missing`` naming their gaps."""
    return spark.read.parquet(path).filter(~F.col("valid"))


def read_jobs(spark: SparkSession, path, multi_line: bool | str = False, app_id: str | None = None) -> DataFrame:
    """Job payloads: app_id, jobId, name, submissionTime, completionTime, stageIds."""
    return _read(spark, path, JOB, multi_line, app_id)


def read_stages(spark: SparkSession, path, multi_line: bool | str = False, app_id: str | None = None,
                paths: list[str] | None = None) -> DataFrame:
    """Stage-attempt payloads with their ``tasks`` map (task id -> task).

    ``paths`` narrows the read schema to these fields (``schemas.STATS_PATHS``: those of the statistics).  JSON is not
    pruned below the top level, so this is what keeps the parser from building the others; the result cannot be checked
    for required fields, so it is for documents that were (``mode="trusted"``).
    """
    return _read(spark, path, narrowed(STAGE_ATTEMPT, paths) if paths else STAGE_ATTEMPT, multi_line, app_id)


def read_task_list(spark: SparkSession, path, multi_line: bool | str = False, app_id: str | None = None,
                   stage_id: int | None = None, attempt_id: int | None = None) -> DataFrame:
    """Stand-alone task lists: one task object per record.

    The stage ids come from the record, else from ``stageId=<n>/attemptId=<n>`` folders (read by Spark as partition
    columns), else, for the bare list of one stage attempt, from ``stage_id`` and ``attempt_id``.
    """
    records = _read(spark, path, TASK_RECORD, multi_line, app_id)
    for name, given in (("stageId", stage_id), ("attemptId", attempt_id)):
        if given is not None:
            kind = TASK_RECORD[name].dataType
            records = records.withColumn(name, F.coalesce(F.col(name), F.lit(given).cast(kind)))
    return records


def missing_fields(required: list[str], nested: dict[str, list[str]] | None = None,
                   maps: frozenset[str] = frozenset({"tasks"})) -> Column:
    """array<string> naming every required field that is NULL (missing) in the record.

    ``nested`` maps a map/array column of structs to fields required in each element;
    e.g. ``{"tasks": TASK_REQUIRED}`` checks every task of a stage attempt in place
    (higher-order functions, no explode).  ``maps`` names the nested columns that are maps.
    """
    none = F.array().cast("array<string>")

    def named_if(cond: Column, name: str) -> Column:
        return F.when(cond, F.array(F.lit(name))).otherwise(none)

    parts = [named_if(F.col(CORRUPT).isNotNull(), "malformed record")]
    parts += [named_if(F.col(f).isNull(), f) for f in required]
    for coll, fields in (nested or {}).items():
        items = F.map_values(coll) if coll in maps else F.col(coll)
        # One pass over the elements finds the (rare) records with a gap; only those
        # are scanned again per field to name what is missing.
        any_gap = F.exists(items, lambda e: _any_null(e, fields))
        per_field = F.concat(*[named_if(F.exists(items, _field_is_null(f)), f"{coll}.{f}") for f in fields])
        parts.append(F.when(F.coalesce(any_gap, F.lit(False)), per_field).otherwise(none))
    return F.concat(*parts)


def _any_null(element: Column, fields: list[str]) -> Column:
    out = None
    for f in fields:
        c = _field_is_null(f)(element)
        out = c if out is None else out | c
    return out


def _field_is_null(path: str):
    """Lambda for higher-order functions: is ``element.<path>`` NULL?"""
    parts = path.split(".")

    def is_null(element: Column) -> Column:
        for p in parts:
            element = element[p]
        return element.isNull()

    return is_null


def check_required(df: DataFrame, required: list[str], nested: dict[str, list[str]] | None = None,
                   mode: str = "quarantine"):
    """Enforce required fields.

    * ``mode="fail"``: returns ``df``; the first action raises if any record misses a field
      (one bad record fails the whole read).
    * ``mode="quarantine"``: returns ``(good, bad)``; ``bad`` carries ``missing`` (the field
      names) so one bad application does not sink a batch of thousands.  Using both sides
      reads the source twice; ``convert_stages`` splits in one pass.
    * ``mode="tag"``: returns ``df`` with ``missing`` (empty when complete), one pass.
    """
    maps = frozenset(c for c in nested or {} if isinstance(df.schema[c].dataType, T.MapType))
    reasons = missing_fields(required, nested, maps)
    if mode == "tag":
        return df.withColumn("missing", reasons)
    if mode == "fail":
        guard = F.when(F.size(reasons) > 0, F.raise_error(F.concat(
            F.lit("missing required fields: "), F.array_join(reasons, ", ")))).otherwise(F.lit(True))
        return df.filter(guard)
    if mode != "quarantine":
        raise ValueError(f"unknown mode {mode!r}")
    tagged = df.withColumn("missing", reasons)
    good = tagged.filter(F.size("missing") == 0).drop("missing")
    bad = tagged.filter(F.size("missing") > 0)
    return good, bad


def required_jobs(jobs: DataFrame, mode: str = "quarantine"):
    return check_required(jobs, JOB_REQUIRED, mode=mode)


def required_stages(stages: DataFrame, mode: str = "quarantine"):
    return check_required(stages, STAGE_REQUIRED, {"tasks": TASK_REQUIRED}, mode=mode)


def required_task_records(records: DataFrame, mode: str = "quarantine"):
    return check_required(records, ["stageId", "attemptId"] + TASK_REQUIRED, mode=mode)
