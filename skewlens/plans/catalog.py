"""Registered queries over the driver's test tables (their DuckDB oracle SQL is in ``oracle``).

Each query is ``(spark, sf_dir) -> DataFrame`` over whole tables.  Column names and types
are identical between a query and its oracle; arrays are shown as comma-joined text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skewlens.functions.format import display_ratio, metric_text, pretty_bytes, pretty_time
from skewlens.operators.jobs import attach_job_ids, jobs_by_stage, stage_to_jobs, stages_with_jobs
from skewlens.operators.skew import (metric_flags, metric_long, rank_order, skew_predicate, skew_ratio,
                                     skewed_stages, stage_skew, with_significance)
from skewlens.operators.rank import global_rank
from skewlens.operators.stats import STATS_COLUMNS, group_skew_stats, stage_stats
from skewlens.operators.tasks import (dedup_tasks, derive_shuffle_read, explode_task_fields, explode_tasks,
                                      flatten_task_records, latest_attempt, latest_by_aggregate, merge_tasks,
                                      project_stage, status_rank)
from skewlens.plans.analyze import analyze, analyze_tasks, stats_from_stages, stats_from_tasks
from skewlens.schemas import FLAT_TASK_COLUMNS, METRICS, STAGE_KEYS, STATS_PATHS
from skewlens.session import scratch_path
from skewlens.sources.diagnosis import diagnose_jobs, diagnose_stages
from skewlens.sources.payloads import TASK_TABLE_SCHEMA, read_jobs, read_stages, read_task_list, read_task_table
from skewlens.sources.sinks import (REPORT_SEPARATOR, convert_stages, stats_json, write_bucketed_tasks, write_measures,
                                    write_report, write_task_table)
from skewlens.sources.testdata import (events_jobs, events_stage_job_pairs, events_tasks, read_table,
                                      write_payload)

Query = Callable[[SparkSession, str], DataFrame]


# ---------------------------------------------------------------- Spark side: views

def _events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events")


def task_view(spark, sf):
    return events_tasks(_events(spark, sf), "task")


def gate_view(spark, sf):
    return events_tasks(_events(spark, sf), "gate")


def jobs_view(spark, sf):
    return events_jobs(_events(spark, sf))


def task_stats(spark, sf):
    return stats_from_tasks(task_view(spark, sf))


def gate_stats(spark, sf):
    # The gate view is aggregated without the de-dup step, by design of the view.
    return stage_stats(gate_view(spark, sf))


def _job_ids_text(col="jobIds"):
    return F.array_join(F.col(col).cast("array<string>"), ",").alias("job_ids")


# ---------------------------------------------------------------- Spark side: queries

def _payload(spark, sf, kind, damaged=False, variant=""):
    return write_payload(spark, sf, kind, "task", damaged, variant=variant)


def _stages(spark, sf, damaged=False, variant="", paths=None):
    return read_stages(spark, _payload(spark, sf, "stages", damaged, variant), paths=paths)


# Metric name stems in report order: as in the statistics columns (avg<Stem>, max<Stem>)
# and as in derived column names (<metric>Ratio).
STEMS = ["Duration", "BytesRead", "BytesWritten", "ShuffleBytesRead", "ShuffleBytesWritten"]
LOWER = METRICS


def q_dedup_tasks(spark, sf):
    return dedup_tasks(task_view(spark, sf))


def q_dedup_merged(spark, sf):
    """The same rows by the mergeable aggregate."""
    return merge_tasks(task_view(spark, sf)).select(*FLAT_TASK_COLUMNS)


def q_dedup_bucketed(spark, sf):
    """Task rows written as a bucketed table; its de-duplication shuffles nothing."""
    return dedup_tasks(bucketed_tasks(spark, sf))


def bucketed_tasks(spark, sf):
    path = scratch_path(spark, "tasks-bucketed")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    write_bucketed_tasks(task_view(spark, sf), name, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.table(name).select(*FLAT_TASK_COLUMNS)


def q_stage_stats(spark, sf):
    return task_stats(spark, sf)


def q_skewed_stages(spark, sf):
    return skewed_stages(task_stats(spark, sf), 10.0)


def q_skewed_stages_t8(spark, sf):
    return skewed_stages(task_stats(spark, sf), 8.0)


def q_skewed_stages_gate(spark, sf):
    """A view in which the gate rejects stages that the skew predicate alone would keep."""
    return skewed_stages(gate_stats(spark, sf), 2.0)


def q_skew_rank(spark, sf):
    """The report order (default threshold) as a rank over all applications and within each."""
    pairs = jobs_by_stage(events_stage_job_pairs(_events(spark, sf)))
    order = Window.partitionBy("app_id").orderBy(*rank_order())
    measures = stage_skew(gate_stats(spark, sf), pairs, ordered=False).select("app_id", "stageId", "attemptId", "skewRatio")
    return global_rank(measures, rank_order(), "global_rank").withColumn("app_rank", F.row_number().over(order))


def q_skew_ratio_shuffle_read(spark, sf):
    """The ratio of a metric that is 0 in every task of some stages (NaN there)."""
    return gate_stats(spark, sf).select("app_id", "stageId", "attemptId",
                                        skew_ratio("maxShuffleBytesRead", "avgShuffleBytesRead").alias("ratio"))


def q_stages_with_large_jobs(spark, sf):
    """Most stages have no job in this jobs view: the semi join drops them."""
    return stages_with_jobs(task_view(spark, sf), stage_to_jobs(events_jobs(_events(spark, sf), large=True)))


def q_attach_large_job_ids(spark, sf):
    """Stages without a job in this jobs view get an empty list."""
    joined = attach_job_ids(task_stats(spark, sf), stage_to_jobs(events_jobs(_events(spark, sf), large=True)))
    return joined.select("app_id", "stageId", "attemptId", _job_ids_text())


def q_significance_gate(spark, sf):
    return with_significance(gate_stats(spark, sf)).select(
        "app_id", "stageId", "attemptId", "maxDuration", "maxDurationAllStages", "isSignificant")


def q_metric_flags(spark, sf):
    return metric_flags(gate_stats(spark, sf), 2.0)


def q_skew_ratio(spark, sf):
    return task_stats(spark, sf).select("app_id", "stageId", "attemptId", skew_ratio().alias("skewRatio"))


def q_metric_long(spark, sf):
    return metric_long(gate_stats(spark, sf), 2.0)


def q_display_ratio(spark, sf):
    stats = task_stats(spark, sf)
    return stats.select("app_id", "stageId", "attemptId", *[
        display_ratio(F.col(f"max{m}"), F.col(f"avg{m}").cast("long")).alias(f"{lo}Ratio")
        for m, lo in zip(STEMS, LOWER)])


def q_stage_to_jobs(spark, sf):
    return stage_to_jobs(jobs_view(spark, sf)).select(
        "app_id", "stageId", _job_ids_text(), F.size("jobIds").alias("n_jobs"))


def q_stages_with_jobs(spark, sf):
    return stages_with_jobs(task_view(spark, sf), stage_to_jobs(jobs_view(spark, sf)))


def q_attach_job_ids(spark, sf):
    joined = attach_job_ids(task_stats(spark, sf), stage_to_jobs(jobs_view(spark, sf)))
    return joined.select(*STATS_COLUMNS, _job_ids_text())


def q_skew_report(spark, sf):
    return flagship(spark, sf).select(
        "app_id", "stageId", "stageName", "attemptId", "stageStatus", _job_ids_text(),
        "stageDuration", "taskCount", "skewRatio")


def q_stats_from_payloads(spark, sf):
    return stats_from_stages(_stages(spark, sf))


def q_stats_from_payloads_trusted(spark, sf):
    """Documents that were checked before, read with the fields of the statistics only."""
    return stats_from_stages(_stages(spark, sf, paths=STATS_PATHS), mode="trusted")


def q_report_large_jobs(spark, sf):
    """As ``report_from_payloads``; most stages have no job in this jobs view and go before their tasks are exploded."""
    return analyze(read_jobs(spark, _payload(spark, sf, "jobs", variant="large")), _stages(spark, sf)).select(
        "app_id", "stageId", "stageName", "attemptId", "stageStatus", _job_ids_text(),
        "stageDuration", "taskCount", "skewRatio")


def q_report_from_payloads(spark, sf):
    """Payload files -> read, checked -> the ranked report, at the default threshold."""
    return analyze(read_jobs(spark, _payload(spark, sf, "jobs")), _stages(spark, sf)).select(
        "app_id", "stageId", "stageName", "attemptId", "stageStatus", _job_ids_text(),
        "stageDuration", "taskCount", "skewRatio")


def q_report_block(spark, sf):
    return flagship(spark, sf).select("app_id", "stageId", "attemptId", "block")


def q_metric_line(spark, sf):
    long = metric_long(gate_stats(spark, sf), 2.0)
    return long.select("app_id", "stageId", "attemptId", "metricIndex",
                       metric_text(F.struct(*[F.col(c) for c in
                                              ("metric", "unit", "avg", "max", "isSkewed", "displayRatio")]))
                       .alias("line"))


def q_fmt_time(spark, sf):
    stats = task_stats(spark, sf)
    return stats.select("app_id", "stageId", "attemptId",
                        pretty_time(F.col("avgDuration")).alias("avgTime"),
                        pretty_time(F.col("maxDuration")).alias("maxTime"))


def q_fmt_bytes(spark, sf):
    stats = task_stats(spark, sf)
    cols = []
    for m in STEMS[1:]:
        cols += [pretty_bytes(F.col(f"avg{m}").cast("long")).alias(f"avg{m}Text"),
                 pretty_bytes(F.col(f"max{m}")).alias(f"max{m}Text")]
    return stats.select("app_id", "stageId", "attemptId", *cols)


def q_stats_json(spark, sf):
    return stats_json(task_stats(spark, sf))


def q_status_rank(spark, sf):
    """With a NULL status of every seventh task id."""
    tasks = task_view(spark, sf).withColumn("status", F.when(F.col("taskId") % 7 != 0, F.col("status")))
    return tasks.select("app_id", "stageId", "attemptId", "taskId", "attempt", "status",
                        status_rank(F.col("status")).alias("statusOrder"))


def q_project_stage(spark, sf):
    projected = project_stage(_stages(spark, sf, variant="bare"))
    # A large attempt may be stored as several documents; count its tasks over all of them.
    return projected.groupBy(*STAGE_KEYS).agg(F.sum(F.size("tasks")).alias("n_tasks"))


def q_explode_tasks(spark, sf):
    """Attempts without tasks, which these payloads have, give no row."""
    return explode_tasks(_stages(spark, sf, variant="bare"))


def q_derive_shuffle_read(spark, sf):
    rows = explode_task_fields(_stages(spark, sf))
    return rows.select("app_id", "stageId", "attemptId", "taskId", "attempt", "shuffleRemoteBytesRead",
                       "shuffleLocalBytesRead",
                       derive_shuffle_read(F.col("shuffleRemoteBytesRead"), F.col("shuffleLocalBytesRead"))
                       .alias("shuffleBytesRead"))


def q_src_jobs(spark, sf):
    jobs = read_jobs(spark, _payload(spark, sf, "jobs"))
    # A job may span several records; per-job figures stay bounded however many stages it lists.
    return (jobs.groupBy("app_id", "jobId", "name", "submissionTime", "completionTime")
                .agg(F.sum(F.size("stageIds")).alias("n_stages"),
                     F.min(F.array_min("stageIds")).alias("first_stage"),
                     F.max(F.array_max("stageIds")).alias("last_stage")))


def q_src_stages(spark, sf):
    stages = _stages(spark, sf)
    return (stages.groupBy("app_id", "stageId", "attemptId", "name", "status", "numTasks", "numCompleteTasks",
                           "numFailedTasks", "firstTaskLaunchedTime", "completionTime")
                  .agg(F.sum(F.size("tasks")).alias("n_tasks")))


def q_src_tasks_flat(spark, sf):
    return explode_task_fields(_stages(spark, sf))


def q_src_task_list(spark, sf):
    return flatten_task_records(read_task_list(spark, _payload(spark, sf, "tasks")))


def q_src_task_arrays(spark, sf):
    """Bare task lists, one JSON array per stage attempt; the ids come from the folders."""
    return flatten_task_records(read_task_list(spark, _payload(spark, sf, "tasks", variant="arrays"), multi_line="split"))


def q_src_required_fields(spark, sf):
    """What is wrong with the broken payload lines, per stage attempt and job; lines that are no JSON have no id."""
    stages = diagnose_stages(spark, _payload(spark, sf, "stages", variant="broken")).select(
        "app_id", F.lit("stage").alias("kind"), F.col("stageId").alias("id"), "attemptId", "reasons")
    jobs = diagnose_jobs(spark, _payload(spark, sf, "jobs", variant="broken")).select(
        "app_id", F.lit("job").alias("kind"), F.col("jobId").cast("long").alias("id"), F.lit(None).cast("int").alias("attemptId"), "reasons")
    # One row per (document, reason); the set per attempt is bounded by the number of
    # distinct reasons however many documents an attempt is split into.
    each = stages.unionByName(jobs).select("app_id", "kind", "id", "attemptId", F.size("reasons").alias("n"),
                                           F.explode_outer("reasons").alias("reason"))
    return each.groupBy("app_id", "kind", "id", "attemptId").agg(
        (F.max("n") == 0).alias("accepted"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def q_task_table(spark, sf):
    """Flat task rows converted once to parquet by app, then read back for analysis."""
    path = scratch_path(spark, "tasks-parquet")
    write_task_table(explode_tasks(_stages(spark, sf)), path)
    return read_task_table(spark, path)


def q_convert_stages(spark, sf):
    """Payloads with some damaged tasks converted in one pass: valid and quarantined rows."""
    path = scratch_path(spark, "converted")
    convert_stages(_stages(spark, sf, damaged=True), path)
    table = spark.read.schema(TASK_TABLE_SCHEMA + ", missing array<string>, valid boolean").parquet(path)
    return table.select(*FLAT_TASK_COLUMNS, "valid", F.array_join("missing", ",").alias("missing"))


def q_report_sink(spark, sf):
    """Write the ranked report as text (blank-line separated) and read the blocks back."""
    path = scratch_path(spark, "report")
    write_report(flagship(spark, sf), path)
    return spark.read.option("lineSep", REPORT_SEPARATOR).text(path).select(F.col("value").alias("block"))


def q_measures_sink(spark, sf):
    """Write the structured measures as parquet by app and read them back."""
    path = scratch_path(spark, "measures")
    write_measures(flagship(spark, sf, ordered=False).drop("block"), path)
    return spark.read.parquet(path).select(
        "app_id", "stageId", "attemptId", "taskCount", "skewRatio", _job_ids_text(),
        F.size("taskAgg").alias("n_metrics"))


LINEITEM_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                  "l_returnflag"]


def q_latest_lineitem(spark, sf):
    """The de-dup operator on a second table: one row per (order, line number), a finished
    line ('F') first, then the latest ship date; remaining columns break ties."""
    items = read_table(spark, sf, "lineitem")
    order = [F.when(F.col("l_linestatus") == "F", 1).otherwise(2).asc(), F.col("l_shipdate").desc()] + \
        [F.col(c).asc() for c in LINEITEM_ORDER]
    return latest_attempt(items, ["l_orderkey", "l_linenumber"], order)


def q_latest_lineitem_merged(spark, sf):
    """The same rows by the mergeable aggregate."""
    order = [("l_shipdate", True)] + [(c, False) for c in LINEITEM_ORDER]
    return latest_by_aggregate(read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], order, F.col("l_linestatus") == "F")


def q_order_price_skew(spark, sf):
    """Group statistics + skew flag on a money measure: order totals per customer, doubles that are summed exactly."""
    stats = group_skew_stats(read_table(spark, sf, "orders"), ["o_custkey"], ["o_totalprice"])
    return stats.select("o_custkey", "avg_o_totalprice", "max_o_totalprice",
                        skew_predicate(3.0, [("avg_o_totalprice", "max_o_totalprice")]).alias("is_skewed"))


def q_doc_length_skew(spark, sf):
    docs = read_table(spark, sf, "documents").select("lang", "source", "n_chars")
    stats = group_skew_stats(docs, ["lang", "source"], ["n_chars"])
    return stats.select("*", skew_predicate(3.0, [("avg_n_chars", "max_n_chars")]).alias("is_skewed"))


QUERIES: dict[str, Query] = {
    # attempt de-dup, statistics, skew filter
    "dedup_tasks": q_dedup_tasks,
    "dedup_merged": q_dedup_merged,
    "dedup_bucketed": q_dedup_bucketed,
    "status_rank": q_status_rank,
    "stage_stats": q_stage_stats,
    "skewed_stages": q_skewed_stages,
    "skewed_stages_t8": q_skewed_stages_t8,
    "skewed_stages_gate": q_skewed_stages_gate,
    "significance_gate": q_significance_gate,
    "metric_flags": q_metric_flags,
    "skew_ratio": q_skew_ratio,
    "skew_ratio_shuffle_read": q_skew_ratio_shuffle_read,
    "metric_long": q_metric_long,
    "display_ratio": q_display_ratio,
    # job lookups
    "stage_to_jobs": q_stage_to_jobs,
    "stages_with_jobs": q_stages_with_jobs,
    "attach_job_ids": q_attach_job_ids,
    "stages_with_large_jobs": q_stages_with_large_jobs,
    "attach_large_job_ids": q_attach_large_job_ids,
    # ranked report and rendering
    "skew_report": q_skew_report,
    "skew_rank": q_skew_rank,
    "report_block": q_report_block,
    "stats_from_payloads": q_stats_from_payloads,
    "stats_from_payloads_trusted": q_stats_from_payloads_trusted,
    "report_from_payloads": q_report_from_payloads,
    "report_large_jobs": q_report_large_jobs,
    "metric_line": q_metric_line,
    "fmt_time": q_fmt_time,
    "fmt_bytes": q_fmt_bytes,
    "stats_json": q_stats_json,
    # payload sources and nested data
    "src_jobs": q_src_jobs,
    "src_stages": q_src_stages,
    "src_tasks_flat": q_src_tasks_flat,
    "src_task_list": q_src_task_list,
    "src_task_arrays": q_src_task_arrays,
    "src_required_fields": q_src_required_fields,
    "project_stage": q_project_stage,
    "explode_tasks": q_explode_tasks,
    "derive_shuffle_read": q_derive_shuffle_read,
    "task_table": q_task_table,
    "convert_stages": q_convert_stages,
    "report_sink": q_report_sink,
    "measures_sink": q_measures_sink,
    # the generic forms on a second table
    "doc_length_skew": q_doc_length_skew,
    "order_price_skew": q_order_price_skew,
    "latest_lineitem": q_latest_lineitem,
    "latest_lineitem_merged": q_latest_lineitem_merged,
}


def flagship(spark: SparkSession, sf: str, ordered: bool = True) -> DataFrame:
    """The full report at threshold 8 over the task view: measures + rendered blocks.

    Stage -> job lists come from the (stage, job) pairs of the mapping directly; the
    job-payload path (records with stage id lists, then ``stage_to_jobs``) gives the same
    lists and is checked by its own queries.
    """
    events = _events(spark, sf)
    return analyze_tasks(events_tasks(events, "task"), jobs_by_stage(events_stage_job_pairs(events)), 8.0,
                         ordered=ordered)
