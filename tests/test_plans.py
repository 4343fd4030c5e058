"""Plan properties that matter at scale, checked with explain() on the registered queries."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skewlens.plans import catalog
from skewlens.operators.tasks import dedup_tasks
from skewlens.plans.analyze import stats_from_tasks
from tests.conftest import flat_rows

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF", "Cross"]


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cross_joins_or_python_in_plans(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    for node in FORBIDDEN:
        assert node not in text, (name, node)


def test_dedup_limits_before_shuffle_and_spreads_by_task(spark):
    df = flat_rows(spark, [dict(taskId=i % 50, attempt=i) for i in range(200)])
    text = plan(stats_from_tasks(df))
    assert "WindowGroupLimit" in text and "Partial" in text
    hash_lines = [ln for ln in text.splitlines() if "hashpartitioning(" in ln]
    assert any("taskId" in ln for ln in hash_lines), hash_lines
    assert "partial_sum" in text and "partial_max" in text


def test_hot_stage_is_spread_over_reducers(spark):
    rows = [dict(stageId=1, taskId=i, attempt=0) for i in range(3000)]          # one third of all rows
    rows += [dict(stageId=2 + i % 100, taskId=i, attempt=0) for i in range(6000)]
    df = flat_rows(spark, rows)
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        parts = (dedup_tasks(df).filter("stageId = 1").groupBy(F.spark_partition_id().alias("p")).count()
                 .collect())
    finally:
        spark.conf.set(conf, old)
    assert len(parts) >= 4
    assert max(r["count"] for r in parts) < 3000 / 2


def test_task_table_prunes_apps_pushes_stage_filters_and_columns(spark, tmp_dir):
    from skewlens.plans.analyze import stats_from_tasks
    from skewlens.sources.payloads import read_task_table
    from skewlens.sources.sinks import write_task_table
    rows = [dict(app_id=f"app-{a}", stageId=s, taskId=t, duration=100 * t) for a in range(3) for s in range(4)
            for t in range(5)]
    write_task_table(flat_rows(spark, rows), f"{tmp_dir}/tasks")
    table = read_task_table(spark, f"{tmp_dir}/tasks")
    one = table.filter((F.col("app_id") == "app-1") & (F.col("stageId") == 2))
    text = plan(stats_from_tasks(one))
    assert "PartitionFilters: [isnotnull(app_id" in text and "app-1" in text
    assert "PushedFilters: [IsNotNull(stageId), EqualTo(stageId,2)]" in text
    read_schema = [ln for ln in text.splitlines() if ln.startswith("ReadSchema")][0]
    assert "resultSize" not in read_schema and "jvmGcTime" not in read_schema
    assert one.count() == 5


def test_scans_read_only_the_columns_a_query_uses(spark):
    text = plan(entry.queries()["doc_length_skew"](spark, SF))
    schemas = [ln for ln in text.splitlines() if ln.startswith("ReadSchema")]
    assert schemas and all("text:" not in ln and "doc_id" not in ln for ln in schemas), schemas


def test_generic_dedup_also_limits_before_the_shuffle(spark):
    text = plan(entry.queries()["latest_lineitem"](spark, SF))
    assert "WindowGroupLimit" in text and "Partial" in text and "Final" in text


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_added_round_robin_shuffle(spark, name):
    assert "RoundRobin" not in plan(catalog.QUERIES[name](spark, SF))


def test_payload_documents_of_a_hot_stage_are_spread(spark):
    """A stage with six tenths of all rows: no partition of the documents comes near its share."""
    from skewlens.sources.testdata import events_payload_rows, stage_documents
    rows = 20_000
    events = spark.range(rows).select(
        F.col("id").alias("event_id"), F.lit("2026-03-04 05:06:07").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 10 < 6, 1).otherwise(F.col("id") % 97).cast("bigint").alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(5.0).alias("value"),
        F.format_string('{"k": %d}', "id").alias("props"))
    off = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        docs = stage_documents(events_payload_rows(events), tasks_per_doc=100)
        parts = docs.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.size("tasks")).alias("n")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(r["n"] for r in parts) == rows
    assert max(r["n"] for r in parts) < 0.3 * rows
