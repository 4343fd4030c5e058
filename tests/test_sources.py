import os

import pytest
from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError

from skewlens.plans.analyze import analyze
from skewlens.sources.payloads import read_jobs, read_stages, read_task_list, required_jobs, required_stages
from skewlens.sources.sinks import stats_json, write_report
from skewlens.plans.analyze import stats_from_stages
from tests.conftest import stage_json, task_json, write_json


def _jobs(n_stages=(1, 2)):
    return [{"jobId": 4, "name": "count at A.scala:1", "submissionTime": "2026-03-04T05:06:07.000GMT",
             "completionTime": "2026-03-04T05:07:07.000GMT", "stageIds": list(n_stages), "status": "SUCCEEDED"}]


def test_jobs_and_stages_round_trip_with_app_partitions(spark, tmp_dir):
    write_json(f"{tmp_dir}/jobs/app_id=app-x/jobs.json", _jobs())
    write_json(f"{tmp_dir}/jobs/app_id=app-y/jobs.json", _jobs((9,)))
    jobs = read_jobs(spark, f"{tmp_dir}/jobs", multi_line=True)
    got = sorted((r.app_id, r.jobId, tuple(r.stageIds)) for r in jobs.collect())
    assert got == [("app-x", 4, (1, 2)), ("app-y", 4, (9,))]
    # a folder of one application without app_id= directories
    single = read_jobs(spark, f"{tmp_dir}/jobs/app_id=app-x", multi_line=True, app_id="solo")
    assert [r.app_id for r in single.collect()] == ["solo"]


def test_optional_stage_timestamps_and_ignored_extra_fields(spark, tmp_dir):
    st = stage_json(1, 0, [task_json(1)])
    del st["completionTime"]
    st["description"] = "ignored"
    write_json(f"{tmp_dir}/stages/app_id=a/s.json", [st])
    good, bad = required_stages(read_stages(spark, f"{tmp_dir}/stages", multi_line=True))
    assert good.count() == 1 and bad.count() == 0


def test_missing_required_task_field_quarantines_the_attempt(spark, tmp_dir):
    write_json(f"{tmp_dir}/stages/app_id=a/s.json", [
        stage_json(1, 0, [task_json(1), task_json(2, drop=("taskMetrics.inputMetrics.bytesRead",))]),
        stage_json(2, 0, [task_json(3)]),
    ])
    stages = read_stages(spark, f"{tmp_dir}/stages", multi_line=True)
    good, bad = required_stages(stages)
    assert [r.stageId for r in good.collect()] == [2]
    (b,) = bad.collect()
    assert b.stageId == 1 and b.missing == ["tasks.taskMetrics.inputMetrics.bytesRead"]
    with pytest.raises((PySparkException, Py4JJavaError), match="missing required fields"):
        required_stages(stages, mode="fail").collect()


def test_malformed_and_incomplete_jobs(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/jobs/app_id=a")
    with open(f"{tmp_dir}/jobs/app_id=a/part.json", "w") as f:
        f.write('{"jobId": 1, "name": "n", "submissionTime": "t", "completionTime": "t", "stageIds": [1]}\n')
        f.write('{"jobId": 2, "name": "still running", "submissionTime": "t", "stageIds": [2]}\n')
        f.write('{"jobId": 3, "name": \n')
    good, bad = required_jobs(read_jobs(spark, f"{tmp_dir}/jobs"))
    assert [r.jobId for r in good.collect()] == [1]
    reasons = sorted(tuple(r.missing) for r in bad.collect())
    assert ("completionTime",) in reasons and any("malformed record" in r for r in reasons)


def test_task_list_source(spark, tmp_dir):
    tasks = [dict(task_json(i, duration=10 * i), stageId=3, attemptId=1) for i in range(20)]
    write_json(f"{tmp_dir}/tasks/app_id=a/list.json", tasks)
    recs = read_task_list(spark, f"{tmp_dir}/tasks", multi_line=True)
    assert recs.count() == 20
    assert recs.agg({"duration": "sum"}).first()[0] == 1900


def test_analyze_end_to_end_and_report_sink(spark, tmp_dir):
    skewed = [task_json(i, duration=10_000) for i in range(9)] + [task_json(9, duration=100_000)]
    flat = [task_json(10 + i, duration=10_000) for i in range(10)]
    orphan = [task_json(30 + i, duration=1000 * (1 + 99 * (i == 0))) for i in range(10)]
    write_json(f"{tmp_dir}/stages/app_id=a/1.json", [stage_json(1, 0, skewed)])
    write_json(f"{tmp_dir}/stages/app_id=a/2.json", [stage_json(2, 0, flat)])
    write_json(f"{tmp_dir}/stages/app_id=a/3.json", [stage_json(3, 0, orphan)])  # no job lists it
    write_json(f"{tmp_dir}/jobs/app_id=a/jobs.json", _jobs((1, 2)))
    report = analyze(read_jobs(spark, f"{tmp_dir}/jobs", multi_line=True),
                     read_stages(spark, f"{tmp_dir}/stages", multi_line=True), 3.0)
    rows = report.collect()
    assert [r.stageId for r in rows] == [1]
    out = f"{tmp_dir}/report"
    write_report(report, out)
    text = "".join(open(os.path.join(out, p)).read() for p in sorted(os.listdir(out)) if p.startswith("part-"))
    assert text == rows[0].block + "\n\n"


def test_stats_json_renders_every_column(spark, tmp_dir):
    import json
    write_json(f"{tmp_dir}/stages/app_id=a/1.json", [stage_json(1, 0, [task_json(1, duration=1500)])])
    stats = stats_from_stages(read_stages(spark, f"{tmp_dir}/stages", multi_line=True))
    (row,) = stats_json(stats).collect()
    doc = json.loads(row.json)
    assert doc["avgDuration"] == 1.5 and doc["maxDuration"] == 1 and doc["stageName"] == "stage"
    assert list(doc)[:3] == ["stageId", "attemptId", "stageName"]


def test_job_records_split_by_stage_count_give_the_same_lookup(spark):
    from pyspark.sql import functions as F
    from skewlens.operators.jobs import jobs_by_stage, stage_to_jobs
    from skewlens.sources.testdata import events_jobs, events_stage_job_pairs, read_table
    events = read_table(spark, "/root/testdata/sf0.001", "events")
    small = events_jobs(events, stages_per_record=2)
    assert small.agg(F.max(F.size("stageIds"))).first()[0] <= 2          # ranges of 2 stage ids
    assert small.count() > events_jobs(events).count()
    def lookup(df):
        return sorted((r.app_id, r.stageId, tuple(r.jobIds)) for r in df.collect())
    want = lookup(stage_to_jobs(events_jobs(events)))
    assert lookup(stage_to_jobs(small)) == want == lookup(jobs_by_stage(events_stage_job_pairs(events)))


def test_convert_stages_splits_good_and_quarantined_in_one_pass(spark, tmp_dir):
    from skewlens.operators.tasks import explode_tasks
    from skewlens.sources.payloads import read_quarantine, read_task_table
    from skewlens.sources.sinks import convert_stages
    write_json(f"{tmp_dir}/stages/app_id=a/s.json", [
        stage_json(1, 0, [task_json(1, duration=5), task_json(2, duration=7)]),
        stage_json(2, 0, [task_json(3, drop=("host",))]),
    ])
    stages = read_stages(spark, f"{tmp_dir}/stages", multi_line=True)
    convert_stages(stages, f"{tmp_dir}/table")
    good = read_task_table(spark, f"{tmp_dir}/table", converted=True)
    want = explode_tasks(stages.filter("stageId = 1"))
    assert sorted(good.collect()) == sorted(want.collect())
    bad = read_quarantine(spark, f"{tmp_dir}/table").collect()
    assert [(r.stageId, list(r.missing)) for r in bad] == [(2, ["tasks.host"])]
    assert "PartitionFilters: [isnotnull(valid" in _plan(good)


def _plan(df):
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_single_app_folder_without_app_id_still_analyses(spark, tmp_dir):
    skewed = [task_json(i, duration=10_000) for i in range(9)] + [task_json(9, duration=100_000)]
    write_json(f"{tmp_dir}/stages/s.json", [stage_json(1, 0, skewed)])
    write_json(f"{tmp_dir}/jobs/j.json", _jobs((1,)))
    report = analyze(read_jobs(spark, f"{tmp_dir}/jobs", multi_line=True),
                     read_stages(spark, f"{tmp_dir}/stages", multi_line=True), 3.0).collect()
    assert [(r.app_id, r.stageId, r.jobIds) for r in report] == [("", 1, [4])]


def test_convert_keeps_malformed_lines_in_quarantine(spark, tmp_dir):
    import json as _json
    from skewlens.sources.payloads import read_quarantine, read_task_table
    from skewlens.sources.sinks import convert_stages
    os.makedirs(f"{tmp_dir}/stages/app_id=a")
    with open(f"{tmp_dir}/stages/app_id=a/part.json", "w") as f:
        f.write(_json.dumps(stage_json(1, 0, [task_json(1), task_json(2)])) + "\n")
        f.write('{"stageId": 2, "attemptId": 0, "tasks": {"x": \n')
    convert_stages(read_stages(spark, f"{tmp_dir}/stages"), f"{tmp_dir}/t")
    assert read_task_table(spark, f"{tmp_dir}/t", converted=True).count() == 2
    (bad,) = read_quarantine(spark, f"{tmp_dir}/t").collect()
    assert "malformed record" in bad.missing and bad.taskId is None


def test_task_list_required_fields(spark, tmp_dir):
    from skewlens.sources.payloads import required_task_records
    tasks = [dict(task_json(1), stageId=1, attemptId=0), dict(task_json(2, drop=("duration",)), stageId=1),
             dict(task_json(3), attemptId=0)]
    write_json(f"{tmp_dir}/tasks/app_id=a/list.json", tasks)
    good, bad = required_task_records(read_task_list(spark, f"{tmp_dir}/tasks", multi_line=True))
    assert [r.taskId for r in good.collect()] == [1]
    assert sorted((r.taskId, tuple(r.missing)) for r in bad.collect()) == [(2, ("attemptId", "duration")),
                                                                          (3, ("stageId",))]


def test_documents_of_a_hot_stage_are_spread_over_partitions(spark):
    from pyspark.sql import functions as F
    from skewlens.sources.testdata import events_payload_rows, read_table, stage_documents
    events = read_table(spark, "/root/testdata/sf0.001", "events").withColumn(
        "user_id", F.when(F.col("event_id") % 5 < 3, F.lit(1)).otherwise(F.col("user_id")).cast("long"))
    events = events.withColumn("ts", F.lit("2024-01-01 00:00:00").cast(events.schema["ts"].dataType))
    docs = stage_documents(events_payload_rows(events), tasks_per_doc=10)
    docs = docs.select(F.spark_partition_id().alias("p"), F.size("tasks").alias("n"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r.n for r in docs.groupBy("p").agg(F.sum("n").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(sizes) == events.count() and max(sizes) < 0.4 * sum(sizes)


def test_bare_task_list_takes_its_ids_from_arguments_or_folders(spark, tmp_dir):
    from skewlens.operators.tasks import flatten_task_records
    write_json(f"{tmp_dir}/bare/list.json", [task_json(1), task_json(2)])
    given = flatten_task_records(read_task_list(spark, f"{tmp_dir}/bare", multi_line=True, app_id="a", stage_id=3 << 31,
                                                attempt_id=1))
    assert sorted(tuple(r)[:4] for r in given.collect()) == [("a", 3 << 31, 1, 1), ("a", 3 << 31, 1, 2)]
    write_json(f"{tmp_dir}/t/app_id=b/stageId=7/attemptId=2/list.json", [task_json(5)])
    found = flatten_task_records(read_task_list(spark, f"{tmp_dir}/t", multi_line=True))
    assert [tuple(r)[:4] for r in found.collect()] == [("b", 7, 2, 5)]


def test_event_and_user_ids_beyond_32_bits(spark):
    import datetime
    from skewlens.sources.testdata import events_jobs, events_payload_rows, events_tasks, stage_documents
    big = 1 << 40
    events = spark.createDataFrame(
        [(big + i, datetime.datetime(2026, 3, 4, 5, 6, 7), big, "signup", 310.0, f'{{"k": {i}}}') for i in range(3)],
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    assert sorted((r.stageId, r.attempt) for r in events_tasks(events).collect()) == [(big, big + i) for i in range(3)]
    assert [r.stageIds for r in events_jobs(events).collect()] == [[big]]
    assert sum(len(r.tasks) for r in stage_documents(events_payload_rows(events)).collect()) == 3
