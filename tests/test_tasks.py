from pyspark.sql import functions as F

from skewlens.operators.tasks import dedup_tasks, explode_tasks, status_rank
from skewlens.sources.payloads import read_stages
from tests.conftest import flat_rows, stage_json, task_json, write_json


def test_explode_flattens_and_drops_attempts_without_tasks(spark, tmp_dir):
    stages = [
        stage_json(5, 0, [task_json(31, duration=11, bytes_read=100, remote=3, local=4, bytes_written=9,
                                    shuffle_written=2)]),
        stage_json(6, 0, []),  # no tasks: vanishes (inner explode)
    ]
    write_json(f"{tmp_dir}/stages/app_id=app-7/stage.json", stages)
    flat = explode_tasks(read_stages(spark, f"{tmp_dir}/stages", multi_line=True))
    rows = [r.asDict() for r in flat.collect()]
    assert rows == [dict(app_id="app-7", stageId=5, attemptId=0, stageName="stage", stageStatus="COMPLETE",
                         numTasks=1, taskId=31, attempt=0, status="SUCCESS", duration=11, resultSize=1500,
                         jvmGcTime=4, bytesRead=100, bytesWritten=9, shuffleBytesRead=7, shuffleBytesWritten=2)]


def test_status_rank_exact_case_sensitive_and_null(spark):
    df = spark.createDataFrame([("SUCCESS",), ("success",), ("FAILED",), (None,), ("SUCCESS ",)], "status string")
    got = [r[0] for r in df.select(status_rank(F.col("status"))).collect()]
    assert got == [1, 2, 2, 2, 2]


def test_dedup_prefers_success_then_latest_attempt(spark):
    df = flat_rows(spark, [
        dict(taskId=1, attempt=0, status="SUCCESS", duration=100),
        dict(taskId=1, attempt=1, status="FAILED", duration=200),   # later but failed
        dict(taskId=2, attempt=0, status="FAILED", duration=300),
        dict(taskId=2, attempt=1, status="FAILED", duration=400),   # latest failed wins
        dict(taskId=3, attempt=0, status="KILLED", duration=500),
        dict(taskId=1, attempt=5, status="SUCCESS", duration=600, attemptId=1),  # other stage attempt
    ])
    got = sorted((r.attemptId, r.taskId, r.duration) for r in dedup_tasks(df).collect())
    assert got == [(0, 1, 100), (0, 2, 400), (0, 3, 500), (1, 1, 600)]


def test_dedup_keeps_schema_and_is_idempotent(spark):
    df = flat_rows(spark, [dict(taskId=i % 3, attempt=i, status="SUCCESS" if i % 2 else "FAILED") for i in range(9)])
    once = dedup_tasks(df)
    assert once.columns == df.columns
    assert sorted(once.collect()) == sorted(dedup_tasks(once).collect())
    assert once.count() == once.select("taskId").distinct().count() == 3


def test_index_key_folds_retries_with_new_task_ids(spark, tmp_dir):
    from skewlens.plans.analyze import stats_from_tasks
    failed = dict(task_json(31, duration=90_000, status="FAILED"), index=3)
    retry = dict(task_json(52, duration=1_000, attempt=1), index=3)
    other = dict(task_json(32, duration=1_000), index=4)
    write_json(f"{tmp_dir}/stages/app_id=a/s.json", [stage_json(1, 0, [failed, retry, other])])
    stages = read_stages(spark, f"{tmp_dir}/stages", multi_line=True)
    by_id = stats_from_tasks(explode_tasks(stages)).first()
    by_index = stats_from_tasks(explode_tasks(stages, with_index=True), task_key="index").first()
    assert (by_id.maxDuration, by_index.maxDuration) == (90, 1)     # the failed try no longer counts
    assert dedup_tasks(explode_tasks(stages, with_index=True), "index").count() == 2


def test_latest_attempt_prefer_then_order(spark):
    from skewlens.operators.tasks import latest_attempt
    df = spark.createDataFrame([(1, None, 5), (1, True, 1), (1, False, 9), (2, None, 3), (2, False, 4)],
                               "k int, ok boolean, v int")
    got = sorted(tuple(r) for r in latest_attempt(df, ["k"], [F.col("v").desc()], prefer=F.col("ok")).collect())
    assert got == [(1, True, 1), (2, False, 4)]
