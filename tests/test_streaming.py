import json
import os

from skewlens.plans.analyze import stats_from_stages
from skewlens.sources.payloads import read_stages
from skewlens.streaming import read_stream_partials, read_stream_stats, start_stage_stats_stream
from tests.conftest import stage_json, task_json


def _drop(path, docs):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        for d in docs:
            f.write(json.dumps(d) + "\n")


def test_stream_matches_batch(spark, tmp_dir):
    src = f"{tmp_dir}/in"
    _drop(f"{src}/app_id=a/1.json", [stage_json(1, 0, [task_json(i, duration=1000 * (i + 1)) for i in range(5)])])
    _drop(f"{src}/app_id=b/2.json", [stage_json(2, 0, [task_json(1, duration=5, status="FAILED"),
                                                       task_json(1, duration=7, attempt=1)]),
                                     stage_json(3, 0, [task_json(9, drop=("host",))])])
    q = start_stage_stats_stream(spark, src, f"{tmp_dir}/out", f"{tmp_dir}/ckpt", f"{tmp_dir}/bad",
                                 available_now=True)
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in read_stream_stats(spark, f"{tmp_dir}/out").collect())
    good = read_stages(spark, src).filter("stageId != 3")
    want = sorted(tuple(r) for r in stats_from_stages(good).collect())
    assert got == want and len(got) == 2
    assert spark.read.json(f"{tmp_dir}/bad").count() == 1


def test_stream_restart_processes_only_new_files(spark, tmp_dir):
    src = f"{tmp_dir}/in"
    _drop(f"{src}/app_id=a/1.json", [stage_json(1, 0, [task_json(i, duration=10 * i) for i in range(4)])])
    args = (spark, src, f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    start_stage_stats_stream(*args, available_now=True).awaitTermination(120)
    start_stage_stats_stream(*args, available_now=True).awaitTermination(120)   # nothing new
    assert read_stream_stats(spark, f"{tmp_dir}/out").count() == 1
    _drop(f"{src}/app_id=a/2.json", [stage_json(2, 0, [task_json(9, duration=5)])])
    start_stage_stats_stream(*args, available_now=True).awaitTermination(120)
    assert sorted(r.stageId for r in read_stream_stats(spark, f"{tmp_dir}/out").collect()) == [1, 2]
    got = sorted((r.stageId, r.batch) for r in read_stream_partials(spark, f"{tmp_dir}/out").collect())
    assert [s for s, _ in got] == [1, 2] and got[0][1] < got[1][1]


def test_attempt_split_over_micro_batches_merges_exactly(spark, tmp_dir):
    src = f"{tmp_dir}/in"
    pieces = [[task_json(i, duration=1000 * (i + 1), bytes_read=7 * i) for i in range(k, k + 3)] for k in (0, 3, 6)]
    for n, piece in enumerate(pieces):
        _drop(f"{src}/app_id=a/{n}.json", [stage_json(4, 0, piece, num_tasks=9)])
    start_stage_stats_stream(spark, src, f"{tmp_dir}/out", f"{tmp_dir}/ckpt", available_now=True,
                             max_files_per_trigger=1).awaitTermination(120)
    assert read_stream_partials(spark, f"{tmp_dir}/out").select("batch").distinct().count() == 3
    got = [tuple(r) for r in read_stream_stats(spark, f"{tmp_dir}/out").collect()]
    want = [tuple(r) for r in stats_from_stages(read_stages(spark, src)).collect()]
    assert got == want and got[0].__len__() == 16


def test_streamed_statistics_feed_the_ranked_report(spark, tmp_dir):
    from skewlens.operators.jobs import stage_to_jobs
    from skewlens.operators.skew import stage_skew
    from skewlens.plans.analyze import analyze, with_report_block
    from skewlens.sources.payloads import read_jobs
    src = f"{tmp_dir}/in"
    skewed = [task_json(i, duration=10_000) for i in range(9)] + [task_json(9, duration=100_000)]
    _drop(f"{src}/app_id=a/1.json", [stage_json(1, 0, skewed)])
    _drop(f"{tmp_dir}/jobs/app_id=a/j.json", [{"jobId": 3, "name": "j", "submissionTime": "t",
                                              "completionTime": "t", "stageIds": [1]}])
    start_stage_stats_stream(spark, src, f"{tmp_dir}/out", f"{tmp_dir}/ckpt", available_now=True).awaitTermination(120)
    jobs = read_jobs(spark, f"{tmp_dir}/jobs")
    streamed = with_report_block(stage_skew(read_stream_stats(spark, f"{tmp_dir}/out"), stage_to_jobs(jobs), 3.0))
    batch = analyze(jobs, read_stages(spark, src), 3.0)
    assert [r.block for r in streamed.collect()] == [r.block for r in batch.collect()]


def test_document_delivered_twice_and_late_retry_count_once(spark, tmp_dir):
    src = f"{tmp_dir}/in"
    first = [task_json(1, duration=4000, status="FAILED"), task_json(2, duration=2000)]
    _drop(f"{src}/app_id=a/0.json", [stage_json(4, 0, first), stage_json(5, 0, [task_json(9, drop=("host",))])])
    _drop(f"{src}/app_id=a/1.json", [stage_json(4, 0, [task_json(1, duration=6000, attempt=1), task_json(2, duration=2000)])])
    start_stage_stats_stream(spark, src, f"{tmp_dir}/out", f"{tmp_dir}/ckpt", available_now=True,
                             max_files_per_trigger=1).awaitTermination(120)
    got = [(r.stageId, r.avgDuration, r.maxDuration) for r in read_stream_stats(spark, f"{tmp_dir}/out").collect()]
    assert got == [(4, 4.0, 6)]
    assert spark.read.json(f"{tmp_dir}/out_rejected").count() == 1
