"""Reductions before shuffles, layouts without shuffles, mergeable and exact aggregates, split reads, diagnosis."""

import bz2
import gzip
import json
import math
import os
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from skewlens.operators.jobs import stage_to_jobs
from skewlens.operators.rank import global_rank
from skewlens.operators.reduce import may_match
from skewlens.operators.skew import skewed_stages, with_significance
from skewlens.operators.stats import group_skew_stats
from skewlens.operators.tasks import dedup_tasks, explode_tasks, latest_attempt, latest_by_aggregate, merge_tasks
from skewlens.plans import catalog
from skewlens.plans.analyze import STAGE_ID, analyze, stats_from_tasks
from skewlens.schemas import STATS_PATHS
from skewlens.session import clear_scratch
from skewlens.sources import arrays, listing
from skewlens.sources.arrays import array_elements
from skewlens.sources.diagnosis import diagnose_jobs, diagnose_stages
from skewlens.sources.payloads import read_jobs, read_stages, read_task_list, required_stages
from skewlens.sources.sinks import write_bucketed_tasks
from skewlens.streaming import compact_stream, read_stream_stats, start_stage_stats_stream
from tests.conftest import flat_rows, stage_json, task_json
from tests.test_plans import plan

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple("NaN" if x != x else x for x in r) for r in df.collect()), key=repr)


@pytest.fixture()
def setting(spark):
    old = {}

    def put(key, value):
        old.setdefault(key, spark.conf.get(key))
        spark.conf.set(key, value)
    yield put
    for key, value in old.items():
        spark.conf.set(key, value)


# ------------------------------------------------------------------ semi-join reduction

@pytest.mark.parametrize("limit, extra", [(16 << 20, 0), (1 << 17, 2000)])
def test_no_matching_row_is_lost_and_few_others_pass(spark, limit, extra):
    df = spark.range(100_000).selectExpr("concat('app-', id % 3) app_id", "id stageId", "id x")
    keys = spark.range(0, 100_000, 10).selectExpr("concat('app-', id % 3) app_id", "id stageId", "'j' job").unionAll(
        spark.createDataFrame([(None, 3, "j")], "app_id string, stageId bigint, job string"))
    got = may_match(df, keys, STAGE_ID, limit)
    assert got.columns == df.columns
    assert got.where("stageId % 10 = 0").count() == 10_000
    assert got.where("stageId % 10 != 0").count() <= extra
    assert ("LeftSemi" in plan(got)) == (not extra) and "SortMergeJoin" not in plan(got)


def test_a_filter_that_rejects_nothing_is_left_out(spark):
    df = spark.range(30_000).selectExpr("'a' app_id", "id stageId")
    assert may_match(df, df, STAGE_ID, 4096).count() == 30_000
    assert "Join" not in plan(may_match(df, df, STAGE_ID, 4096))


def test_documents_of_unlisted_stages_go_before_the_shuffle(spark, tmp_dir):
    for i in range(40):
        _write(f"{tmp_dir}/stages/app_id=a/{i}.json", [stage_json(i, 0, [task_json(t, duration=1000 * t) for t in range(5)])])
    _write(f"{tmp_dir}/jobs/app_id=a/0.json", [{"jobId": 1, "name": "j", "submissionTime": "t", "completionTime": "t",
                                                "stageIds": [3, 4, 99]}])
    stages, jobs = read_stages(spark, f"{tmp_dir}/stages"), read_jobs(spark, f"{tmp_dir}/jobs")
    listed = may_match(stages, stage_to_jobs(jobs), STAGE_ID)
    assert explode_tasks(listed).count() == 10
    text = plan(stats_from_tasks(explode_tasks(listed)))
    assert 0 < text.index("LeftSemi") and "BroadcastHashJoin" in text
    assert {r.stageId for r in analyze(jobs, stages, 1.0).collect()} == {3, 4}


def test_a_damaged_document_of_an_unlisted_stage_still_fails(spark, tmp_dir):
    _write(f"{tmp_dir}/stages/app_id=a/0.json", [stage_json(1, 0, [task_json(0)]), stage_json(2, 0, [task_json(0, drop=("host",))])])
    _write(f"{tmp_dir}/jobs/app_id=a/0.json", [{"jobId": 1, "name": "j", "submissionTime": "t", "completionTime": "t", "stageIds": [1]}])
    with pytest.raises(Exception, match="missing required fields"):
        analyze(read_jobs(spark, f"{tmp_dir}/jobs"), read_stages(spark, f"{tmp_dir}/stages")).collect()


# ------------------------------------------------------------------ one copy of the statistics

def test_statistics_are_computed_once(spark):
    tasks = flat_rows(spark, [dict(stageId=i % 20, taskId=i, duration=1000 * (i % 90)) for i in range(400)])
    skewed = plan(skewed_stages(stats_from_tasks(tasks), 1.5))
    assert "Window" not in skewed and "partial_sum" not in skewed and skewed.count("functions=[partial_max") <= 1
    gate = plan(with_significance(stats_from_tasks(tasks)))
    assert "Window" not in gate and "partial_sum" not in gate and gate.count("Scan parquet") >= 1


def test_stages_of_a_minute_pass_without_the_maximum(spark):
    tasks = flat_rows(spark, [dict(app_id=a, stageId=s, taskId=t, duration=d)
                              for a, s, d in (("a", 1, 59_999), ("a", 2, 60_000), ("a", 3, 400_000), ("b", 4, 9_000), ("b", 5, 1_000))
                              for t, d in ((0, d), (1, 10), (2, 10), (3, 10), (4, 10))])
    # 59 s < 0.2 * 400 s goes; 60 s stays whatever the maximum; in app b 9 s is the maximum and 1 s < 0.2 * 9 s goes.
    assert sorted(r.stageId for r in skewed_stages(stats_from_tasks(tasks), 3.0).collect()) == [2, 3, 4]


# ------------------------------------------------------------------ bucketed layout

def test_bucketed_tasks_are_deduplicated_without_a_shuffle(spark, tmp_dir):
    rows = [dict(app_id=f"app-{i % 2}", stageId=1, taskId=i % 700, attempt=i, duration=i) for i in range(1400)]      # hot
    rows += [dict(stageId=2 + i % 50, taskId=i, attempt=0, duration=i) for i in range(1400)]
    tasks = flat_rows(spark, rows)
    write_bucketed_tasks(tasks, "bucketed_tasks_test", f"{tmp_dir}/bucketed", 8)
    try:
        table = spark.table("bucketed_tasks_test").select(*tasks.columns)
        got = dedup_tasks(table)
        text = plan(got)
        assert "Window" in text and "Exchange" not in text and "WindowGroupLimit" in text
        assert rows_of(got) == rows_of(dedup_tasks(tasks))
        parts = dedup_tasks(table).where("stageId = 1").groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) >= 6 and max(r["count"] for r in parts) < 350
        stats = plan(stats_from_tasks(table))
        assert stats.count("Exchange hashpartitioning") + stats.count("+- Exchange") <= 2
        assert rows_of(stats_from_tasks(table)) == rows_of(stats_from_tasks(tasks))
    finally:
        spark.sql("drop table bucketed_tasks_test")


# ------------------------------------------------------------------ mergeable top-1

def test_aggregate_picks_what_the_window_picks(spark):
    r = random.Random(1)
    some = lambda *values: r.choice([None, *values])
    rows = [(r.randrange(30), some(True, False), some(1, 2, -2 ** 63, 2 ** 63 - 1), some(0.0, -1.5, float("nan"), float("inf")),
             some("2024-01-01", "1969-05-05"), some("2024-01-01 10:00:00", "1960-01-01 00:00:00.000001"), some("a", "B", ""), i)
            for i in range(600)]
    df = spark.createDataFrame(rows, "k int, ok boolean, n bigint, x double, d string, t string, s string, id int")
    df = df.withColumn("d", F.col("d").cast("date")).withColumn("u", F.col("t").cast("timestamp")).withColumn(
        "t", F.col("t").cast("timestamp_ntz"))
    for order in ([("n", True), ("s", False), ("id", True)], [("x", True), ("d", True), ("id", False)], [("t", True), ("x", False), ("id", True)],
                  [("u", True), ("ok", True), ("id", False)], [("s", False), ("t", False), ("id", False)]):
        cols = [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
        for prefer in (None, F.col("ok")):
            want = rows_of(latest_attempt(df, ["k"], cols, prefer))
            assert rows_of(latest_by_aggregate(df, ["k"], order, prefer)) == want
            halves = [latest_by_aggregate(df.where(f"id % 2 = {i}"), ["k"], order, prefer) for i in (0, 1)]
            assert rows_of(latest_by_aggregate(halves[0].unionByName(halves[1]), ["k"], order, prefer)) == want
    with pytest.raises(ValueError):
        latest_by_aggregate(df, ["k"], [("s", True)])


def test_merged_tasks_equal_deduplicated_tasks(spark):
    r = random.Random(2)
    tasks = flat_rows(spark, [dict(stageId=r.randrange(4), taskId=r.randrange(20), attempt=r.randrange(3), duration=r.randrange(5),
                                   status=r.choice(["SUCCESS", "FAILED", "KILLED", None])) for _ in range(500)])
    assert rows_of(merge_tasks(tasks)) == rows_of(dedup_tasks(tasks))
    text = plan(merge_tasks(tasks))
    assert "partial_min_by" in text and "Window" not in text


def _write(path, docs, whole=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(whole if whole is not None else "".join(json.dumps(d) + "\n" for d in docs))


def test_stream_is_merged_and_goes_on(spark, tmp_dir):
    src, out = f"{tmp_dir}/in", f"{tmp_dir}/out"
    run = lambda: start_stage_stats_stream(spark, src, out, f"{tmp_dir}/ckpt", available_now=True).awaitTermination(120)
    _write(f"{src}/app_id=a/0.json", [stage_json(4, 0, [task_json(1, duration=4000, status="FAILED"), task_json(2, duration=2000)]),
                                      stage_json(5, 0, [task_json(1, duration=1000)])])
    run()
    first = rows_of(read_stream_stats(spark, out))
    assert compact_stream(spark, out) == 0 and rows_of(read_stream_stats(spark, out)) == first
    assert compact_stream(spark, out) is None
    # A late retry, a document once more, and one with newer stage fields and only an older attempt.
    _write(f"{src}/app_id=a/1.json", [stage_json(4, 0, [task_json(1, duration=6000, attempt=1), task_json(2, duration=2000)]),
                                      stage_json(5, 0, [task_json(1, duration=9000, status="FAILED")], num_tasks=77)])
    run()
    want = rows_of(read_stream_stats(spark, out))
    assert [(r[1], r[5], r[6], r[7]) for r in want] == [(4, 2, 4.0, 6), (5, 77, 1.0, 1)]
    assert compact_stream(spark, out) == 1 and rows_of(read_stream_stats(spark, out)) == want
    assert spark.read.parquet(f"{out}_merged/tasks/upto=1").count() == 3
    with pytest.raises(FileNotFoundError):
        read_stream_stats(spark, f"{tmp_dir}/none")


# ------------------------------------------------------------------ arrays split across tasks

def _tasks(n):
    odd = ['x"}, {"y', "back\\slash\\\\", "{[}]", 'tail\\"', "é😀", "", "a,b: [1, 2]"]
    return [task_json(i, duration=i) | {"host": odd[i % len(odd)], "executorId": odd[(i * 3) % len(odd)]} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", ["73b", "500b", "4k"])
def test_split_arrays_equal_whole_arrays(spark, tmp_dir, setting, indent, size):
    for s in (1, 2):
        _write(f"{tmp_dir}/t/app_id=a/stageId={s}/attemptId=0/tasks.json", [], json.dumps(_tasks(40 + s), indent=indent, ensure_ascii=False))
    _write(f"{tmp_dir}/t/app_id=a/stageId=3/attemptId=1/none.json", [], "[ ]\n")
    want = rows_of(read_task_list(spark, f"{tmp_dir}/t", multi_line=True).where("taskId is not null"))
    setting("spark.sql.files.maxPartitionBytes", size)
    setting("spark.sql.files.openCostInBytes", "0")
    split = read_task_list(spark, f"{tmp_dir}/t", multi_line="split")
    assert rows_of(split) == want and len(want) == 83
    assert spark.read.option("lineSep", "}").text(f"{tmp_dir}/t").rdd.getNumPartitions() > 2


def test_files_of_one_block_need_no_index(spark, tmp_dir, setting, monkeypatch):
    """Small files are left out of the index on the driver, and nothing of them is shuffled."""
    for s in range(6):
        _write(f"{tmp_dir}/t/app_id=a/stageId={s}/attemptId=0/tasks.json", [], json.dumps(_tasks(20 + s)))
    cut = json.dumps(_tasks(3))
    _write(f"{tmp_dir}/t/app_id=a/stageId=7/attemptId=0/tasks.json", [], cut[:cut.rindex('"resultSize"')])
    _write(f"{tmp_dir}/t/app_id=a/stageId=8/attemptId=0/tasks.json", [], "\n".join(map(json.dumps, _tasks(3))))
    made = []
    index = arrays.block_index
    monkeypatch.setattr(arrays, "block_index", lambda df: made.append(index(df)) or made[-1])
    small = rows_of(array_elements(spark, f"{tmp_dir}/t"))
    assert len(small) == sum(range(20, 26)) + 3 + 3 and made[0].count() == 0
    assert "Exchange" not in plan(array_elements(spark, f"{tmp_dir}/t"))
    setting("spark.sql.files.openCostInBytes", "0")
    setting("spark.sql.files.maxPartitionBytes", "900b")
    assert rows_of(array_elements(spark, f"{tmp_dir}/t")) == small and made[-1].count() > 20


TREES = {
    "ids": ["app_id=a%2Fb/stageId=7/x", "app_id=[z]/stageId=9999999999/x", "app_id=é+1/stageId=-3/x", "app_id=__HIVE_DEFAULT_PARTITION__/stageId=007/x"],
    "numbers": ["k=1.5/d=2020-01-01/x", "k=7/d=2020-02-30/x"],
    "dates": ["k=123456789012345678901234/d=2020-01-01/x", "k=7/d=__HIVE_DEFAULT_PARTITION__/x", "k=0012/d=2020-1-2/x"],
    "times": ["t=2020-01-01 10%3A00%3A00/k=1e3/x", "t=2020-01-02/k=12/x"],
    "none": ["k=__HIVE_DEFAULT_PARTITION__/x"],
    "hidden": ["k=1/x", "k=1/_x", "k=2/.x", "_k/x", ".k=3/x", "k=4/x._COPYING_", "_k=5/x"],
    "beside": ["k=1/x", "y"],
    "below": ["top/k=1/x", "top/k=2/y"],
    "plain": ["x", "y", "z/x", "z/w/x", "k=v.json"],
    "empty": [],
    "conflict": ["k=1/x", "top/k=1/x"],
    "names": ["k=1/x", "l=1/x"],
    "mixed": ["k=1/x", "z/x"],
    "packed": ["k=1/x.gz", "k=2/x.bz2", "k=3/x.deflate", "k=4/x.GZ"],
}


@pytest.mark.parametrize("here", [0, 1000])
@pytest.mark.parametrize("tree", TREES)
def test_files_are_found_as_spark_finds_them(spark, tmp_dir, monkeypatch, tree, here):
    """The files, the columns of the folders, their types and values, and what is refused."""
    monkeypatch.setattr(listing, "LISTED_HERE", here)
    os.makedirs(f"{tmp_dir}/t o")
    pack = {"gz": gzip.compress, "bz2": bz2.compress, "deflate": zlib.compress}
    for name in TREES[tree]:
        path = f"{tmp_dir}/t o/{name}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(pack.get(name.rsplit(".")[-1].lower(), bytes)(json.dumps([{"a": name}, {"a": "}"}]).encode()))
    try:
        want = spark.read.schema("a string").option("multiLine", True).json(f"{tmp_dir}/t o").where("a is not null")
        rows = rows_of(want.select(*want.columns[1:], "a"))
    except Exception as e:
        with pytest.raises(type(e)):
            array_elements(spark, f"{tmp_dir}/t o")
        return
    got = array_elements(spark, f"{tmp_dir}/t o").withColumn("value", F.from_json("value", "a string")["a"])
    assert [t for _, t in got.dtypes] == [t for _, t in want.dtypes[1:]] + ["string"] and got.columns[:-1] == want.columns[1:]
    assert rows_of(got) == rows
    assert rows or tree == "empty"


def test_several_paths_patterns_and_single_files(spark, tmp_dir, monkeypatch):
    for i in range(3):
        _write(f"{tmp_dir}/t/app{i}/x.json", [], json.dumps([{"a": i}]))
    for path in ([f"{tmp_dir}/t/app0", f"{tmp_dir}/t/app2"], f"{tmp_dir}/t/app[01]", f"{tmp_dir}/t/app1/x.json", f"file:{tmp_dir}/t/app1/"):
        want = rows_of(spark.read.option("multiLine", True).json(path))
        for here in (0, 1000):
            monkeypatch.setattr(listing, "LISTED_HERE", here)
            assert rows_of(array_elements(spark, path).select(F.from_json("value", "a bigint")["a"])) == want
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        array_elements(spark, f"{tmp_dir}/t/none")
    # A store that the tasks cannot open is listed by Spark.
    monkeypatch.setattr(listing, "opened_by_tasks", lambda roots: None)
    assert array_elements(spark, f"{tmp_dir}/t/app*").count() == 3


def test_the_driver_does_not_know_the_folders(spark, tmp_dir, monkeypatch):
    """However many stage attempts there are, the driver gets a few of their files' names and Spark's own listing gets no more."""
    monkeypatch.setattr(listing, "LISTED_HERE", 0)
    monkeypatch.setattr(listing, "FOLDERS_PER_TASK", 20)
    known = []
    for module in (listing, arrays):
        monkeypatch.setattr(module, "text_files", lambda spark, paths, f=listing.text_files, **o: known.append(len(paths)) or f(spark, paths, **o))
    for s in range(150):
        for a in (0, 1):
            _write(f"{tmp_dir}/t/app_id=app-{s % 3}/stageId={s}/attemptId={a}/tasks.json", [], json.dumps([{"taskId": s, "attempt": a}]))
    df = read_task_list(spark, f"{tmp_dir}/t", multi_line="split")
    assert known and max(known) <= 8
    assert "FileScan" not in plan(df) and "Exchange" not in plan(df)
    assert rows_of(df.select("app_id", "stageId", "attemptId", "taskId", "attempt")) == sorted(
        ((f"app-{s % 3}", s, a, s, a) for s in range(150) for a in (0, 1)), key=repr)
    # What is read is of unknown size to the planner: not as small as the names of the files, which it might broadcast.
    assert int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > 1 << 40


def test_fragments_of_a_file_are_those_of_the_text_reader(spark, tmp_dir, monkeypatch):
    texts = ["", "}", "}}a", "[{\"é😀\": 1}, {}]\n", "no brace", "x}" * 5, "\n}\n"]
    for piece in (1, 2, 3, 1 << 20):
        monkeypatch.setattr(arrays, "_PIECE", piece)
        for text in texts:
            _write(f"{tmp_dir}/{piece}/x", [], text)
            got = [v for values in arrays.file_fragments(open(f"{tmp_dir}/{piece}/x", "rb")) for v in values]
            assert got == [r[0] for r in spark.read.option("lineSep", "}").text(f"{tmp_dir}/{piece}/x").collect()]


def test_kinds_of_values():
    assert [listing.value_kind(v) for v in ("7", "-2147483648", "2147483648", "app-1", "3f2a9", "application_17_01")] == [
        "int", "int", "long", "text", "text", "text"]
    for v in ("1.5", "12e4", "NaN", "0x1p3", "2020-01-01", "2020-01-01 10%3A00", "1" * 19, "٣"):
        assert listing.value_kind(v) == f"value {v}"


def test_arrays_of_the_payload_are_written_by_the_tasks(spark, monkeypatch):
    """One file per stage attempt in its folder; the events, not the tasks made of them, are shuffled."""
    from skewlens.sources import testdata
    monkeypatch.setattr(testdata, "_WRITTEN", {})
    seen, write = [], testdata.write_arrays
    monkeypatch.setattr(testdata, "write_arrays", lambda df, *args: seen.append((plan(df), write(df, *args))))
    path = testdata.write_payload(spark, SF, "tasks", variant="arrays")
    folders = {r[0] for r in testdata.events_tasks(testdata.read_table(spark, SF, "events")).selectExpr(
        "concat('app_id=', app_id, '/stageId=', stageId, '/attemptId=', attemptId)").distinct().collect()}
    top = path.removeprefix("file:")
    found = {os.path.relpath(where, top): names for where, _, names in os.walk(top) if names}
    assert found == {f: ["tasks.json"] for f in folders} and seen[0][1] == len(folders)
    exchange = seen[0][0].split("Exchange")[1]
    assert "taskMetrics" not in exchange and "date_format" not in exchange
    assert testdata._folder("k", None) == "k=__HIVE_DEFAULT_PARTITION__" and testdata._folder("k", "a/b=c") == "k=a%2Fb%3Dc"


@pytest.mark.parametrize("kind", ["stages", "tasks"])
def test_payloads_grow_after_their_shuffles_and_sort(spark, kind):
    """No exchange or sort of the payload's write holds the tasks, only the events that they are made of."""
    from skewlens.sources import testdata
    rows = testdata._event_rows(testdata.read_table(spark, SF, "events"), "task")
    made = testdata.payload_task
    df = (testdata.stage_documents(rows, 1000, lambda task: made(event=task)) if kind == "stages"
          else testdata._by_app(rows).withColumn("task", made(event=F.col("task"))))
    logical = df._jdf.queryExecution().optimizedPlan().toString()
    assert "resultSize" in logical.split("Sort")[0] and "resultSize" not in logical.split("Sort")[1]
    assert dict(df.dtypes)["app_id"] == "string" and not df.schema["app_id"].nullable


def test_an_element_of_many_blocks_and_odd_files(spark, tmp_dir, setting):
    big = stage_json(1, 0, [task_json(i, duration=i) for i in range(60)])
    _write(f"{tmp_dir}/s/app_id=a/stages.json", [], json.dumps([stage_json(0, 0, []), big, stage_json(2, 0, [task_json(1)])]))
    _write(f"{tmp_dir}/s/app_id=b/one.json", [], json.dumps(stage_json(7, 0, [task_json(5)]), indent=1))
    _write(f"{tmp_dir}/s/app_id=c/cut.json", [], json.dumps([stage_json(8, 0, [task_json(1)]), stage_json(9, 0, [task_json(2)])])[:-30])
    setting("spark.sql.files.maxPartitionBytes", "300b")
    setting("spark.sql.files.openCostInBytes", "0")
    got = read_stages(spark, f"{tmp_dir}/s", multi_line="split")
    good, bad = required_stages(got)
    assert sorted((r.app_id, r.stageId, len(r.tasks)) for r in good.collect()) == [("a", 0, 0), ("a", 1, 60), ("a", 2, 1), ("b", 7, 1), ("c", 8, 1)]
    assert [r.app_id for r in bad.collect()] == ["c"]
    assert array_elements(spark, f"{tmp_dir}/s").count() == 6


def test_jobs_of_an_array_without_folders(spark, tmp_dir):
    jobs = [{"jobId": i, "name": "n{", "submissionTime": "t", "completionTime": "t", "stageIds": [i, i + 1]} for i in range(9)]
    _write(f"{tmp_dir}/j/jobs.json", [], json.dumps(jobs, indent=2))
    got = read_jobs(spark, f"{tmp_dir}/j", multi_line="split", app_id="z")
    assert rows_of(got) == rows_of(read_jobs(spark, f"{tmp_dir}/j", multi_line=True, app_id="z")) and got.count() == 9


# ------------------------------------------------------------------ typed diagnosis

def test_every_fault_is_named(spark, tmp_dir):
    good = stage_json(1, 0, [task_json(0)])
    several = stage_json(2, 0, [task_json(0, drop=("host",)), task_json(1) | {"duration": "long", "status": None},
                                task_json(2) | {"attempt": 1.5, "taskMetrics": 7}])
    several = several | {"name": 5, "numTasks": 2 ** 40}
    del several["status"]
    _write(f"{tmp_dir}/s/app_id=a/0.json", [], "\n".join([json.dumps(good), json.dumps(several), '{"stageId": 3,', "",
                                                          json.dumps(stage_json(4, 0, [])), json.dumps(stage_json(5, 0, []) | {"tasks": []})]))
    got = {r.stageId: r.reasons for r in diagnose_stages(spark, f"{tmp_dir}/s").collect()}
    assert got[1] == [] and got[4] == [] and got[None] == ["malformed record"] and got[5] == ["wrong type tasks"]
    assert [x for x in got[2] if "taskMetrics" not in x] == [
        "wrong type name", "missing status", "wrong type numTasks", "wrong type tasks.attempt", "wrong type tasks.duration",
        "missing tasks.host", "missing tasks.status"]
    assert sum("missing tasks.taskMetrics" in x for x in got[2]) == 14
    accepted = {r.stageId for r in required_stages(read_stages(spark, f"{tmp_dir}/s"))[0].collect()}
    assert accepted == {1, 4}
    jobs = [{"jobId": 1, "name": "j", "submissionTime": "t", "completionTime": "t", "stageIds": [1]},
            {"jobId": "2", "name": "j", "submissionTime": "t", "stageIds": "all"}]
    _write(f"{tmp_dir}/j/0.json", jobs)
    assert {r.jobId: r.reasons for r in diagnose_jobs(spark, f"{tmp_dir}/j", "a").collect()} == {
        1: [], 2: ["wrong type jobId", "missing completionTime", "wrong type stageIds"]}


# ------------------------------------------------------------------ global rank, narrowed reads, exact sums

def test_global_rank_uses_no_single_task(spark):
    df = spark.range(5000).selectExpr("id", "(id * 7919) % 1000 x")
    got = global_rank(df, [F.col("x").desc(), F.col("id").asc()], "place")
    assert "SinglePartition" not in plan(got)
    want = sorted(((i * 7919) % 1000, -i) for i in range(5000))[::-1]
    assert [(r.x, -r.id) for r in got.orderBy("place").collect()] == want
    assert sorted(r.place for r in got.collect()) == list(range(1, 5001))
    assert global_rank(df.where("id < 0"), [F.col("x").asc()]).count() == 0
    assert "SinglePartition" not in plan(catalog.QUERIES["skew_rank"](spark, SF))


def test_narrowed_read_parses_what_the_statistics_use(spark):
    whole, narrow = (catalog.QUERIES[q](spark, SF) for q in ("stats_from_payloads", "stats_from_payloads_trusted"))
    assert rows_of(whole) == rows_of(narrow)
    assert "executorId" not in plan(narrow) and "recordsRead" not in plan(narrow) and "bytesRead" in plan(narrow)
    assert len(STATS_PATHS) == 14


def test_sums_of_doubles_are_exact_in_any_order(spark):
    r = random.Random(3)
    groups = {1: [r.uniform(-1, 1) * 10 ** r.randrange(0, 9) for _ in range(400)], 2: [0.1] * 1000, 3: [1e300, 1.0, -1e300], 4: [5e-324] * 3,
              5: [None, 2.5, None], 6: [None], 7: [float("inf"), 1.0], 8: [float("inf"), float("-inf")], 9: [float("nan"), 1.0],
              10: [0.0, -0.0], 11: [r.choice([-1, 1]) * math.ldexp(r.random(), r.randrange(-1000, 1000)) for _ in range(300)],
              12: [1.7976931348623157e308, -1.7976931348623157e308, 3.0], 13: [math.ldexp(1, 32 * k) for k in range(-3, 4)]}
    rows = [(k, x, 3 * i) for k, xs in groups.items() for i, x in enumerate(xs)]
    got = {}
    for parts in (1, 7):
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "k int, x double, n bigint").repartition(parts)
        out = {row.k: row for row in group_skew_stats(df, ["k"], ["x", "n"]).collect()}
        for k, row in out.items():
            assert repr(row.avg_x) == repr(got.setdefault(k, row.avg_x))
            xs = [x for x in groups[k] if x is not None]
            assert row.avg_n == 3 * sum(range(len(groups[k]))) / len(groups[k])
            if not xs:
                assert row.avg_x is None
            elif not all(map(math.isfinite, xs)):
                assert repr(row.avg_x) == repr(sum(xs) / len(xs))
            else:
                want = float(sum(map(Fraction, xs))) / len(xs)
                assert row.avg_x == want if k not in (1, 11, 13) else row.avg_x == pytest.approx(want, rel=1e-15)
    assert group_skew_stats(df.where("k < 0"), ["k"], ["x"]).count() == 0


# ------------------------------------------------------------------ payloads of a session

def test_payloads_are_written_again_after_the_scratch_folder_went(spark):
    first = catalog.QUERIES["src_jobs"](spark, SF).count()
    clear_scratch(spark)
    assert catalog.QUERIES["src_jobs"](spark, SF).count() == first > 0


def test_stage_fields_meet_aggregated_rows_only(spark, tmp_dir):
    src, out = f"{tmp_dir}/in", f"{tmp_dir}/out"
    _write(f"{src}/app_id=a/0.json", [stage_json(4, 0, [task_json(1), task_json(2)])])
    start_stage_stats_stream(spark, src, out, f"{tmp_dir}/ckpt", available_now=True).awaitTermination(120)
    tree = plan(read_stream_stats(spark, out)).split("(1) Scan")[0]
    assert tree.index("Join") < tree.index("Aggregate") and "Window" not in tree
