import math

from pyspark.sql import functions as F

from skewlens.operators.skew import metric_flags, metric_long, skewed_stages, stage_skew, with_significance
from skewlens.operators.stats import STATS_COLUMNS
from skewlens.plans.analyze import analyze_tasks
from tests.conftest import flat_rows

STATS_SCHEMA = ("app_id string, stageId int, attemptId int, stageName string, stageStatus string, numTasks int, "
                "avgDuration double, maxDuration bigint, avgBytesRead double, maxBytesRead bigint, "
                "avgBytesWritten double, maxBytesWritten bigint, avgShuffleBytesRead double, "
                "maxShuffleBytesRead bigint, avgShuffleBytesWritten double, maxShuffleBytesWritten bigint")


def stats_df(spark, rows):
    defaults = dict(app_id="a", stageId=1, attemptId=0, stageName="s", stageStatus="COMPLETE", numTasks=4,
                    avgDuration=1.0, maxDuration=1, avgBytesRead=0.0, maxBytesRead=0, avgBytesWritten=0.0,
                    maxBytesWritten=0, avgShuffleBytesRead=0.0, maxShuffleBytesRead=0,
                    avgShuffleBytesWritten=0.0, maxShuffleBytesWritten=0)
    return spark.createDataFrame([tuple({**defaults, **r}[c] for c in STATS_COLUMNS) for r in rows], STATS_SCHEMA)


def test_gate_absolute_is_inclusive_and_relative_is_per_app(spark):
    df = stats_df(spark, [
        dict(app_id="a", stageId=1, maxDuration=1000, avgDuration=1000.0),
        dict(app_id="a", stageId=2, maxDuration=60, avgDuration=1.0),    # >= 60 s: significant
        dict(app_id="a", stageId=3, maxDuration=59, avgDuration=1.0),    # < 60 and < 200: not
        dict(app_id="b", stageId=4, maxDuration=50, avgDuration=50.0),
        dict(app_id="b", stageId=5, maxDuration=10, avgDuration=1.0),    # 10 >= 0.2 * 50 within app b
        dict(app_id="b", stageId=6, maxDuration=9, avgDuration=1.0),
    ])
    got = {r.stageId: r.isSignificant for r in with_significance(df).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False}
    skewed = sorted(r.stageId for r in skewed_stages(df, 3.0).collect())
    assert skewed == [2, 5]


def test_threshold_is_strict(spark):
    df = stats_df(spark, [dict(stageId=1, maxDuration=90, avgDuration=30.0),
                          dict(stageId=2, maxDuration=91, avgDuration=30.0)])
    assert [r.stageId for r in skewed_stages(df, 3.0).collect()] == [2]


def test_size_flag_uses_truncated_average_but_filter_does_not(spark):
    df = stats_df(spark, [dict(maxDuration=100, avgDuration=100.0, avgBytesRead=4.5, maxBytesRead=9)])
    (row,) = metric_flags(df, 2.0).collect()
    assert row.bytesReadSkewed is True           # 9 > 2 * 4
    assert skewed_stages(df, 2.0).count() == 0   # 9 > 2 * 4.5 is false


def test_fractional_average_prints_the_maximum_as_ratio(spark):
    df = stats_df(spark, [dict(avgBytesRead=0.5, maxBytesRead=1)])
    rows = {r.metric: r for r in metric_long(df, 3.0).collect()}
    assert rows["Bytes Read"].isSkewed is True and rows["Bytes Read"].displayRatio == 1.0
    assert rows["Bytes Read"].avg == 0


def test_ranking_highest_ratio_first_nan_last(spark):
    df = stats_df(spark, [
        # NaN ratio (0/0); passes the gate only because its app's longest task is 0 s too
        dict(app_id="z", stageId=1, maxDuration=0, avgDuration=0.0, avgBytesRead=1.0, maxBytesRead=100),
        dict(stageId=2, maxDuration=100, avgDuration=10.0),
        dict(stageId=3, maxDuration=100, avgDuration=20.0),
    ])
    jobs = spark.createDataFrame([("a", 2, [7, 3])], "app_id string, stageId int, jobIds array<int>")
    rows = stage_skew(df, jobs, 3.0).collect()
    assert [r.stageId for r in rows] == [2, 3, 1]
    assert math.isnan(rows[2].skewRatio)
    assert rows[0].jobIds == [7, 3] and rows[1].jobIds == [] and rows[0].stageDuration == 0


def test_empty_input_gives_empty_result(spark):
    empty = stats_df(spark, []).limit(0)
    jobs = spark.createDataFrame([], "app_id string, stageId int, jobIds array<int>")
    assert stage_skew(empty, jobs).count() == 0


def test_analyze_keeps_only_stages_listed_by_a_job(spark):
    tasks = flat_rows(spark, [dict(stageId=s, taskId=i, duration=d)
                              for s in (1, 2) for i, d in enumerate([10_000] * 9 + [100_000])])
    jobs = spark.createDataFrame([("app-1", 1, [4, 2])], "app_id string, stageId int, jobIds array<int>")
    report = analyze_tasks(tasks, jobs, 3.0).collect()
    assert [(r.stageId, r.jobIds) for r in report] == [(1, [4, 2])]
    assert report[0].block.startswith("[Stage Id: 1, Attempt Id: 0, Job Ids: (4,2), Task Count: 10]\n")


def test_raising_threshold_never_adds_stages(spark):
    df = stats_df(spark, [dict(stageId=i, maxDuration=60 + i, avgDuration=float(1 + i % 7),
                               maxBytesRead=i * 10, avgBytesRead=float(i)) for i in range(40)])
    previous = None
    for t in (1.0, 2.0, 3.0, 5.0, 8.0, 13.0):
        ids = {r.stageId for r in skewed_stages(df, t).select("stageId").collect()}
        if previous is not None:
            assert ids <= previous
        previous = ids


def test_skewed_row_has_a_flagged_metric(spark):
    df = stats_df(spark, [dict(stageId=i, maxDuration=60 + i, avgDuration=float(1 + i % 29),
                               maxBytesWritten=i * 7, avgBytesWritten=float(i % 5) + 0.5) for i in range(50)])
    flags = metric_flags(skewed_stages(df, 4.0), 4.0)
    names = ["durationSkewed", "bytesReadSkewed", "bytesWrittenSkewed", "shuffleBytesReadSkewed",
             "shuffleBytesWrittenSkewed"]
    anyflag = F.greatest(*[F.col(n).cast("int") for n in names])
    assert flags.filter(anyflag == 0).count() == 0
