import pytest

from skewlens.operators.stats import stage_stats
from tests.conftest import flat_rows

SAMPLE_DURATIONS = [20, 15, 18, 16, 17, 19, 21, 14, 22, 13, 24, 12, 25, 11, 80, 10, 9, 8, 7, 15]


def test_small_stage_golden(spark):
    # 20 successful tasks, 376 ms in total, the longest 80 ms, no bytes at all.
    assert sum(SAMPLE_DURATIONS) == 376 and max(SAMPLE_DURATIONS) == 80
    df = flat_rows(spark, [dict(taskId=i, duration=d) for i, d in enumerate(SAMPLE_DURATIONS)])
    (row,) = stage_stats(df).collect()
    assert row.avgDuration == pytest.approx(0.0188)
    assert row.maxDuration == 0
    assert (row.avgBytesRead, row.maxBytesRead, row.maxShuffleBytesWritten) == (0.0, 0, 0)


def test_skewed_stage_golden(spark):
    df = flat_rows(spark, [dict(taskId=i, duration=10_000) for i in range(9)] + [dict(taskId=9, duration=100_000)])
    (row,) = stage_stats(df).collect()
    assert (row.avgDuration, row.maxDuration) == (19.0, 100)


def test_max_duration_truncates_and_attempts_stay_separate(spark):
    df = flat_rows(spark, [dict(taskId=1, duration=2999), dict(taskId=1, duration=61_999, attemptId=1)])
    got = sorted((r.attemptId, r.maxDuration, r.avgDuration) for r in stage_stats(df).collect())
    assert got == [(0, 2, 2.999), (1, 61, 61.999)]
