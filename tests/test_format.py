from pyspark.sql import functions as F

from skewlens.functions.format import metric_line, pretty_bytes, pretty_time
from skewlens.operators.skew import metric_long
from skewlens.plans.analyze import analyze_tasks
from tests.conftest import flat_rows


def one(spark, col, value, dtype):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(col(F.col("x"))).first()[0]


def test_pretty_time(spark):
    cases = {0: "   0:00:00", 3723: "   1:02:03", 100: "   0:01:40", 360000: " 100:00:00", 86399: "  23:59:59"}
    for secs, text in cases.items():
        assert one(spark, pretty_time, secs, "bigint") == text
    assert one(spark, pretty_time, 19.99, "double") == "   0:00:19"


def test_pretty_bytes(spark):
    cases = {0: "0 bytes", 1023: "1023 bytes", 1024: "1 KB", 1048575: "1023 KB", 1048576: "1 MB",
             5 * 2**30 + 7: "5 GB", 2**40: "1 TB", 3 * 2**50: "3 PB", 2**62: "4 EB", -5: "-5 bytes"}
    for size, text in cases.items():
        assert one(spark, pretty_bytes, size, "bigint") == text, size


def test_metric_line_rounds_half_up_on_decimal_form(spark):
    df = spark.createDataFrame([(2.005, False)], "r double, s boolean")
    line = df.select(metric_line(F.lit("Bytes Read"), F.lit("1 KB"), F.lit("2 KB"), F.col("r"), F.col("s"))).first()[0]
    assert line == "\tBytes Read                => Avg: 1 KB             , Max: 2 KB             ,Ratio: 2.01"


def test_report_block_golden(spark):
    tasks = flat_rows(spark, [dict(stageId=12, taskId=i, duration=10_000, stageName="collect at App.scala:9")
                              for i in range(9)] + [dict(stageId=12, taskId=9, duration=100_000,
                                                         stageName="collect at App.scala:9", bytesRead=3 * 2**20)])
    jobs = spark.createDataFrame([("app-1", 12, [3, 4])], "app_id string, stageId int, jobIds array<int>")
    (row,) = analyze_tasks(tasks, jobs, 3.0).collect()
    assert row.block == (
        "[Stage Id: 12, Attempt Id: 0, Job Ids: (3,4), Task Count: 10]\n"
        "[Stage Status: COMPLETE, Stage Name: collect at App.scala:9] \n"
        "\tDuration (HH:mm:ss)       => Avg:    0:00:19       , Max:    0:01:40       ,Ratio: 5.26 <---\n"
        "\tBytes Read                => Avg: 307 KB           , Max: 3 MB             ,Ratio: 10.00 <---\n"
        "\tBytes Written             => Avg: 0 bytes          , Max: 0 bytes          ,Ratio: 0.00\n"
        "\tShuffle Bytes Read        => Avg: 0 bytes          , Max: 0 bytes          ,Ratio: 0.00\n"
        "\tShuffle Bytes Written     => Avg: 0 bytes          , Max: 0 bytes          ,Ratio: 0.00")
    assem = metric_long(spark.createDataFrame([("a", 1, 0, 19.0, 100)],
                                              "app_id string, stageId int, attemptId int, avgDuration double, "
                                              "maxDuration bigint")
                        .select("*", *[F.lit(v).alias(n) for n, v in [
                            ("avgBytesRead", 0.0), ("maxBytesRead", 0), ("avgBytesWritten", 0.0),
                            ("maxBytesWritten", 0), ("avgShuffleBytesRead", 0.0), ("maxShuffleBytesRead", 0),
                            ("avgShuffleBytesWritten", 0.0), ("maxShuffleBytesWritten", 0)]]), 3.0)
    first = assem.filter("metricIndex = 0").first()
    assert abs(first.displayRatio - 100 / 19) < 1e-12
