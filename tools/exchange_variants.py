"""Measure the statistics plan with two exchanges (default) against one exchange.

The one-exchange variant hash-partitions the task rows on the stage keys first, so the
de-dup window and the aggregate reuse that partitioning.  It ships every row (no partial
window limit) and puts a whole stage into one task.  Prints seconds, shuffle bytes and the
largest reducer input of each variant (from an event log in a fresh scratch folder).

usage: python tools/exchange_variants.py [sf_dir | events.parquet] [hot_share]
``hot_share`` > 0 moves that share of the events into one stage (user) to show skew.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import zstandard  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from skewlens.operators.stats import stage_stats  # noqa: E402
from skewlens.operators.tasks import dedup_tasks  # noqa: E402
from skewlens.plans.analyze import stats_from_tasks  # noqa: E402
from skewlens.schemas import METRICS, STAGE_KEYS  # noqa: E402
from skewlens.session import get_session  # noqa: E402
from skewlens.sources.testdata import TABLE_SCHEMAS, events_tasks, read_table  # noqa: E402


def one_exchange(tasks):
    needed = STAGE_KEYS + ["taskId", "attempt", "status"] + METRICS
    return stage_stats(dedup_tasks(tasks.select(*needed).repartition(*STAGE_KEYS)))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    hot = float(sys.argv[2]) if len(sys.argv) > 2 else 0.0
    logdir = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = get_session("local[8]", shuffle_partitions=16 if not sf.endswith(".parquet") else 64, **{
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": logdir, "spark.driver.memory": "16g",
        "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    events = (spark.read.schema(TABLE_SCHEMAS["events"]).parquet(sf) if sf.endswith(".parquet")
              else read_table(spark, sf, "events"))
    if hot > 0:
        events = events.withColumn("user_id", F.when(F.rand(7) < hot, F.lit(0)).otherwise(F.col("user_id")))
    tasks = events_tasks(events)
    marks = {}
    for name, fn in [("two_exchanges", stats_from_tasks), ("one_exchange", one_exchange)] * 2:
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.perf_counter()
        fn(tasks).write.format("noop").mode("overwrite").save()
        marks[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    shuffle, biggest = {}, {}
    f = glob.glob(f"{logdir}/*/events_*")[0]
    group_of_stage = {}
    for line in io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(open(f, "rb")), encoding="utf-8"):
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            g = e.get("Properties", {}).get("spark.jobGroup.id")
            for s in e["Stage Infos"]:
                group_of_stage[s["Stage ID"]] = g
        if e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
            g = group_of_stage.get(e["Stage ID"])
            if g is None:
                continue
            m = e["Task Metrics"]
            shuffle[g] = shuffle.get(g, 0) + m["Shuffle Write Metrics"]["Shuffle Bytes Written"]
            r = m["Shuffle Read Metrics"]
            biggest[g] = max(biggest.get(g, 0), r["Remote Bytes Read"] + r["Local Bytes Read"])
    print(json.dumps({"sf": sf, "hot_share": hot, "seconds": marks,
                      "shuffle_bytes_written_2runs": shuffle, "largest_reducer_input_bytes": biggest}))


if __name__ == "__main__":
    main()
