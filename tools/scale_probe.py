"""Scale-up measurement: the analysis on N stacked copies of ``events`` (optionally skewed).

Copies get disjoint user / event ids, so stage and task counts grow with N.  With
``--hot`` a share of all rows is moved into one stage (user 0) to test the skew handling;
``--hot-task`` also puts them on one task id and one day, so a single de-dup key holds them.
Writes the enlarged table once into a fresh scratch folder, then times:
  stats   : explode-free flat rows -> de-dup -> statistics (noop sink)
  report  : the full analysis (statistics checkpointed, gate, skew filter, jobs, ranking)

usage: python tools/scale_probe.py [--copies 100] [--hot 0.33] [--sf /root/testdata/sf0.1]
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from skewlens.operators.jobs import jobs_by_stage  # noqa: E402
from skewlens.plans.analyze import analyze_tasks, stats_from_tasks  # noqa: E402
from skewlens.session import get_session  # noqa: E402
from skewlens.sources.testdata import TABLE_SCHEMAS, events_stage_job_pairs, events_tasks  # noqa: E402


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--copies", type=int, default=100)
    ap.add_argument("--hot", type=float, default=0.0)
    ap.add_argument("--hot-task", action="store_true",
                    help="also give the hot rows one task id and one day: a single de-dup key")
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--partitions", type=int, default=64)
    a = ap.parse_args()
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = get_session("local[8]", shuffle_partitions=a.partitions,
                        **{"spark.driver.memory": "16g", "spark.checkpoint.dir": f"{scratch}/ckpt"})
    base = spark.read.schema(TABLE_SCHEMAS["events"]).parquet(f"{a.sf}/events.parquet")
    big = (base.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a.copies - 1).cast("long"))).alias("copy"))
               .select((F.col("event_id") + F.col("copy") * 1_000_000).alias("event_id"), "ts",
                       (F.col("user_id") + F.col("copy") * 1_000_000).alias("user_id"),
                       "event_type", "value", "props"))
    if a.hot > 0:  # deterministic: a hash of the event id picks the rows moved into stage 0
        pick = F.pmod(F.xxhash64("event_id"), F.lit(10_000)) < int(a.hot * 10_000)
        big = big.withColumn("user_id", F.when(pick, F.lit(0)).otherwise(F.col("user_id")))
        if a.hot_task:
            big = (big.withColumn("props", F.when(pick, F.lit('{"k": 7}')).otherwise(F.col("props")))
                      .withColumn("ts", F.when(pick, F.lit("2024-01-03 10:00:00").cast("timestamp_ntz"))
                                  .otherwise(F.col("ts"))))
    path = f"{scratch}/events.parquet"
    t0 = time.perf_counter()
    big.repartition(a.partitions).write.parquet(path)
    write_s = time.perf_counter() - t0
    events = spark.read.schema(TABLE_SCHEMAS["events"]).parquet(path)
    rows = events.count()
    out = {"copies": a.copies, "hot_share": a.hot, "hot_task": a.hot_task, "rows": rows,
           "write_s": round(write_s, 2)}
    for rnd in range(2):
        t0 = time.perf_counter()
        stats_from_tasks(events_tasks(events)).write.format("noop").mode("overwrite").save()
        out[f"stats_s_{rnd}"] = round(time.perf_counter() - t0, 2)
        t0 = time.perf_counter()
        rep = analyze_tasks(events_tasks(events), jobs_by_stage(events_stage_job_pairs(events)), 8.0)
        rep.write.format("noop").mode("overwrite").save()
        out[f"report_s_{rnd}"] = round(time.perf_counter() - t0, 2)
    out["rows_per_s_stats"] = int(rows / out["stats_s_1"])
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
