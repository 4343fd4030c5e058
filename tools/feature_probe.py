"""Figures of single features: python tools/feature_probe.py reduction|top1|array|narrow [sf_dir].

reduction  rows that enter the de-duplication exchange, with and without the reduction to listed stages
top1       seconds of the de-duplication by window and by aggregate
array      a JSON array (of about 1 GB, or the bytes of a third argument) read whole and split, and the same records as lines
narrow     CPU seconds of the trusted statistics, read whole and narrowed

Shuffle rows and CPU seconds come from Spark's event log, written to a scratch folder.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from skewlens.operators.jobs import stage_to_jobs  # noqa: E402
from skewlens.operators.reduce import may_match  # noqa: E402
from skewlens.operators.tasks import dedup_tasks, explode_tasks, latest_attempt, latest_by_aggregate, merge_tasks  # noqa: E402
from skewlens.plans import catalog  # noqa: E402
from skewlens.plans.analyze import STAGE_ID, stats_from_stages, stats_from_tasks  # noqa: E402
from skewlens.schemas import STATS_PATHS  # noqa: E402
from skewlens.session import get_session  # noqa: E402
from skewlens.sources.payloads import read_jobs, read_stages  # noqa: E402
from skewlens.sources.testdata import events_tasks, read_table, write_payload  # noqa: E402

LOG = tempfile.mkdtemp(prefix="run-", dir="/tmp")


def log_of(spark, what):
    """(task CPU seconds, records written to shuffles by stage, tasks) of the jobs that ``what`` runs."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    size = {p: os.path.getsize(p) for p in glob.glob(f"{LOG}/*")}
    t0 = time.perf_counter()
    what()
    taken = time.perf_counter() - t0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    cpu, rows, tasks = 0.0, {}, 0
    for p in glob.glob(f"{LOG}/*"):
        with open(p, errors="replace") as f:
            f.seek(size.get(p, 0))
            for line in f:
                if '"SparkListenerTaskEnd"' in line:
                    e = json.loads(line)
                    m = e.get("Task Metrics") or {}
                    cpu += m.get("Executor CPU Time", 0) / 1e9
                    tasks += 1
                    n = m.get("Shuffle Write Metrics", {}).get("Shuffle Records Written", 0)
                    rows[e["Stage ID"]] = rows.get(e["Stage ID"], 0) + n
    return taken, cpu, {k: n for k, n in sorted(rows.items()) if n}, tasks


def run(df):
    df.write.format("noop").mode("overwrite").save()


def reduction(spark, sf):
    jobs = read_jobs(spark, write_payload(spark, sf, "jobs", variant="large"))
    stages = read_stages(spark, write_payload(spark, sf, "stages"))
    for name, rows in (("all", stages), ("listed", may_match(stages, stage_to_jobs(jobs), STAGE_ID))):
        df = stats_from_tasks(explode_tasks(rows))
        run(df)
        taken, cpu, shuffled, _ = log_of(spark, lambda df=df: run(df))
        print(f"{name}: {taken:.2f} s, {cpu:.2f} CPU s, rows written by shuffle stage {list(shuffled.values())}")


def top1(spark, sf):
    tasks = events_tasks(read_table(spark, sf, "events").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn(
        "user_id", F.col("user_id") + F.col("copy") * 100_000).drop("copy"))
    items = read_table(spark, sf, "lineitem")
    order = [("l_shipdate", True)] + [(c, False) for c in catalog.LINEITEM_ORDER]
    cols = [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
    key, prefer = ["l_orderkey", "l_linenumber"], F.col("l_linestatus") == "F"
    for name, df in (("tasks, window", dedup_tasks(tasks)), ("tasks, aggregate", merge_tasks(tasks)),
                     ("lineitem, window", latest_attempt(items, key, cols, prefer)),
                     ("lineitem, aggregate", latest_by_aggregate(items, key, order, prefer))):
        run(df)
        taken, cpu, shuffled, _ = log_of(spark, lambda df=df: run(df))
        print(f"{name}: {taken:.2f} s, {cpu:.2f} CPU s, shuffled rows {list(shuffled.values())}")


def array(spark, sf):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    os.makedirs(f"{folder}/app_id=a")
    lines = glob.glob(write_payload(spark, sf, "stages").removeprefix("file:") + "/app_id=*/*.json")
    docs = [line.rstrip("\n") for p in sorted(lines) for line in open(p)]
    path, size, n, most = f"{folder}/app_id=a/stages.json", 0, 0, int((sys.argv[3:] or [1_000_000_000])[0])
    os.makedirs(f"{folder}-lines/app_id=a")
    with open(path, "w") as out, open(f"{folder}-lines/app_id=a/stages.json", "w") as flat:
        out.write("[")
        while size < most:
            doc = docs[n % len(docs)]
            if n >= len(docs):                              # other stages, copies of the same tasks
                doc = doc.replace('"stageId":', f'"stageId":{n // len(docs)}', 1)
            out.write(("," if n else "") + doc)
            flat.write(doc + "\n")
            size += len(doc)
            n += 1
        out.write("]\n")
    print(f"{os.path.getsize(path) / 1e9:.2f} GB, {n} elements")
    digest = lambda df: df.select(F.sum(F.xxhash64("stageId", "attemptId", "name", F.to_json("tasks")) % 1_000_003), F.count("*")).first()
    seen = {}
    for mode in (True, "split", False):
        def go(mode=mode):
            seen[mode] = digest(read_stages(spark, folder if mode else f"{folder}-lines", multi_line=mode))
        taken, cpu, _, tasks = log_of(spark, go)
        print(f"multi_line={mode}: {taken:.1f} s, {cpu:.0f} CPU s of the JVM, {tasks} tasks")
    print("split equals lines:", seen["split"] == seen[False], "whole equals lines:", seen[True] == seen[False], seen)


def narrow(spark, sf):
    path = write_payload(spark, sf, "stages")
    for name, paths in (("whole", None), ("narrowed", STATS_PATHS)) * 2:
        df = stats_from_stages(read_stages(spark, path, paths=paths), mode="trusted")
        run(df)
        taken, cpu, _, _ = log_of(spark, lambda df=df: run(df))
        print(f"{name}: {taken:.2f} s, {cpu:.2f} CPU s")


def main():
    what, sf = sys.argv[1], (sys.argv[2:] or ["/root/testdata/sf0.1"])[0]
    spark = get_session("local[8]", shuffle_partitions=16, **{
        "spark.driver.memory": "8g", "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{LOG}",
        "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
    {"reduction": reduction, "top1": top1, "array": array, "narrow": narrow}[what](spark, sf)
    spark.stop()


if __name__ == "__main__":
    main()
