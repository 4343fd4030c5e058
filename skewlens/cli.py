"""Command-line job: saved payloads -> skew report.

    spark-submit --py-files skewlens.zip skewlens/__main__.py --payloads /data/payloads --out /data/reports/skew
    python -m skewlens --payloads /data/payloads --out /data/reports/skew [--app-id app-1] [--threshold 3]
    python -m skewlens --payloads /data/payloads            # report to stdout

``--payloads`` holds ``jobs/`` and ``stages/``, each with ``app_id=<id>/`` folders.  With
``--convert-to`` the stage payloads are converted once (one JSON pass) into a parquet task
table that later runs read with ``--tasks``.  Without ``--out`` the report is printed one
partition at a time, never collected whole.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewlens.operators.skew import DEFAULT_THRESHOLD
from skewlens.operators.jobs import stage_to_jobs
from skewlens.operators.reduce import may_match
from skewlens.operators.tasks import explode_tasks
from skewlens.plans.analyze import STAGE_ID, analyze_tasks
from skewlens.session import get_session
from skewlens.sources.payloads import read_jobs, read_stages, read_task_table, required_jobs, required_stages
from skewlens.sources.sinks import REPORT_SEPARATOR, convert_stages, write_measures, write_report


def parse_args(argv):
    p = argparse.ArgumentParser(prog="skewlens", description="Find data skew in saved Spark task metrics.")
    p.add_argument("--payloads", required=True, help="folder with jobs/ and stages/ (app_id=<id>/ inside)")
    p.add_argument("--convert-to", help="first convert stages/ into a parquet task table here (one JSON pass, "
                                        "quarantined rows under valid=false), then analyse the table")
    p.add_argument("--tasks", help="analyse this task table (from --convert-to or write_task_table) instead "
                                   "of stages/")
    p.add_argument("-a", "--app-id", action="append", help="analyse only these applications (repeatable)")
    p.add_argument("-t", "--threshold", "--skew-threshold", dest="threshold", type=float, default=DEFAULT_THRESHOLD,
                   help="max/avg ratio that counts as skew (default 3.0)")
    p.add_argument("-o", "--out", "--out-file", dest="out",
                   help="write the text report into this folder (overwrites; part files in rank order); "
                        "default: print it")
    p.add_argument("--measures-out", help="also write the structured result as parquet")
    p.add_argument("--quarantine-out", help="write rejected payload records here as JSON")
    p.add_argument("--multi-line", action="store_true", help="files are JSON arrays (saved REST responses)")
    p.add_argument("--split-arrays", action="store_true", help="as --multi-line, but a large array is read by several tasks")
    p.add_argument("--strict", action="store_true", help="fail on any record with a missing field")
    p.add_argument("--tasks-converted", action="store_true", help="--tasks was written by --convert-to")
    p.add_argument("--master", help="Spark master (default: from spark-submit)")
    return p.parse_args(argv)


def _reject(bad: DataFrame, kind: str, out: str | None) -> None:
    """Write the rejected records, if a folder is given, and report how many there are."""
    if out:
        bad.write.mode("overwrite").json(f"{out}/{kind}")
    if n := bad.count():
        where = f"written to {out}/{kind}" if out else "left out; --quarantine-out keeps them"
        print(f"{n} rejected records in {kind}/: {where}", file=sys.stderr)


def main(argv=None) -> int:
    args = parse_args(sys.argv[1:] if argv is None else argv)
    spark = get_session(args.master)
    multi_line = "split" if args.split_arrays else args.multi_line
    jobs = read_jobs(spark, f"{args.payloads}/jobs", multi_line=multi_line)
    # --tasks takes the place of stages/, which need not exist then
    stages = None if args.tasks and not args.convert_to else read_stages(
        spark, f"{args.payloads}/stages", multi_line=multi_line)
    if args.app_id:  # a filter on the partition column: only those folders are listed and read
        jobs = jobs.filter(F.col("app_id").isin(args.app_id))
        if stages is not None:
            stages = stages.filter(F.col("app_id").isin(args.app_id))
    mode = "fail" if args.strict else "quarantine"
    if mode == "fail":
        jobs = required_jobs(jobs, mode)
        if stages is not None:
            stages = required_stages(stages, mode)
    else:
        jobs, bad_jobs = required_jobs(jobs)
        _reject(bad_jobs, "jobs", args.quarantine_out)
    stage_jobs = stage_to_jobs(jobs)
    if args.convert_to:
        convert_stages(stages, args.convert_to)        # quarantined rows stay in the table (valid=false)
        tasks = read_task_table(spark, args.convert_to, converted=True)
    elif args.tasks:
        tasks = read_task_table(spark, args.tasks, converted=args.tasks_converted)
    else:
        if mode == "quarantine":
            stages, bad_stages = required_stages(stages)
            _reject(bad_stages.drop("tasks"), "stages", args.quarantine_out)
        tasks = explode_tasks(may_match(stages, stage_jobs, STAGE_ID))
    if args.app_id:
        tasks = tasks.filter(F.col("app_id").isin(args.app_id))
    whole = bool(args.convert_to or args.tasks)             # rows of unlisted stages are still among the tasks
    # write_report sorts what it writes; the printed report is sorted here.
    report = analyze_tasks(tasks, stage_jobs, args.threshold, ordered=not args.out, reduce=whole)
    if args.measures_out:
        write_measures(report.drop("block"), args.measures_out)
    if args.out:
        write_report(report, args.out)
    else:
        print("Data Skew: ")
        for row in report.select("block").toLocalIterator():
            sys.stdout.write(row.block + REPORT_SEPARATOR)
    spark.stop()
    return 0
