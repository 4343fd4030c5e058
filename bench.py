"""Time the headline queries; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_SHUFFLE_PARTITIONS
(default: one per core; AQE coalesces further).
Each query runs to completion through the ``noop`` sink (no collect).  Payload files for
the source-path queries are derived once before the passes (timed as ``payload_build``).  One untimed
pass warms the JVM (class loading, JIT); then come PASSES timed passes, each starting at another query, and
a query's figure is its median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skewlens.plans import catalog  # noqa: E402
from skewlens.session import clear_scratch, get_session  # noqa: E402
from skewlens.sources.testdata import write_payloads  # noqa: E402

HEADLINE = [
    "dedup_tasks", "stage_stats", "skewed_stages", "significance_gate", "metric_long", "stage_to_jobs",
    "attach_job_ids", "skew_report", "report_block", "src_tasks_flat", "explode_tasks", "src_required_fields",
    "doc_length_skew", "report_from_payloads", "task_table", "convert_stages", "report_sink", "measures_sink",
    "latest_lineitem",
]
PASSES = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)),
                        **{"spark.driver.memory": "8g"})
    spark.range(1000).selectExpr("sum(id)").collect()          # JVM warm-up
    t0 = time.perf_counter()
    write_payloads(spark, sf_dir, "task")
    built = round(time.perf_counter() - t0, 3)
    write_payloads(spark, sf_dir, "task", damaged=True)
    def run(name: str) -> None:
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    failed = []
    for name in HEADLINE:                                      # warm-up pass, untimed
        try:
            run(name)
        except Exception as exc:  # reported below; the other queries still run
            print(f"{name}: {type(exc).__name__}: {exc}", file=sys.stderr)
            failed.append(name)
    good = [name for name in HEADLINE if name not in failed]
    taken: dict[str, list[float]] = {name: [] for name in good}
    for p in range(PASSES):
        first = p * len(good) // PASSES
        for name in good[first:] + good[:first]:
            t0 = time.perf_counter()
            run(name)
            taken[name].append(time.perf_counter() - t0)
    times = {name: round(statistics.median(t), 3) for name, t in taken.items()} | {"payload_build": built}
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    result = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
              "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}
    if failed:
        result["failed"] = failed
    print(json.dumps(result))
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
