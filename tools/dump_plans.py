"""Write PLANS.md: the physical operator tree, scan schema and pushed filters of each
headline query (from ``explain("formatted")``, before adaptive re-planning).

usage: python tools/dump_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from skewlens.plans import catalog  # noqa: E402
from skewlens.session import get_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", shuffle_partitions=8)
    print("# Physical plans of the headline queries\n")
    print(f"Generated by `python tools/dump_plans.py` at `{os.path.basename(sf)}` with `explain(\"formatted\")`. "
          "Plans are shown before adaptive re-planning, so joins that AQE turns into broadcast joins at run time\n"
          "still appear with their static choice. `skew_report` and `report_block` start from the written\n"
          "per-stage statistics (a parquet scan).\n")
    for name in HEADLINE + ["latest_lineitem", "task_table"]:
        df = catalog.QUERIES[name](spark, sf)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        tree = [ln for ln in text.split("\n\n")[0].splitlines() if ln.strip()]
        details = [ln for ln in text.splitlines() if ln.startswith(("ReadSchema", "PushedFilters", "PartitionFilters"))]
        for block in text.split("\n\n"):
            head = block.strip().splitlines()[0] if block.strip() else ""
            if re.match(r"\(\d+\) (Exchange|WindowGroupLimit|BroadcastExchange)", head):
                args = [ln for ln in block.splitlines() if ln.startswith("Arguments:")]
                if args:
                    arg = re.sub(r"#\d+L?|, \[plan_id=\d+\]", "", args[0][len("Arguments: "):])
                    if head.endswith("WindowGroupLimit"):
                        arg = arg.split("], [")[0] + "] ... " + arg.rsplit(",", 1)[-1].strip()
                    details.append(f"{head}: {arg[:160]}")
        print(f"## `{name}`\n\n```")
        print("\n".join(tree))
        if details:
            print()
            print("\n".join(sorted(set(details), key=details.index)))
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
