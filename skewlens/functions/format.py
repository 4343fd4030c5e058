"""Report formatting as column expressions (JVM-side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Binary units of the byte display, largest first (1024-based).
BYTE_UNITS = [("EB", 60), ("PB", 50), ("TB", 40), ("GB", 30), ("MB", 20), ("KB", 10)]

# Text layout of one metric line and of the stage header.
TIME_FORMAT = "%4d:%02d:%02d"
METRIC_LINE_FORMAT = "\t%-25s => Avg: %-17s, Max: %-17s,Ratio: %.2f%s"
SKEW_MARK = " <---"
STAGE_HEADER_FORMAT = ("[Stage Id: %d, Attempt Id: %d, Job Ids: (%s), Task Count: %d]\n"
                       "[Stage Status: %s, Stage Name: %s] \n")


def _idiv(a: Column, b: int) -> Column:
    """Integer division truncating toward zero (like JVM ``/`` on longs)."""
    return F.call_function("div", a, F.lit(b))


def pretty_time(seconds: Column) -> Column:
    """Whole seconds (a fractional value is truncated) -> ``'%4d:%02d:%02d'`` hours:minutes:seconds."""
    s = seconds.cast("long")
    return F.format_string(TIME_FORMAT, _idiv(s, 3600), _idiv(s % 3600, 60), s % 60)


def pretty_bytes(size: Column) -> Column:
    """Bytes -> the largest binary unit with a quotient >= 1, floored (``'3 MB'``), else ``'N bytes'``."""
    s = size.cast("long")
    out = F.concat(s.cast("string"), F.lit(" bytes"))
    for unit, shift in reversed(BYTE_UNITS):
        q = F.shiftright(s, shift)
        out = F.when(s >= F.lit(1 << shift), F.concat(q.cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def display_ratio(mx: Column, avg_whole: Column) -> Column:
    """Printed ratio: max / avg on whole units when avg > 0, else the max itself."""
    return F.when(avg_whole > 0, mx.cast("double") / avg_whole.cast("double")) \
            .otherwise(mx.cast("double"))


def metric_line(name: Column, avg_text: Column, max_text: Column, ratio: Column, skewed: Column) -> Column:
    return F.format_string(METRIC_LINE_FORMAT, name, avg_text, max_text, ratio,
                           F.when(skewed, F.lit(SKEW_MARK)).otherwise(F.lit("")))


def metric_text(agg: Column) -> Column:
    """One metric struct (see ``metric_aggregates``) -> its report line."""
    is_time = agg["unit"] == F.lit("seconds")
    avg_text = F.when(is_time, pretty_time(agg["avg"])).otherwise(pretty_bytes(agg["avg"]))
    max_text = F.when(is_time, pretty_time(agg["max"])).otherwise(pretty_bytes(agg["max"]))
    return metric_line(agg["metric"], avg_text, max_text, agg["displayRatio"], agg["isSkewed"])


def stage_block(stage_id: Column, attempt_id: Column, job_ids: Column, task_count: Column,
                stage_status: Column, stage_name: Column, task_agg: Column) -> Column:
    """Two header lines and one line per metric, as one text block."""
    header = F.format_string(
        STAGE_HEADER_FORMAT, stage_id, attempt_id, F.array_join(job_ids.cast("array<string>"), ","), task_count,
        stage_status, stage_name)
    return F.concat(header, F.array_join(F.transform(task_agg, metric_text), "\n"))
