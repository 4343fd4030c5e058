"""Find data skew in Spark task metrics at scale, as plain DataFrame transformations."""

from skewlens.plans.analyze import analyze, analyze_tasks, stats_from_stages, stats_from_tasks, with_report_block
from skewlens.session import get_session

__all__ = ["analyze", "analyze_tasks", "stats_from_stages", "stats_from_tasks", "with_report_block", "get_session"]
