from skewlens.plans.analyze import (analyze, analyze_tasks, stats_from_stages, stats_from_tasks,
                                    with_report_block)

__all__ = ["analyze", "analyze_tasks", "stats_from_stages", "stats_from_tasks", "with_report_block"]
