from skewlens.operators.jobs import (attach_job_ids, jobs_by_stage, stage_job_pairs, stage_to_jobs,
                                     stages_with_jobs)
from skewlens.operators.rank import global_rank
from skewlens.operators.reduce import may_match
from skewlens.operators.skew import (DEFAULT_THRESHOLD, app_max_duration, flag_skew, metric_aggregates,
                                     metric_flag, metric_flags, metric_long, rank_order, skew_predicate,
                                     skew_ratio, skewed_stages, stage_skew, with_significance)
from skewlens.operators.stats import (STATS_COLUMNS, finalize_stats, group_skew_stats, merge_partials,
                                      stage_partials, stage_stats)
from skewlens.operators.tasks import (dedup_tasks, derive_shuffle_read, explode_task_fields, explode_tasks,
                                      flat_task_columns, flatten_task_records, latest_attempt, latest_by_aggregate, merge_tasks,
                                      project_stage, status_rank, task_fields)
