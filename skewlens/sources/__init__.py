from skewlens.sources.arrays import array_elements
from skewlens.sources.diagnosis import diagnose_jobs, diagnose_stages
from skewlens.sources.payloads import (check_required, missing_fields, read_jobs, read_quarantine, read_stages,
                                       read_stages_stream, read_task_list, read_task_table, required_jobs,
                                       required_stages, required_task_records)
from skewlens.sources.sinks import (convert_stages, stats_json, write_bucketed_tasks, write_measures, write_report,
                                    write_task_table)
