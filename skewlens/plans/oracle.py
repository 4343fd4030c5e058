"""DuckDB oracle SQL for the registered queries (views: the driver's test tables).

Each statement recomputes a query's result independently from the raw tables: the events
mapping, the statistics and the text formats are restated in SQL.  Column names and types
match the Spark side.
"""

from __future__ import annotations

# Columns of the statistics, restated.
STATS_COLUMNS = ["app_id", "stageId", "attemptId", "stageName", "stageStatus", "numTasks"] + [
    f"{side}{metric}" for metric in ("Duration", "BytesRead", "BytesWritten", "ShuffleBytesRead", "ShuffleBytesWritten")
    for side in ("avg", "max")]

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
APP = "'app-' || CAST(user_id % 3 AS VARCHAR)"
TS_TEXT = "'%Y-%m-%dT%H:%M:%S.%gGMT'"


def payload_sql(view: str = "task", damaged: bool = False) -> str:
    """events -> one row per task attempt with every payload field (mirrors events_payload_rows)."""
    if view == "task":
        attempt_id, duration, written = "CAST(day(ts) > 15 AS INTEGER)", "round(value * 1000)", "k * 1024"
    else:
        attempt_id, duration, written = "CAST((day(ts) - 1) // 3 AS INTEGER)", "round(value * 100)", "k % 10"
    executor = "'exec-' || CAST(k % 8 AS VARCHAR)"
    if damaged:
        executor = f"CASE WHEN value >= 300 THEN NULL ELSE {executor} END"
    return f"""
SELECT {APP} AS app_id,
       CAST(user_id AS BIGINT) AS stageId,
       {attempt_id} AS attemptId,
       'stage ' || CAST(user_id AS VARCHAR) AS stageName,
       'COMPLETE' AS stageStatus,
       CAST(100 AS INTEGER) AS numTasks,
       k AS taskId,
       CAST(event_id AS BIGINT) AS attempt,
       strftime(ts, {TS_TEXT}) AS launchTime,
       CAST({duration} AS BIGINT) AS duration,
       {executor} AS executorId,
       'host-' || CAST(k % 4 AS VARCHAR) AS host,
       CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
       CAST(round(value * 900) AS BIGINT) AS executorRunTime,
       k * 8 AS resultSize,
       CAST(round(value * 50) AS BIGINT) AS jvmGcTime,
       k * 4096 AS peakExecutionMemory,
       CAST(round(value * value * 100) AS BIGINT) AS bytesRead,
       k * 3 + 1 AS recordsRead,
       {written} AS bytesWritten,
       k * 5 + 2 AS recordsWritten,
       CASE WHEN event_type = 'purchase' THEN CAST(round(value * 1000) AS BIGINT) ELSE CAST(0 AS BIGINT) END
         AS shuffleRemoteBytesRead,
       CASE WHEN event_type = 'view' THEN k * 100 ELSE CAST(0 AS BIGINT) END AS shuffleLocalBytesRead,
       k * 7 + 3 AS shuffleRecordsRead,
       CASE WHEN event_type = 'view' THEN CAST(1 AS BIGINT) ELSE k * 10 + 2 END AS shuffleBytesWritten,
       k * 11 + 4 AS shuffleWriteTime,
       k * 13 + 5 AS shuffleRecordsWritten
FROM (SELECT *, {K} AS k FROM events)
"""


# The flat task columns computed from payload rows.
FLAT_FROM_PAYLOAD = """app_id, stageId, attemptId, stageName, stageStatus, numTasks, taskId, attempt, status,
       duration, resultSize, jvmGcTime, bytesRead, bytesWritten,
       shuffleRemoteBytesRead + shuffleLocalBytesRead AS shuffleBytesRead, shuffleBytesWritten"""


def flat_sql(view: str = "task") -> str:
    return f"SELECT {FLAT_FROM_PAYLOAD} FROM ({payload_sql(view)})"


TASK_SQL = flat_sql("task")
GATE_SQL = flat_sql("gate")

KEYS = "app_id, stageId, attemptId, stageName, stageStatus, numTasks"
FLAT = KEYS + (", taskId, attempt, status, duration, resultSize, jvmGcTime, bytesRead, bytesWritten,"
               " shuffleBytesRead, shuffleBytesWritten")

DEDUP_SQL = f"""
SELECT {FLAT} FROM (
  SELECT *, row_number() OVER (
      PARTITION BY {KEYS}, taskId
      ORDER BY CASE WHEN status = 'SUCCESS' THEN 1 ELSE 2 END, attempt DESC) AS rn
  FROM ({TASK_SQL})) WHERE rn = 1
"""


def stats_sql(src: str) -> str:
    def pair(col, name):
        return (f"sum({col}) / count({col}) AS avg{name}, max({col}) AS max{name}")
    return f"""
SELECT {KEYS},
       sum(duration) / count(duration) / 1000 AS avgDuration,
       max(duration) // 1000 AS maxDuration,
       {pair('bytesRead', 'BytesRead')}, {pair('bytesWritten', 'BytesWritten')},
       {pair('shuffleBytesRead', 'ShuffleBytesRead')}, {pair('shuffleBytesWritten', 'ShuffleBytesWritten')}
FROM ({src}) GROUP BY {KEYS}
"""


STATS_SQL = stats_sql(DEDUP_SQL)
GATE_STATS_SQL = stats_sql(GATE_SQL)
STATS_COLS = ", ".join(STATS_COLUMNS)


def gated_sql(stats: str) -> str:
    return f"""
SELECT *, (maxDuration >= 60 OR maxDuration >= CAST(0.2 AS DOUBLE) * maxDurationAllStages) AS isSignificant
FROM (SELECT *, max(maxDuration) OVER (PARTITION BY app_id) AS maxDurationAllStages FROM ({stats}))
"""


def skew_clause_sql(t: float) -> str:
    t = f"CAST({float(t)!r} AS DOUBLE)"
    return " OR ".join(f"max{m} > {t} * avg{m}" for m in
                       ["Duration", "BytesRead", "BytesWritten", "ShuffleBytesRead", "ShuffleBytesWritten"])


def skewed_sql(stats: str, t: float) -> str:
    return f"SELECT {STATS_COLS} FROM ({gated_sql(stats)}) WHERE isSignificant AND ({skew_clause_sql(t)})"



def jobs_sql(where: str = "") -> str:
    return f"""
SELECT {APP} AS app_id, CAST(day(ts) AS INTEGER) AS jobId, 'job ' || CAST(day(ts) AS VARCHAR) AS name,
       strftime(min(ts), {TS_TEXT}) AS submissionTime, strftime(max(ts), {TS_TEXT}) AS completionTime,
       list_sort(list(DISTINCT CAST(user_id AS BIGINT))) AS stageIds
FROM events WHERE event_type = 'signup' {where} GROUP BY 1, 2, 3
"""


def stage_jobs_sql(jobs: str) -> str:
    return f"""
SELECT app_id, stageId, array_to_string(list_sort(list(jobId)), ',') AS job_ids,
       CAST(count(*) AS INTEGER) AS n_jobs
FROM (SELECT app_id, jobId, unnest(stageIds) AS stageId FROM ({jobs})) GROUP BY app_id, stageId
"""


JOBS_SQL = jobs_sql()
STAGE_JOBS_SQL = stage_jobs_sql(JOBS_SQL)
LARGE_STAGE_JOBS_SQL = stage_jobs_sql(jobs_sql("AND value >= 300"))

T = "CAST({} AS DOUBLE)"


def time_text_sql(x: str) -> str:
    s = f"CAST(trunc({x}) AS BIGINT)"
    return f"printf('%4d:%02d:%02d', {s} // 3600, ({s} % 3600) // 60, {s} % 60)"


def bytes_text_sql(x: str) -> str:
    s = f"CAST(trunc({x}) AS BIGINT)"
    units = [("EB", 60), ("PB", 50), ("TB", 40), ("GB", 30), ("MB", 20), ("KB", 10)]
    whens = " ".join(f"WHEN {s} >= {1 << sh} THEN CAST({s} >> {sh} AS VARCHAR) || ' {u}'" for u, sh in units)
    return f"CASE {whens} ELSE CAST({s} AS VARCHAR) || ' bytes' END"


def ratio_text_sql(x: str) -> str:
    # Half-up rounding of the value's shortest decimal form, as JVM %.2f does.
    return f"printf('%.2f', CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE))"


def display_ratio_sql(mx: str, avg_whole: str) -> str:
    return (f"CASE WHEN {avg_whole} > 0 THEN CAST({mx} AS DOUBLE) / CAST({avg_whole} AS DOUBLE) "
            f"ELSE CAST({mx} AS DOUBLE) END")


METRIC_ROWS = [("Duration (HH:mm:ss)", "Duration", "seconds"), ("Bytes Read", "BytesRead", "bytes"),
               ("Bytes Written", "BytesWritten", "bytes"), ("Shuffle Bytes Read", "ShuffleBytesRead", "bytes"),
               ("Shuffle Bytes Written", "ShuffleBytesWritten", "bytes")]


def metric_long_sql(stats: str, t: float, extra: str = "") -> str:
    parts = []
    for i, (label, m, unit) in enumerate(METRIC_ROWS):
        whole = f"CAST(trunc(avg{m}) AS BIGINT)"
        flag_base = f"avg{m}" if unit == "seconds" else whole
        parts.append(f"""
SELECT app_id, stageId, attemptId, {extra} CAST({i} AS INTEGER) AS metricIndex, '{label}' AS metric,
       '{unit}' AS unit, {whole} AS "avg", CAST(max{m} AS BIGINT) AS "max",
       max{m} > CAST({float(t)!r} AS DOUBLE) * {flag_base} AS isSkewed,
       {display_ratio_sql(f"max{m}", whole)} AS displayRatio
FROM ({stats})""")
    return " UNION ALL ".join(parts)


def metric_line_sql(long: str, extra: str = "") -> str:
    avg_text = f"""CASE WHEN unit = 'seconds' THEN {time_text_sql('"avg"')} ELSE {bytes_text_sql('"avg"')} END"""
    max_text = f"""CASE WHEN unit = 'seconds' THEN {time_text_sql('"max"')} ELSE {bytes_text_sql('"max"')} END"""
    return f"""
SELECT app_id, stageId, attemptId, {extra} metricIndex,
       printf(chr(9) || '%-25s => Avg: %-17s, Max: %-17s,Ratio: %s%s', metric, {avg_text}, {max_text},
              {ratio_text_sql('displayRatio')}, CASE WHEN isSkewed THEN ' <---' ELSE '' END) AS line
FROM ({long})
"""


# The composed report: statistics of stages some job lists, gated per app, skew at t=8.
JOB_STATS_SQL = f"""
SELECT s.*, j.job_ids FROM ({STATS_SQL}) s JOIN ({STAGE_JOBS_SQL}) j USING (app_id, stageId)
"""
def report_sql(stats: str, t: float) -> str:
    return f"""
SELECT *, CASE WHEN avgDuration <> 0 THEN maxDuration / avgDuration ELSE CAST('NaN' AS DOUBLE) END AS skewRatio
FROM ({gated_sql(stats)}) WHERE isSignificant AND ({skew_clause_sql(t)})
"""


REPORT_SQL = report_sql(JOB_STATS_SQL, 8.0)
REPORT_BLOCK_SQL = f"""
SELECT app_id, stageId, attemptId,
       printf('[Stage Id: %d, Attempt Id: %d, Job Ids: (%s), Task Count: %d]', stageId, attemptId, job_ids, numTasks)
       || chr(10) || printf('[Stage Status: %s, Stage Name: %s] ', stageStatus, stageName) || chr(10)
       || string_agg(line, chr(10) ORDER BY metricIndex) AS block
FROM ({metric_line_sql(metric_long_sql(REPORT_SQL, 8.0, "numTasks, stageStatus, stageName, job_ids,"),
                       "numTasks, stageStatus, stageName, job_ids,")})
GROUP BY app_id, stageId, attemptId, numTasks, stageStatus, stageName, job_ids
"""

DAMAGED_PAYLOAD_SQL = payload_sql("task", damaged=True)
PAYLOAD_SQL = payload_sql("task")

TASK_FIELDS = ("taskId, attempt, launchTime, duration, executorId, host, status, executorRunTime, resultSize, "
               "jvmGcTime, peakExecutionMemory, bytesRead, recordsRead, bytesWritten, recordsWritten, "
               "shuffleRemoteBytesRead, shuffleLocalBytesRead, shuffleRecordsRead, shuffleBytesWritten, "
               "shuffleWriteTime, shuffleRecordsWritten")


def _flag_cols(t: float) -> str:
    out = []
    for (label, m, unit), name in zip(METRIC_ROWS, ["durationSkewed", "bytesReadSkewed", "bytesWrittenSkewed",
                                                    "shuffleBytesReadSkewed", "shuffleBytesWrittenSkewed"]):
        base = f"avg{m}" if unit == "seconds" else f"CAST(trunc(avg{m}) AS BIGINT)"
        out.append(f"max{m} > CAST({float(t)!r} AS DOUBLE) * {base} AS {name}")
    return ", ".join(out)


ORACLE_SQL: dict[str, str] = {
    "dedup_tasks": DEDUP_SQL,
    "status_rank": f"""
SELECT app_id, stageId, attemptId, taskId, attempt, s AS status, CASE WHEN s = 'SUCCESS' THEN 1 ELSE 2 END AS statusOrder
FROM (SELECT *, CASE WHEN taskId % 7 <> 0 THEN status END AS s FROM ({TASK_SQL}))""",
    "stage_stats": STATS_SQL,
    "skewed_stages": skewed_sql(STATS_SQL, 10.0),
    "skewed_stages_t8": skewed_sql(STATS_SQL, 8.0),
    "significance_gate": f"""
SELECT app_id, stageId, attemptId, maxDuration, maxDurationAllStages, isSignificant
FROM ({gated_sql(GATE_STATS_SQL)})""",
    "metric_flags": f"SELECT {STATS_COLS}, {_flag_cols(2.0)} FROM ({GATE_STATS_SQL})",
    "skew_ratio": f"""
SELECT app_id, stageId, attemptId,
       CASE WHEN avgDuration <> 0 THEN maxDuration / avgDuration ELSE CAST('NaN' AS DOUBLE) END AS skewRatio
FROM ({STATS_SQL})""",
    "metric_long": metric_long_sql(GATE_STATS_SQL, 2.0),
    "display_ratio": "SELECT app_id, stageId, attemptId, " + ", ".join(
        f"{display_ratio_sql(f'max{m}', f'CAST(trunc(avg{m}) AS BIGINT)')} AS {m[0].lower() + m[1:]}Ratio"
        for _, m, _ in METRIC_ROWS) + f" FROM ({STATS_SQL})",
    "stage_to_jobs": STAGE_JOBS_SQL,
    "stages_with_jobs": f"""
SELECT t.* FROM ({TASK_SQL}) t WHERE EXISTS (
  SELECT 1 FROM ({STAGE_JOBS_SQL}) j WHERE j.app_id = t.app_id AND j.stageId = t.stageId)""",
    "attach_job_ids": f"""
SELECT {", ".join("s." + c for c in STATS_COLUMNS)}, COALESCE(j.job_ids, '') AS job_ids
FROM ({STATS_SQL}) s LEFT JOIN ({STAGE_JOBS_SQL}) j ON s.app_id = j.app_id AND s.stageId = j.stageId""",
    "skew_report": f"""
SELECT app_id, stageId, stageName, attemptId, stageStatus, job_ids, CAST(0 AS BIGINT) AS stageDuration,
       numTasks AS taskCount, skewRatio FROM ({REPORT_SQL})""",
    "report_block": REPORT_BLOCK_SQL,
    "metric_line": metric_line_sql(metric_long_sql(GATE_STATS_SQL, 2.0)),
    "fmt_time": f"""
SELECT app_id, stageId, attemptId, {time_text_sql('avgDuration')} AS avgTime,
       {time_text_sql('maxDuration')} AS maxTime FROM ({STATS_SQL})""",
    "fmt_bytes": "SELECT app_id, stageId, attemptId, " + ", ".join(
        f"{bytes_text_sql(f'avg{m}')} AS avg{m}Text, {bytes_text_sql(f'max{m}')} AS max{m}Text"
        for _, m, _ in METRIC_ROWS[1:]) + f" FROM ({STATS_SQL})",
    "src_jobs": f"""
SELECT app_id, jobId, name, submissionTime, completionTime, CAST(len(stageIds) AS BIGINT) AS n_stages,
       list_min(stageIds) AS first_stage, list_max(stageIds) AS last_stage FROM ({JOBS_SQL})""",
    "src_stages": f"""
SELECT app_id, stageId, attemptId, stageName AS name, stageStatus AS status, numTasks,
       CAST(sum(CAST(status = 'SUCCESS' AS INTEGER)) AS INTEGER) AS numCompleteTasks,
       CAST(sum(CAST(status = 'FAILED' AS INTEGER)) AS INTEGER) AS numFailedTasks,
       min(launchTime) AS firstTaskLaunchedTime, max(launchTime) AS completionTime,
       count(*) AS n_tasks
FROM ({PAYLOAD_SQL}) GROUP BY app_id, stageId, attemptId, stageName, stageStatus, numTasks""",
    "src_tasks_flat": f"SELECT app_id, stageId, attemptId, {TASK_FIELDS} FROM ({PAYLOAD_SQL})",
    "src_task_list": f"""
SELECT app_id, stageId, attemptId, taskId, attempt, status, duration, resultSize, jvmGcTime, bytesRead,
       bytesWritten, shuffleBytesRead, shuffleBytesWritten FROM ({TASK_SQL})""",
    "src_required_fields": f"""
WITH broken AS (
  SELECT app_id, 'stage' AS kind, stageId AS id, attemptId, concat_ws(',',
         CASE WHEN stageId % 7 = 0 THEN 'missing numTasks' END,
         CASE WHEN bool_or(executorId IS NULL) THEN 'missing tasks.executorId' END,
         CASE WHEN stageId % 11 = 0 THEN 'wrong type status' END,
         CASE WHEN stageId % 5 = 0 THEN 'wrong type tasks.duration' END) AS reasons
  FROM ({DAMAGED_PAYLOAD_SQL}) WHERE stageId % 13 <> 0 GROUP BY app_id, stageId, attemptId
  UNION ALL
  SELECT DISTINCT app_id, 'stage', CAST(NULL AS BIGINT), CAST(NULL AS INTEGER), 'malformed record'
  FROM ({DAMAGED_PAYLOAD_SQL}) WHERE stageId % 13 = 0
  UNION ALL
  SELECT app_id, 'job', CAST(jobId AS BIGINT), CAST(NULL AS INTEGER), concat_ws(',',
         CASE WHEN jobId % 5 = 0 THEN 'missing completionTime' END, CASE WHEN jobId % 7 = 0 THEN 'wrong type jobId' END,
         CASE WHEN jobId % 11 = 0 THEN 'wrong type stageIds' END)
  FROM ({JOBS_SQL}))
SELECT app_id, kind, id, attemptId, reasons = '' AS accepted, reasons FROM broken""",
    "project_stage": f"""
SELECT app_id, stageId, attemptId, stageName, stageStatus, numTasks, count(*) AS n_tasks
FROM ({PAYLOAD_SQL}) GROUP BY app_id, stageId, attemptId, stageName, stageStatus, numTasks
UNION ALL
SELECT DISTINCT {APP}, CAST(user_id AS BIGINT), CAST(2 AS INTEGER), 'stage ' || CAST(user_id AS VARCHAR), 'PENDING',
       CAST(100 AS INTEGER), CAST(0 AS BIGINT) FROM events WHERE event_type = 'signup'""",
    "explode_tasks": TASK_SQL,
    "task_table": TASK_SQL,
    "convert_stages": f"""
SELECT {FLAT_FROM_PAYLOAD}, NOT bad AS valid, CASE WHEN bad THEN 'tasks.executorId' ELSE '' END AS missing
FROM (SELECT *, bool_or(executorId IS NULL) OVER (PARTITION BY app_id, stageId, attemptId) AS bad
      FROM ({DAMAGED_PAYLOAD_SQL}))""",
    "derive_shuffle_read": f"""
SELECT app_id, stageId, attemptId, taskId, attempt, shuffleRemoteBytesRead, shuffleLocalBytesRead,
       shuffleRemoteBytesRead + shuffleLocalBytesRead AS shuffleBytesRead FROM ({PAYLOAD_SQL})""",
    "report_sink": f"SELECT block FROM ({REPORT_BLOCK_SQL})",
    "measures_sink": f"""
SELECT app_id, stageId, attemptId, numTasks AS taskCount, skewRatio, job_ids, CAST(5 AS INTEGER) AS n_metrics
FROM ({REPORT_SQL})""",
    "doc_length_skew": """
SELECT lang, source, sum(n_chars) / count(n_chars) AS avg_n_chars, max(n_chars) AS max_n_chars,
       max(n_chars) > CAST(3.0 AS DOUBLE) * (sum(n_chars) / count(n_chars)) AS is_skewed
FROM documents GROUP BY lang, source""",
}
# Prices lie between 1 and 2^32, so each is a whole number of steps of 2^-53; the text gives the sum's nearest double.
ORACLE_SQL["order_price_skew"] = """
SELECT *, max_o_totalprice > CAST(3.0 AS DOUBLE) * avg_o_totalprice AS is_skewed FROM (
  SELECT o_custkey, CAST(CAST(sum(CAST(floor(o_totalprice) AS HUGEINT) * 9007199254740992
                                  + CAST((o_totalprice - floor(o_totalprice)) * 9007199254740992 AS HUGEINT)) AS VARCHAR) AS DOUBLE)
                    / 9007199254740992 / count(o_totalprice) AS avg_o_totalprice,
         max(o_totalprice) AS max_o_totalprice
  FROM orders GROUP BY o_custkey)"""
ORACLE_SQL["latest_lineitem"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (
      PARTITION BY l_orderkey, l_linenumber
      ORDER BY CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END, l_shipdate DESC, l_partkey, l_suppkey,
               l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag) AS rn
  FROM lineitem) WHERE rn = 1"""


def java_double_sql(x: str) -> str:
    """Text of a double as JVM ``Double.toString`` writes it (what Spark's JSON writer emits):
    plain shortest decimal for magnitudes in [1e-3, 1e7), ``d.dddE<n>`` outside."""
    return f"CASE WHEN {x} < 0 THEN '-' || ({_java_nonneg_sql(f'(-{x})')}) ELSE {_java_nonneg_sql(x)} END"


def _java_nonneg_sql(x: str) -> str:
    s = f"CAST({x} AS VARCHAR)"
    digits = f"trim(replace({s}, '.', ''), '0')"
    mantissa = f"substr({digits}, 1, 1) || '.' || coalesce(nullif(substr({digits}, 2), ''), '0')"
    big = f"{mantissa} || 'E' || CAST(strpos({s}, '.') - 2 AS VARCHAR)"
    small = (f"{mantissa} || 'E-' || CAST(length(split_part({s}, '.', 2)) - length(ltrim(split_part({s}, '.', 2), '0'))"
             f" + 1 AS VARCHAR)")
    # DuckDB itself writes very small or very large values as '1.5e-05': same digits, other layout.
    m = f"split_part({s}, 'e', 1)"
    exp_form = (f"CASE WHEN strpos({m}, '.') > 0 THEN {m} ELSE {m} || '.0' END || 'E' || "
                f"CAST(CAST(split_part({s}, 'e', 2) AS INTEGER) AS VARCHAR)")
    return (f"CASE WHEN {x} = 0 THEN '0.0' WHEN strpos({s}, 'e') > 0 THEN {exp_form} "
            f"WHEN {x} >= 1e7 THEN {big} WHEN {x} < 1e-3 THEN {small} ELSE {s} END")


def stats_json_sql(stats: str) -> str:
    parts = []
    for c in STATS_COLUMNS[1:]:
        if c in ("stageName", "stageStatus"):
            v = f"to_json({c})"
        elif c.startswith("avg"):
            v = java_double_sql(c)
        else:
            v = f"CAST({c} AS VARCHAR)"
        parts.append(f"'\"{c}\":' || {v}")
    body = " || ',' || ".join(parts)
    return f"SELECT app_id, stageId, attemptId, '{{' || {body} || '}}' AS json FROM ({stats})"


ORACLE_SQL["stats_json"] = stats_json_sql(STATS_SQL)

# The payload path gives what the direct path gives.
ORACLE_SQL["stats_from_payloads"] = ORACLE_SQL["stage_stats"]
ORACLE_SQL["report_from_payloads"] = f"""
SELECT app_id, stageId, stageName, attemptId, stageStatus, job_ids, CAST(0 AS BIGINT) AS stageDuration,
       numTasks AS taskCount, skewRatio FROM ({report_sql(JOB_STATS_SQL, 3.0)})"""

# Views in which the gate, the semi join, the empty default and the NaN branch decide.
ORACLE_SQL["skewed_stages_gate"] = skewed_sql(GATE_STATS_SQL, 2.0)
ORACLE_SQL["skew_rank"] = f"""
SELECT app_id, stageId, attemptId, skewRatio,
       row_number() OVER (ORDER BY isnan(skewRatio), skewRatio DESC, app_id, stageId, attemptId) AS global_rank,
       CAST(row_number() OVER (PARTITION BY app_id ORDER BY isnan(skewRatio), skewRatio DESC, stageId, attemptId) AS INTEGER) AS app_rank
FROM ({report_sql(GATE_STATS_SQL, 3.0)})"""
ORACLE_SQL["skew_ratio_shuffle_read"] = f"""
SELECT app_id, stageId, attemptId, CASE WHEN avgShuffleBytesRead <> 0 THEN maxShuffleBytesRead / avgShuffleBytesRead
       ELSE CAST('NaN' AS DOUBLE) END AS ratio FROM ({GATE_STATS_SQL})"""
ORACLE_SQL["stages_with_large_jobs"] = f"""
SELECT t.* FROM ({TASK_SQL}) t WHERE EXISTS (
  SELECT 1 FROM ({LARGE_STAGE_JOBS_SQL}) j WHERE j.app_id = t.app_id AND j.stageId = t.stageId)"""
ORACLE_SQL["attach_large_job_ids"] = f"""
SELECT s.app_id, s.stageId, s.attemptId, COALESCE(j.job_ids, '') AS job_ids
FROM ({STATS_SQL}) s LEFT JOIN ({LARGE_STAGE_JOBS_SQL}) j ON s.app_id = j.app_id AND s.stageId = j.stageId"""

# The same rows by another way.
ORACLE_SQL["src_task_arrays"] = ORACLE_SQL["src_task_list"]
ORACLE_SQL["dedup_merged"] = ORACLE_SQL["dedup_bucketed"] = ORACLE_SQL["dedup_tasks"]
ORACLE_SQL["latest_lineitem_merged"] = ORACLE_SQL["latest_lineitem"]
ORACLE_SQL["stats_from_payloads_trusted"] = ORACLE_SQL["stage_stats"]
ORACLE_SQL["report_large_jobs"] = f"""
SELECT app_id, stageId, stageName, attemptId, stageStatus, job_ids, CAST(0 AS BIGINT) AS stageDuration,
       numTasks AS taskCount, skewRatio FROM ({report_sql(
    f"SELECT s.*, j.job_ids FROM ({STATS_SQL}) s JOIN ({LARGE_STAGE_JOBS_SQL}) j USING (app_id, stageId)", 3.0)})"""
