import json
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skewlens.schemas import FLAT_TASK_COLUMNS  # noqa: E402
from skewlens.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[*]", shuffle_partitions=8)
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="skewlens-test-", dir="/tmp")


FLAT_SCHEMA = ("app_id string, stageId bigint, attemptId int, stageName string, stageStatus string, numTasks int, "
               "taskId bigint, attempt bigint, status string, duration bigint, resultSize bigint, jvmGcTime bigint, "
               "bytesRead bigint, bytesWritten bigint, shuffleBytesRead bigint, shuffleBytesWritten bigint")


def flat_rows(spark, rows):
    """rows: dicts with any of the flat columns; sensible defaults for the rest."""
    defaults = dict(app_id="app-1", stageId=1, attemptId=0, stageName="s", stageStatus="COMPLETE", numTasks=10,
                    taskId=0, attempt=0, status="SUCCESS", duration=0, resultSize=0, jvmGcTime=0, bytesRead=0,
                    bytesWritten=0, shuffleBytesRead=0, shuffleBytesWritten=0)
    data = [tuple({**defaults, **r}[c] for c in FLAT_TASK_COLUMNS) for r in rows]
    return spark.createDataFrame(data, FLAT_SCHEMA)


def task_json(task_id, duration=10, status="SUCCESS", attempt=0, bytes_read=0, bytes_written=0,
              remote=0, local=0, shuffle_written=0, drop=()):
    """A task object shaped like the monitoring REST API's (self-authored values).
    Fixed values: the key names, those of that API."""
    t = {
        "taskId": task_id, "index": task_id % 7, "attempt": attempt,
        "launchTime": "2026-03-04T05:06:07.089GMT", "duration": duration, "executorId": "3",
        "host": "worker-a", "status": status, "taskLocality": "PROCESS_LOCAL", "speculative": False,
        "accumulatorUpdates": [],
        "taskMetrics": {
            "executorDeserializeTime": 1, "executorDeserializeCpuTime": 2, "executorRunTime": duration // 2,
            "executorCpuTime": 3, "resultSize": 1500, "jvmGcTime": 4, "resultSerializationTime": 0,
            "memoryBytesSpilled": 0, "diskBytesSpilled": 0, "peakExecutionMemory": 0,
            "inputMetrics": {"bytesRead": bytes_read, "recordsRead": 5},
            "outputMetrics": {"bytesWritten": bytes_written, "recordsWritten": 6},
            "shuffleReadMetrics": {"remoteBlocksFetched": 0, "localBlocksFetched": 1, "fetchWaitTime": 0,
                                   "remoteBytesRead": remote, "remoteBytesReadToDisk": 0,
                                   "localBytesRead": local, "recordsRead": 7},
            "shuffleWriteMetrics": {"bytesWritten": shuffle_written, "writeTime": 8, "recordsWritten": 9},
        },
    }
    for path in drop:
        node = t
        parts = path.split(".")
        for p in parts[:-1]:
            node = node[p]
        node.pop(parts[-1])
    return t


def stage_json(stage_id, attempt_id, tasks, name="stage", status="COMPLETE", num_tasks=None, **extra):
    d = {"stageId": stage_id, "attemptId": attempt_id, "name": name, "status": status,
         "numTasks": len(tasks) if num_tasks is None else num_tasks, "numCompleteTasks": len(tasks),
         "numFailedTasks": 0, "firstTaskLaunchedTime": "2026-03-04T05:06:07.000GMT",
         "completionTime": "2026-03-04T05:09:07.000GMT",
         "tasks": {str(t.get("taskId", f"no-id-{i}")): t for i, t in enumerate(tasks)}}
    d.update(extra)
    return d


def write_json(path, obj):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump(obj, f, indent=1)
