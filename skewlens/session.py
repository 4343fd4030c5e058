"""Session defaults and the shared scratch location.

The caller normally owns the session; :func:`get_session` only exists for scripts and
tests.  Scratch data (derived payloads, lineage cuts) always goes below the folder the
cluster names in ``spark.checkpoint.dir``; a local folder is created only when the
session has none *and* runs in local mode.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import warnings
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",       # checkpoint files go with their last reader
    # Runtime re-planning: joins against a small side become broadcast joins only after
    # the small side's real size is measured; skewed partitions are split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
}


def get_session(master: str | None = None, app_name: str = "skewlens",
                shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above, or the caller's active session left as it is."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a local one only in local mode."""
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session: the server owns the setting
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            raise RuntimeError("spark.checkpoint.dir is not set on the server session")
        return current
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if current.startswith("file:") and not sc.master.startswith("local"):
            warnings.warn(f"{current} must be a folder that the driver and all executors share")
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a cluster needs a shared folder for scratch data")
    local = tempfile.mkdtemp(prefix="skewlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this session's scratch folder.  For the end of a job: results that still read from it fail afterwards."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark).rstrip("/") + "/skewlens")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package's source, once per application (``addPyFile``)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="skewlens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)          # the driver serves the file until it ends
    path = os.path.join(folder, "skewlens_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for where, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as parquet below the shared scratch folder and read back.

    What reads the copy runs the plan behind it only once, and a lost executor does not run it again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/skewlens/{name}-{uuid.uuid4().hex}"


def open_fs(uri: str):
    """(file system, path) of a folder in any store that pyarrow can open (file, hdfs, s3, gs)."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)
