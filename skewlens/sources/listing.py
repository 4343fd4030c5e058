"""Files below a folder, listed by the tasks.

Spark's readers keep each file and folder of their input on the driver, some 2 KB for each.  That is nothing for files of many blocks, but
a folder per stage attempt makes millions of them.  Here the driver only counts them: the folders of a level are listed by tasks
into a parquet copy, and those found in it are dealt out again for the next level.  Only what has no more than
``LISTED_HERE`` files and folders is listed by the driver, which takes less time than to start tasks.

The rules are Spark's: hidden files and folders are left out; folders ``key=value`` are columns, and then files beside such folders are not
read; without them the files of the given folder alone are.  The columns' types are inferred by Spark itself, from
a file for every kind of value in each column (:func:`value_kind`) instead of all of them.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewlens.session import open_fs, ship_package, written

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: What tasks list, or read, at least; a task costs more than this.
FOLDERS_PER_TASK, FILES_PER_TASK = 2000, 5000
LISTED_HERE = 1000
_ROWS = 10_000
_LISTED = "root int, path string, folder boolean, size bigint"
_ARROW = pa.schema([("root", pa.int32()), ("path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64())])
_KEY_FOLDER = "(^|/)[^/]*=[^/]*/[^/]+$"
_NUMBER = re.compile(r"\s*[+-]?(NaN|Infinity|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[fFdD]?|0[xX][\da-fA-F.]+[pP][+-]?\d+[fFdD]?)\s*")
_TIME = re.compile(r"\s*[+-]?\d{4,}-\d|T?\d.*(:|%3A)", re.IGNORECASE)


class Files(NamedTuple):
    """``table``: (root, path, size) of every file, ``path`` below its root; ``n`` and ``size``: of all of them."""
    roots: list[str]
    table: DataFrame
    n: int
    size: int
    folders: list[T.StructField]


def given_paths(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The paths qualified, patterns replaced by what they match; Spark's own error for one that is not there."""
    out = []
    for one in [path] if isinstance(path, str) else path:
        at = spark._jvm.org.apache.hadoop.fs.Path(one)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        at = fs.makeQualified(at)
        if any(c in one for c in "{}[]*?\\"):
            found = [s.getPath().toString() for s in fs.globStatus(at) or []]
        else:
            found = [at.toString()] if fs.exists(at) else []
        if not found:
            spark.read.text(one)
        out += found
    return out


def opened_by_tasks(roots: list[str]) -> list[stores.FileInfo] | None:
    """What is at each of the paths; None if pyarrow cannot open their store (Hadoop's connectors know more of them)."""
    try:
        return [fs.get_file_info(at) for fs, at in map(open_fs, roots)]
    except (pa.ArrowException, OSError, ImportError):
        return None


def hidden(name: str) -> bool:
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _entries(fs: stores.FileSystem, at: str) -> Iterator[tuple[str, bool, int]]:
    """(name, is it a folder, size) of what is in a folder."""
    if not isinstance(fs, stores.LocalFileSystem):
        yield from ((i.base_name, i.type == stores.FileType.Directory, i.size or 0) for i in fs.get_file_info(stores.FileSelector(at)))
        return
    with os.scandir(at) as found:
        for entry in found:
            try:
                folder = entry.is_dir()
                yield entry.name, folder, 0 if folder else entry.stat().st_size
            except FileNotFoundError:                        # gone meanwhile, or a link to nothing
                continue


def below(top: str, path: str) -> str:
    return f"{top}/{path}" if path else top


def _listed(opened: list, folders: Iterator[tuple[int, str]]) -> Iterator[tuple[int, str, bool, int]]:
    """Rows of ``_LISTED``: what is in each of the folders, given as (root, path)."""
    for root, path in folders:
        fs, top = opened[root]
        for name, folder, size in _entries(fs, below(top, path)):
            if not hidden(name):
                yield root, below(path, name) if path else name, folder, size


def _listed_here(roots: list[str], folders: list[tuple[int, str]]) -> list[tuple[int, str, bool, int]] | None:
    """All that is below the folders, None if it is too much."""
    opened, out = [open_fs(root) for root in roots], []
    while folders:
        new = list(islice(_listed(opened, folders), LISTED_HERE + 1 - len(out)))
        out += new
        if len(out) > LISTED_HERE:
            return None
        folders = [row[:2] for row in new if row[2]]
    return out


def _lister(roots: list[str]):
    def run(batches):
        opened = [open_fs(root) for root in roots]
        each = _listed(opened, (row for b in batches for row in zip(b.column("root").to_pylist(), b.column("path").to_pylist())))
        while some := list(islice(each, _ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), _ARROW)], schema=_ARROW)
    return run


def tasks_for(spark: SparkSession, n: int, per_task: int) -> int:
    """One for every core if there is as much to do, more if each would get over ``per_task``."""
    return max(1, min(n, spark.sparkContext.defaultParallelism), -(-n // per_task))


def value_kind(raw: str) -> str:
    """Values of one kind are inferred to be of one type; a value that may be a date or a wide or broken number is a kind of its own."""
    if raw == NO_VALUE or not raw:
        return f"none {raw}"
    if re.fullmatch("[+-]?[0-9]{1,18}", raw):
        return "int" if -1 << 31 <= int(raw) < 1 << 31 else "long"
    return f"value {raw}" if _NUMBER.fullmatch(raw) or _TIME.match(raw) else "text"


def _kinds_of(path: str) -> Iterator[tuple[tuple, str]]:
    """(kind of folders, folder above the key folders): one for each column, one for a file that is in no key folder."""
    above = path.split("/")[:-1]
    values = []
    while above and "=" in above[-1]:
        values.append(above.pop().split("=", 1))
    names, top = tuple(name for name, _ in reversed(values)), "/".join(above)
    for name, raw in values:
        yield (names, name, value_kind(raw)), top
    if not values:
        yield ((), bool(above)), top


def _some_of_each_kind(batches):
    """The first and the last file (by folder above, then path) of each kind that a task meets."""
    ends: dict[tuple, list] = {}
    for batch in batches:
        for path in batch.column("path").to_pylist():
            for kind, above in _kinds_of(path):
                least, most = ends.setdefault(kind, [(above, path)] * 2)
                ends[kind] = [min(least, (above, path)), max(most, (above, path))]
    rows = [(json.dumps(kind), *end) for kind, both in ends.items() for end in both]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["kind", "above", "path"])


@contextmanager
def listed_by_few_tasks(spark: SparkSession):
    """Spark lists folders with a task for each, up to this number; a task costs more than hundreds of folders."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(int(old), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def text_files(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    """Spark's text reader over files whose names are known, not patterns."""
    with listed_by_few_tasks(spark):
        return spark.read.options(**options, __globPaths__="false").text(paths)


def _folder_columns(spark: SparkSession, roots: list[str], table: DataFrame) -> list[T.StructField] | None:
    """The columns that Spark makes of the folders; None if only Spark can tell, for several paths."""
    end = F.struct("above", "path")
    kinds = table.select("path").mapInArrow(_some_of_each_kind, "kind string, above string, path string").groupBy("kind").agg(
        F.min(end).alias("least"), F.max(end).alias("most")).collect()
    if not any(json.loads(r.kind)[0] for r in kinds):
        return []
    if len(roots) > 1:
        return None
    files = sorted({e.path for r in kinds for e in (r.least, r.most)})
    return text_files(spark, [below(roots[0], f) for f in files], basePath=roots[0]).schema.fields[1:]


def list_files(spark: SparkSession, path: str | list[str]) -> Files | None:
    """The files that Spark's readers would read of ``path``; None if the tasks cannot list them."""
    roots = given_paths(spark, path)
    found = opened_by_tasks(roots)
    if found is None:
        return None
    ship_package(spark)
    files = [(i, "", False, info.size) for i, info in enumerate(found) if info.type == stores.FileType.File]
    folders = [(i, "") for i, info in enumerate(found) if info.type != stores.FileType.File]
    here = _listed_here(roots, folders)
    files += [row for row in here or [] if not row[2]]
    tables, n, size = [spark.createDataFrame(files, _LISTED)], len(files), sum(row[3] for row in files)
    level = spark.createDataFrame(folders, "root int, path string")
    while here is None:
        listed = written(level.mapInArrow(_lister(roots), _LISTED), "listing")
        more, bytes_, left = listed.agg(F.count_if(~F.col("folder")), F.sum(F.col("size")), F.count_if("folder")).first()
        if more:
            tables, n, size = [*tables, listed.where("not folder")], n + more, size + bytes_
        if not left:
            break
        level = listed.where("folder").select("root", "path").repartition(tasks_for(spark, left, FOLDERS_PER_TASK), "root", "path")
    table = reduce(DataFrame.unionByName, tables)
    columns = _folder_columns(spark, roots, table)
    if columns is None:
        return None
    read = F.col("path").rlike(_KEY_FOLDER) if columns else ~F.col("path").contains("/")
    return Files(roots, table.where(read).select("root", "path", "size"), n, size, columns)


def folder_values(path: str, n: int) -> list[str | None]:
    """The texts of the last ``n`` folders ``key=value`` above a file."""
    raw = [folder.split("=", 1)[1] for folder in path.split("/")[-1 - n:-1]] if n else []
    return [None if r == NO_VALUE else re.sub("%([0-9A-Fa-f]{2})", lambda code: chr(int(code[1], 16)), r) for r in raw]
