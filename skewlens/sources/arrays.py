"""JSON arrays (saved REST responses) read by several tasks.

A JSON array is one value, and Spark's JSON reader parses a file that holds one in a single task.  Here Spark's text reader splits the
file at its blocks, as it does any text, into fragments that end with a closing brace.  Whether a fragment's braces
count depends on what comes before it, so the file is read twice:

1. Every block is summed up for both cases, that it begins inside a string or outside: how far it changes the depth of
   brackets, the least depth after a closing brace, and whether it ends inside a string.  From these few numbers per block the driver
   works out, block by block, the depth and case in which each block really begins.
2. Every block is read again from that state and hands out the elements that lie in it.  Only the pieces of elements that cross a
   block's border are shuffled, by element, and put together.

Files that are no larger than Spark's blocks of the whole input need no index: they begin in the known state, and no element crosses a
border.  So the index has rows for the blocks of the larger files only, however many files there are.  The files are listed by tasks
(``sources.listing``), and those of one block are opened and read by them too, a piece at a time: the driver knows the larger files alone.
In a store that the tasks cannot open, Spark lists the files, on the driver.

The elements are then parsed with the declared schema as JSON Lines are.  A file whose first value is no array is taken as a
sequence of objects.  What is left of a truncated file is a malformed record.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewlens.session import open_fs, ship_package
from skewlens.sources.listing import FILES_PER_TASK, below, folder_values, list_files, listed_by_few_tasks, tasks_for, text_files

#: Files that the tasks unpack; Hadoop's own formats are left to Spark's reader.
_COMPRESSION, _HADOOP_ONLY = {"gz": "gzip", "bz2": "bz2"}, r"\.(deflate|snappy|lz4|zst|zstd)$"
_PIECE = 1 << 20
_ESCAPED = re.compile(r"\\.", re.DOTALL)


def outside(fragment: str, inside: bool) -> tuple[str, bool]:
    """The parts of the fragment outside of strings, and whether it ends inside one."""
    if "\\" in fragment:
        fragment = _ESCAPED.sub("", fragment)
    parts = fragment.split('"')
    return "".join(parts[1 if inside else 0::2]), inside ^ (len(parts) % 2 == 0)


def depth_change(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("]")


def _fragments(text: DataFrame) -> DataFrame:
    return text.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), "value")


def _listed_by_spark(spark: SparkSession, path) -> tuple[_Source, DataFrame, list[T.StructField]]:
    """Fragments of the files that are one block for sure, and of the others.

    The size of a file is known before it is read, so each of the two reads its own files only.
    """
    with listed_by_few_tasks(spark):
        text = spark.read.option("lineSep", "}").text(path)
    conf = spark._jsparkSession.sessionState().conf()
    one_block = min(conf.filesOpenCostInBytes(), conf.filesMaxPartitionBytes())          # Spark's splits are no smaller
    size = F.col("_metadata.file_size")
    return _Source(_fragments(text.where(size <= one_block)), _by_block), _fragments(text.where(size > one_block)), text.schema.fields[1:]


def _listed_by_tasks(spark: SparkSession, path) -> tuple[_Source, DataFrame, list[T.StructField]] | None:
    """As :func:`_listed_by_spark`; the first of the two are names of files."""
    files = list_files(spark, path)
    if files is None:
        return None
    conf = spark._jsparkSession.sessionState().conf()
    cost, most = conf.filesOpenCostInBytes(), conf.filesMaxPartitionBytes()
    one_block = min(most, max(cost, (files.size + files.n * cost) // spark.sparkContext.defaultParallelism))     # as Spark splits files
    whole = (F.col("size") <= one_block) & ~F.lower("path").rlike(_HADOOP_ONLY)
    large = files.table.where(~whole).collect()
    text = (_fragments(text_files(spark, [below(files.roots[f.root], f.path) for f in large], lineSep="}")) if large
            else spark.createDataFrame([], "_file string, _block bigint, value string"))
    tasks = max(tasks_for(spark, files.n - len(large), FILES_PER_TASK), -(-(files.size - sum(f.size for f in large)) // most))
    # Rows of names say nothing about the size of what is read; Spark takes an RDD's size as unknown, so as too large to broadcast.
    names = files.table.where(whole & (F.col("size") > 0)).select("root", "path").repartition(tasks, "root", "path")
    return _Source(spark.createDataFrame(names.rdd, names.schema, verifySchema=False), _by_file(files.roots)), text, files.folders


def _is_array(values: list[str]) -> bool:
    return "".join(values[:64]).lstrip("\ufeff \t\r\n").startswith("[")


def _by_block(batches):
    """((file, block), fragments) for each stretch of a block's fragments in a batch."""
    for batch in batches:
        files, blocks, values = (batch.column(name).to_pylist() for name in ("_file", "_block", "value"))
        first = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or files[i] != files[first] or blocks[i] != blocks[first]:
                yield (unquote(files[first]), blocks[first]), values[first:i]
                first = i


def file_fragments(stream):
    """The fragments of a file's text as Spark's text reader makes them, some at a time; what follows the last brace is one if not empty."""
    decode, rest = codecs.getincrementaldecoder("utf-8")("replace").decode, ""
    while piece := stream.read(_PIECE):
        *values, rest = (rest + decode(piece)).split("}")
        if values:
            yield values
    if rest := rest + decode(b"", True):
        yield [rest]


def _by_file(roots: list[str]):
    """As :func:`_by_block`, over names of files."""
    def run(batches):
        opened = [open_fs(root) for root in roots]
        for batch in batches:
            for root, path in zip(batch.column("root").to_pylist(), batch.column("path").to_pylist()):
                fs, at = opened[root][0], below(opened[root][1], path)
                with fs.open_input_stream(at, compression=_COMPRESSION.get(at.lower().rsplit(".", 1)[-1])) as stream:
                    for values in file_fragments(stream):
                        yield (at, 0), values
    return run


class _Source(NamedTuple):
    """Rows, and what makes ((file, block), fragments) of their batches."""
    rows: DataFrame
    read: Callable


_INDEX = "file string, block bigint, array boolean, change0 bigint, least0 bigint, inside0 boolean, change1 bigint, least1 bigint, inside1 boolean"


def block_index(fragments: DataFrame) -> DataFrame:
    """One row per block: what it does to the depth and the string state, from either state at its start."""
    def run(batches):
        rows, key = [], None
        for own, values in _by_block(batches):
            if own != key:
                key = own
                rows.append([*own, _is_array(values), 0, 1 << 60, False, 0, 1 << 60, True])
            row = rows[-1]
            for at in (3, 6):
                change, least, inside = row[at:at + 3]
                for value in values:
                    text, inside = outside(value, inside)
                    change += depth_change(text)
                    if not inside:
                        change -= 1
                        least = min(least, change)
                row[at:at + 3] = change, least, inside
        yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in rows], schema)

    names = [part.split()[0] for part in _INDEX.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in _INDEX.split(", ")])
    return fragments.select("_file", "_block", "value").mapInArrow(run, _INDEX)


def block_starts(index: list) -> dict[tuple[str, int], tuple[int, int, bool, int | None, bool]]:
    """(file, block) -> (depth of elements, depth at the start, inside a string, block in which the open element began, last)."""
    by_file: dict[str, list] = {}
    for row in index:
        by_file.setdefault(row["file"], []).append(row)
    out = {}
    for file, rows in by_file.items():
        rows.sort(key=lambda r: r["block"])
        base = 1 if rows[0]["array"] else 0
        depth, inside, owner = 0, False, None
        for row in rows:
            out[file, row["block"]] = (base, depth, inside, owner, row is rows[-1])
            case = "1" if inside else "0"
            closes = depth + row[f"least{case}"] <= base
            if owner is None or closes:
                owner = row["block"]
            depth, inside = depth + row[f"change{case}"], row[f"inside{case}"]
            if depth <= base and not inside:
                owner = None
    return out


def array_elements(spark: SparkSession, path) -> DataFrame:
    """(columns of the folders, value): the JSON text of every element of the arrays below ``path``."""
    ship_package(spark)
    small, large, folders = _listed_by_tasks(spark, path) or _listed_by_spark(spark, path)
    extra = [f.name for f in folders]
    columns = [F.col(f"`{f.name}`").cast(f.dataType) if f.dataType != T.NullType() else F.lit(None).alias(f.name) for f in folders]
    columns.append(F.col("value"))
    # One row per block, as many as Spark has tasks to read the large files.
    index = [r.asDict() for r in block_index(large).collect()]
    whole = _elements(small, extra, None).select(*extra, "value")
    if not index:
        return whole.select(*columns)
    found = _elements(_Source(large, _by_block), extra, spark.sparkContext.broadcast(block_starts(index)))
    whole = whole.unionByName(found.where("_owner is null").select(*extra, "value"))
    # Pieces of one element: at most one per block that it touches.
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "value"))), lambda p: p["value"]), "")
    crossing = found.where("_owner is not null").groupBy("_file", *extra, "_owner").agg(parts.alias("value"))
    return whole.unionByName(crossing.select(*extra, F.regexp_replace("value", r"^[^{]*", "").alias("value"))).select(*columns)


def _elements(source: _Source, extra: list[str], starts) -> DataFrame:
    """(file, texts of the folders, owner, block, value): whole elements (owner null) and pieces of those that cross a block's border.

    ``starts``: the broadcast states in which blocks begin; None, if every file is one block.
    """
    stretches = source.read

    def run(batches):
        key = None
        base = depth = inside = owner = last = None
        held: list[str] = []

        def rest():
            """The open element at a block's end; only the last fragment of a file has no closing brace."""
            text = "}".join(held) + ("" if last else "}")
            return text if "{" in text or owner is not None else None

        def remainder(text):
            return (key[1] if owner is None else owner, key[1], text) if starts else (None, key[1], text[text.index("{"):])

        for own, values in stretches(batches):
            out: list[tuple] = []
            if own != key:
                if key and (text := rest()) is not None:
                    yield _rows(key, [remainder(text)])
                if own not in starts.value if starts else own[1]:
                    raise RuntimeError(f"{own} was not in the index: the files or the split size changed meanwhile")
                key, held = own, []
                base, depth, inside, owner, last = starts.value[own] if starts else (int(_is_array(values)), 0, False, None, True)
            for value in values:
                held.append(value)
                text, inside = outside(value, inside)
                depth += depth_change(text)
                if inside:
                    continue
                depth -= 1
                if depth == base:
                    whole = "}".join(held) + "}"
                    out.append((None, key[1], whole[whole.index("{"):]) if owner is None else (owner, key[1], whole))
                    held, owner = [], None
            if out:
                yield _rows(key, out)
        if key and (text := rest()) is not None:
            yield _rows(key, [remainder(text)])

    def _rows(key, found):
        owners, blocks, texts = zip(*found)
        same = [pa.array([value] * len(found), pa.string()) for value in (key[0], *folder_values(key[0], len(extra)))]
        return pa.RecordBatch.from_arrays([*same, pa.array(owners, pa.int64()), pa.array(blocks, pa.int64()), pa.array(texts)],
                                          ["_file", *extra, "_owner", "_block", "value"])

    texts = "".join(f"`{name}` string, " for name in extra)
    return source.rows.mapInArrow(run, f"_file string, {texts}_owner bigint, _block bigint, value string")


def read_arrays(spark: SparkSession, path, schema: T.StructType, corrupt: str) -> DataFrame:
    """The elements parsed with ``schema`` (which has the column ``corrupt``), with the columns of the folders beside them.

    A field that is missing in an element and named by a folder has the folder's value.
    """
    texts = array_elements(spark, path)
    fields = [f.name for f in schema]
    record = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    parsed = texts.withColumn("_record", record)
    folder = [c for c in texts.columns if c != "value"]
    own = [F.coalesce(F.col(f"_record.{c}"), F.col(c).cast(schema[c].dataType)).alias(c) if c in folder else F.col(f"_record.{c}").alias(c)
           for c in fields]
    return parsed.select(*[c for c in folder if c not in fields], *own)
