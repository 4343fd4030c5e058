"""WARC archives: records written with an index, then read by coalesced byte ranges.

Writing: equal payloads of at least ``least`` bytes have one response record, the others are revisit records that
name it.  Each task writes one archive (WARC/1.1, a gzip member per record) into the given shared folder, and returns the
index row of each record: file, offset, length, URL, digest.  The index is a table written by Spark, so it names
only files of tasks that succeeded; a lost or repeated task leaves at most a file that nothing refers to.

Reading: the index is filtered first; the selected rows are dealt by ranges of (file, offset), and each task merges
neighbouring byte ranges into one read where the gap is small.

Defined results: a null payload is empty; a null URL has no target header; a null id is written as ``none`` and refers like any other; equal
payloads below ``least`` bytes are all responses; rows that repeat the largest id of a group are all responses; repeated rows are
written as often as they occur; an empty table writes no archive and has an empty index.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewlens.llm.common import cut, open_fs, ship_package
from skewlens.session import scratch_path

INDEX = "file string, offset bigint, length bigint, page_id bigint, url string, record_type string, digest string"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, digest string, payload binary"
#: WARC field values fixed by the standard.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Ranges closer than this are read together, up to so many bytes at once.
GAP, MOST_READ = 64 << 10, 8 << 20


def decide(pages: DataFrame, id_col: str, url_col: str, body_col: str, least: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to), one row per page."""
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        body.alias("payload"), F.sha1(body).alias("digest"))
    slim = cut(rows.where(F.octet_length("payload") >= least).select("page_id", "digest"), "digests")
    first = cut(slim.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
                    .where("n > 1").drop("n"), "responses")
    again = cut(slim.join(first, "digest").where("not (page_id <=> response)").distinct(), "revisits").select(
        F.col("digest").alias("d"), F.col("page_id").alias("p"), F.col("response").alias("refers_to"))
    # Joined by (digest, page), so a large group is spread over its pages.
    out = rows.join(again, (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("p")), "left")
    return out.select("page_id", "url", "payload", "digest",
                      F.when(F.col("d").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to")


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _number(text: str) -> int | None:
    value = text.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One WARC record: headers, block and the two closing line ends."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _id(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~-._")))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _id(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record, its HTTP headers' length field and its payload (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(line.decode().split(": ", 1) for line in lines)
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    kind = fields["WARC-Type"]
    return {"fields": fields, "kind": kind, "size": size, "payload": payload if kind == "response" else None}


def write_archives(decided: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write the records and return their index, a written table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            files, offsets, lengths = [], [], []
            for row in zip(*(batch.column(i) for i in range(6))):
                page_id, url, payload, digest, kind, refers_to = (x.as_py() for x in row)
                packer = zlib.compressobj(level, wbits=31)
                data = packer.compress(record(page_id, url, payload, digest, kind, refers_to, date)) + packer.flush()
                if out is None:
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                out.write(data)
                files.append(name)
                offsets.append(at)
                lengths.append(len(data))
                at += len(data)
            columns = [pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()),
                       batch.column(0), batch.column(1), batch.column(4), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["file", "offset", "length", "page_id", "url", "record_type", "digest"])
        if out is not None:
            out.close()

    ship_package(decided.sparkSession)
    columns = decided.select("page_id", "url", "payload", "digest", "record_type", "refers_to")
    return cut(columns.mapInArrow(run, INDEX), "index")


def _ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, start, end, members) of sorted (file, offset, length) rows merged across small gaps."""
    file, start, end, members = None, 0, 0, []
    for f, offset, length in rows:
        if f != file or offset - end > GAP or offset + length - start > MOST_READ:
            if members:
                yield file, start, end, members
            file, start, end, members = f, offset, offset, []
        members.append((offset, length))
        end = max(end, offset + length)
    if members:
        yield file, start, end, members


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the index rows given; ``payload`` is null for revisits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        opened = {}
        for batch in batches:
            url_of = {(f, o): u for f, o, u in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)))}
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for file, start, end, members in _ranges(rows):
                if file not in opened:
                    for old in opened.values():
                        old.close()
                    opened = {file: fs.open_input_file(f"{top}/{file}")}
                data = opened[file].read_at(end - start, start)
                out = []
                for offset, length in members:
                    r = parse(zlib.decompress(data[offset - start:offset - start + length], wbits=31))
                    fields = r["fields"]
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    refers = _number(fields["WARC-Refers-To"]) if r["kind"] == "revisit" else None
                    out.append((_number(fields["WARC-Record-ID"]), url_of[file, offset], r["kind"], refers, r["size"], digest, r["payload"]))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 ["page_id", "url", "record_type", "refers_to", "payload_bytes", "digest", "payload"])

    ship_package(index.sparkSession)
    chosen = index.select("file", "offset", "length", "url").repartitionByRange("file", "offset")
    return chosen.sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, id_col: str = "page_id",
            url_col: str = "url", body_col: str = "html") -> tuple[DataFrame, str]:
    """(index, folder) of new archives of all pages."""
    folder = folder or scratch_path(spark, "warc")
    return write_archives(decide(pages, id_col, url_col, body_col), folder), folder
