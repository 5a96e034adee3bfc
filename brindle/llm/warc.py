"""WARC archives with an index of byte ranges.

Writing and reading are two steps joined by the index, a Parquet table with a
row per record: file, offset, length, URL and digest. Reading begins with the
index, so a selection of records costs only the byte ranges that it needs.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import new_path, stage

INDEX = "file string, offset long, length long, record_id string, page_id long, url string, record_type string, payload_digest string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_ID = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PRINTABLE = "".join(chr(c) for c in range(0x21, 0x7F))
_INVERTIBLE = _PRINTABLE.replace("%", "")


def mark_revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Add payload_bytes, payload_digest and refers_to (null for responses).

    Of equal payloads of at least ``min_bytes`` bytes those with the smallest
    page_id are responses (all of them, if it is repeated), the others refer to
    it. A null html is an empty payload; rows without page_id are responses.
    The aggregate combines on the map side, and its staged result is broadcast
    if it is small, or else joined by a shuffle in which AQE splits a hot digest.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", F.encode(body, "UTF-8").alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    slim = pages.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("page_id").alias("n"))
    first = stage(slim.filter("n > 1").select("payload_digest", "refers_to"), "payloads")
    joined = pages.join(first, "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("refers_to") < F.col("page_id"), F.col("refers_to")))


def _id(page_id: int | None) -> str:
    return f"<{_ID}{'' if page_id is None else page_id}>"


def _page(record_id: bytes) -> int | None:
    n = record_id.strip(b"<>").rpartition(b":")[2]
    return int(n) if n else None


def _record(row: dict, date: str) -> bytes:
    revisit = row["refers_to"] is not None
    payload = b"" if revisit else row["payload"]
    http = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(row['page_id'])}", f"WARC-Date: {date}"]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {quote(row['url'], safe=_PRINTABLE)}")
        if not row["url"].isascii() or not row["url"].isprintable() or " " in row["url"]:
            head.append(f"X-Original-URI: {quote(row['url'], safe=_INVERTIBLE)}")
    head += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_id(row['refers_to'])}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str | None = None, date: str = "1970-01-01T00:00:00Z", level: int = 2, file_bytes: int = 1 << 28) -> DataFrame:
    """Write a record per row of ``mark_revisits`` and return the staged index.

    Each task writes files of its own, a gzip member per record, and starts
    another after ``file_bytes``. A task that runs twice leaves a file that no
    index row names. ``path`` may be any URI that pyarrow's file systems open.
    Repeated rows have a record each, payloads of any length are written whole,
    an empty table gives an empty index and no file; rows without page_id or
    url have records without. An address that isn't plain ASCII is encoded as
    the format asks, and kept as it was beside that.
    """
    spark = pages.sparkSession
    folder = path or new_path(spark, "warc")
    base = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(_uri(base))
        system.create_dir(root, recursive=True)
        out = name = None
        at = 0
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)
                member = gzip.compress(_record(row, date), level, mtime=0)
                out.write(member)
                made.append((f"{base}/{name}", at, len(member), _id(row["page_id"]), row["page_id"], row["url"], "response" if row["refers_to"] is None else "revisit", row["payload_digest"]))
                at += len(member)
                if at >= file_bytes:
                    out.close()
                    out = None
            yield _batch(made, ["file", "offset", "length", "record_id", "page_id", "url", "record_type", "payload_digest"], _INDEX_TYPES)
        if out is not None:
            out.close()

    columns = pages.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")
    return stage(columns.mapInArrow(write, INDEX), "warc-index")


def byte_runs(index: DataFrame, gap: int = 1 << 16, run_bytes: int = 1 << 23) -> DataFrame:
    """Coalesce the records of an index, or of any selection from one, into runs of a single read.

    Sorted by offset, records at most ``gap`` bytes apart share a run, unless
    they begin in different stretches of ``run_bytes``; so a run is bounded,
    single longer records apart. A record that a selection names twice is read
    twice; an empty selection has no runs.
    """
    by = Window.partitionBy("file").orderBy("offset")
    end = F.lag(F.col("offset") + F.col("length")).over(by)
    stretch = F.floor(F.col("offset") / run_bytes)
    fresh = end.isNull() | (F.col("offset") - end > gap) | (stretch != F.lag(stretch).over(by))
    runs = index.select("file", "offset", "length", fresh.cast("int").alias("fresh")).withColumn("run", F.sum("fresh").over(by))
    return runs.groupBy("file", "run").agg(F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("parts"))


def read_warc(index: DataFrame, with_payload: bool = True, gap: int = 1 << 16, run_bytes: int = 1 << 23) -> DataFrame:
    """The records that an index, or a selection from one, names; a run of them per read.

    A response's length and digest are taken from the payload that was read and
    must agree with its header; a revisit's are those of its header. Without
    ``with_payload`` the payload column is null. An index row gives a record,
    repeated ones too, and an empty index gives none.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.to_pylist():
                system, name = fs.FileSystem.from_uri(_uri(run["file"]))
                with system.open_input_file(name) as f:
                    f.seek(run["begin"])
                    data = memoryview(f.read(run["end"] - run["begin"]))
                made = []
                for part in run["parts"]:
                    at = part["offset"] - run["begin"]
                    made.append(parse_record(zlib.decompress(data[at : at + part["length"]], 31), with_payload))
                yield _batch(made, ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"], _RECORD_TYPES)

    # few bytes of index stand for many of archive, so their number of partitions is fixed
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return byte_runs(index, gap, run_bytes).repartition(tasks, "file", "begin").mapInArrow(read, RECORD)


def parse_record(record: bytes, with_payload: bool = True) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(b": ") for line in lines[1:])}
    body = rest[: int(fields[b"content-length"])]
    if len(rest) != len(body) + 4:
        raise ValueError("a record's length differs from its header")
    kind = fields[b"warc-type"].decode()
    declared = fields[b"warc-payload-digest"].decode().partition(":")[2]
    size, payload, refers = int(fields[b"x-payload-length"]), None, None
    if kind == "revisit":
        refers = _page(fields[b"warc-refers-to"])
    else:
        payload = body.partition(b"\r\n\r\n")[2]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != declared:
            raise ValueError("a payload differs from its digest")
    url, original = fields.get(b"warc-target-uri"), fields.get(b"x-original-uri")
    url = unquote(original.decode()) if original is not None else None if url is None else url.decode()
    return _page(fields[b"warc-record-id"]), url, size, declared, kind, refers, payload if with_payload else None


def _uri(path: str) -> str:
    return "file:///" + path[5:].lstrip("/") if path.startswith("file:") else path


_INDEX_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
_RECORD_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)
