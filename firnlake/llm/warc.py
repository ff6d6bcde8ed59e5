"""WARC archives of pages with a two-level capture index.

Writing: payloads are grouped by digest; of equal payloads of at least ``min_bytes`` the record with
the smallest page id is a response and the others are revisits of it. Every input partition writes
one archive of gzip members, one member per record. The captures are then range-partitioned by
their key (host labels reversed, path, page id) and each part writes a file of gzip blocks of
``BLOCK_LINES`` sorted lines, and a sparse directory: the first key and byte range of each block.

Reading: look-ups are sorted by the same key. A task finds the part by binary search over the first
keys of the parts (the only list that is broadcast: one short row per part of about ``PART_LINES``
captures), the block by binary search in the part's directory, and the line in the block; so it
holds one directory and one block at a time. The byte ranges found are then dealt by archive region
and read in order of offset.

Files go to the folder given, which all executors must share; a file is written under a temporary
name and moved, with the same bytes at every attempt, so lost executors do no harm. The folder may
be any URI that Arrow's file systems open.

Defined results: a null payload is empty; a null url has an empty key. Repeated rows are records of
their own: each is looked up and returned once; equal rows that share the smallest page id are all
responses. If all page ids of a group are null, all are responses. An empty table writes no record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnlake.llm.common import stored, table
from firnlake.llm.url_filter import host_and_path
from firnlake.session import new_path

BLOCK_LINES = 300
PART_LINES = 1_000_000
REGION_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"  # one capture time, so that a repeated task writes the same bytes

CAPTURES = "page_id long, key string, file string, offset long, length long"
PARTS = "first_key string, file string, lines long"
RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
    ]
)


# -- files ------------------------------------------------------------------------------------


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") or uri.startswith("/"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class Writer:
    """One output file that appears whole or not at all."""

    def __init__(self, folder: str, name: str):
        self.fs, path = open_folder(folder)
        self.fs.create_dir(path, recursive=True)
        self.path, self.temporary = f"{path}/{name}", f"{path}/_{name}.{uuid.uuid4().hex}"
        self.out, self.offset = self.fs.open_output_stream(self.temporary), 0

    def member(self, data: bytes) -> tuple[int, int]:
        """Append ``data`` as a gzip member; its offset and length."""
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.out.write(packed)
        begin, self.offset = self.offset, self.offset + len(packed)
        return begin, len(packed)

    def plain(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.path)


class Reader:
    """Range reads; keeps the last file open."""

    def __init__(self, folder: str):
        self.fs, self.path = open_folder(folder)
        self.name, self.file = None, None

    def member(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.path}/{name}")
        return zlib.decompress(self.file.read_at(length, offset), 31)

    def whole(self, name: str) -> bytes:
        with self.fs.open_input_file(f"{self.path}/{name}") as file:
            return file.read()


# -- records ----------------------------------------------------------------------------------


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 response record, or a revisit record without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {json.dumps(url, ensure_ascii=False) if re.search(r'[\x00-\x1f]', url) or url[:1] in (' ', '\"', '') or url[-1:].isspace() else url}")
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and, for a response, the payload; the payload's digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http-length"] = re.search(rb"Content-Length: (\d+)", http)[1].decode()
    if fields["WARC-Type"] == "response":
        found = digest_text(hashlib.sha1(payload).digest())
        if f"sha1:{found}" != fields["WARC-Payload-Digest"] or len(payload) != int(fields["http-length"]):
            raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    return fields, payload


def _id(field: str) -> int | None:
    number = field.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


# -- writing ----------------------------------------------------------------------------------


def capture_key(url: Column, page_id: Column) -> Column:
    """Reversed host labels, the rest of the url, and the page id, in one sortable text."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host, _ = host_and_path(url)
    rest = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    number = F.lpad(F.coalesce(page_id.cast("string"), F.lit("")), 20, "0")
    return F.concat(labels, F.lit(")"), rest, F.lit(" "), number)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) below ``folder``; the captures written."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html).alias("sha1"))
    # only digests that occur more than once; summed in each task before the shuffle
    first = (
        keyed.where(F.octet_length("html") >= min_bytes)
        .groupBy(F.col("sha1").alias("d_sha1"))
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    first = stored(first, "warc-digests")
    enough = F.octet_length("html") >= min_bytes
    refers = F.when(enough & (F.col("first_id") != F.coalesce("page_id", F.lit(-1) - F.col("first_id"))), F.col("first_id"))
    rows = keyed.join(first, keyed["sha1"] == first["d_sha1"], "left").select(
        "page_id", "url", "html", "sha1", refers.alias("refers_to"), capture_key(F.col("url"), F.col("page_id")).alias("key")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, writer = f"part-{TaskContext.get().partitionId():06d}.warc.gz", None
        for batch in batches:
            out: list[tuple] = []
            for page_id, url, text, sha1, refers_to, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    writer = Writer(f"{folder}/archives", name)
                    info = b"software: firnlake\r\nformat: WARC File Format 1.1\r\n"
                    writer.member(
                        f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: {DATE}\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"
                    )
                data = record(page_id, url, text.encode(), digest_text(bytes.fromhex(sha1)), refers_to)
                out.append((page_id, key, name, *writer.member(data)))
            if out:
                yield _batch(out, CAPTURE_TYPES)
        if writer is not None:
            writer.close()

    # a second attempt of a task must write the same bytes
    return stored(rows.sortWithinPartitions("page_id", "sha1", "url").mapInArrow(run, CAPTURES), "warc-captures")


CAPTURE_TYPES = pa.schema([("page_id", pa.int64()), ("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
PART_TYPES = pa.schema([("first_key", pa.string()), ("file", pa.string()), ("lines", pa.int64())])
RECORD_TYPES = pa.schema(
    [
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()),
    ]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES, part_lines: int = PART_LINES) -> DataFrame:
    """Sorted blocks and directories of the captures; one row per part."""
    spark = captures.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-captures.count() // part_lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"cdx-{TaskContext.get().partitionId():06d}"
        writer, lines, directory, total = None, [], [], 0

        def block() -> None:
            offset, length = writer.member("\n".join(json.dumps(line, ensure_ascii=False) for line in lines).encode())
            directory.append([lines[0][0], offset, length])

        for batch in batches:
            for page_id, key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer = writer or Writer(f"{folder}/index", f"{name}.gz")
                lines.append([key, page_id, file, offset, length])
                total += 1
                if len(lines) == block_lines:
                    block()
                    lines = []
        if lines:
            block()
        if writer is not None:
            writer.close()
            sparse = Writer(f"{folder}/index", f"{name}.dir")
            sparse.plain("\n".join(json.dumps(x, ensure_ascii=False) for x in directory).encode())
            sparse.close()
            yield _batch([(directory[0][0], name, total)], PART_TYPES)

    sorted_ = captures.repartitionByRange(parts, "key").sortWithinPartitions("key", "file", "offset")
    return stored(sorted_.mapInArrow(run, PARTS), "warc-parts")


# -- reading ----------------------------------------------------------------------------------


class Index:
    """Finds captures by key: part, block and line by binary search."""

    def __init__(self, folder: str, parts: list[tuple[str, str]]):
        self.reader = Reader(f"{folder}/index")
        self.firsts, self.names = [p[0] for p in parts], [p[1] for p in parts]
        self.at: tuple[int, list] = (-1, [])
        self.held: tuple[int, int, list] = (-1, -1, [])

    def directory(self, part: int) -> list:
        if self.at[0] != part:
            self.at = (part, [json.loads(x) for x in self.reader.whole(f"{self.names[part]}.dir").decode().split("\n")])
        return self.at[1]

    def block(self, part: int, block: int) -> list:
        if self.held[:2] != (part, block):
            _, offset, length = self.directory(part)[block]
            lines = self.reader.member(f"{self.names[part]}.gz", offset, length).decode().split("\n")
            self.held = (part, block, [json.loads(x) for x in lines])
        return self.held[2]

    def find(self, key: str) -> Iterator[list]:
        part = bisect_right(self.firsts, key) - 1  # a key is in one part only
        if part < 0:
            return
        directory = self.directory(part)
        block = max(0, bisect_left(directory, key, key=lambda x: x[0]) - 1)
        while block < len(directory) and directory[block][0] <= key:
            lines = self.block(part, block)
            for line in lines[bisect_left(lines, key, key=lambda x: x[0]) :]:
                if line[0] != key:
                    return
                yield line
            block += 1


def find_captures(keys: DataFrame, parts: DataFrame, folder: str) -> DataFrame:
    """Captures of the distinct ``key`` values."""
    spark = keys.sparkSession
    listed = spark.sparkContext.broadcast(sorted((r.first_key, r.file) for r in parts.select("first_key", "file").collect()))
    wanted = keys.select("key").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, listed.value)
        for batch in batches:
            out = [(page_id, key, file, offset, length) for wanted in batch.column(0).to_pylist() for key, page_id, file, offset, length in index.find(wanted)]
            if out:
                yield _batch(out, CAPTURE_TYPES)

    count = max(1, len(listed.value))
    return wanted.repartitionByRange(count, "key").sortWithinPartitions("key").mapInArrow(run, CAPTURES)


def read_records(captures: DataFrame, folder: str, total_bytes: int | None = None) -> DataFrame:
    """The records at the captures' byte ranges, by regions of the archives.

    ``total_bytes`` of the archives give the number of tasks; without it there are as many as shuffle partitions.
    """
    context = captures.sparkSession.sparkContext
    if total_bytes is None:
        tasks = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    else:
        tasks = max(context.defaultParallelism, 1 + total_bytes // REGION_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(f"{folder}/archives")
        for batch in batches:
            out: list[tuple] = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fields, _ = parse_record(reader.member(file, offset, length))
                url = fields.get("WARC-Target-URI")
                refers_to = fields.get("WARC-Refers-To")
                out.append(
                    (
                        _id(fields["WARC-Record-ID"]), int(fields["http-length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                        fields["WARC-Type"], None if refers_to is None else _id(refers_to),
                        json.loads(url) if url and url.startswith('"') else url, file, offset,
                    )
                )
            if out:
                yield _batch(out, RECORD_TYPES)

    region = F.floor(F.col("offset") / REGION_BYTES)
    ranges = captures.select("file", "offset", "length").repartition(tasks, F.col("file"), region).sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(run, RECORDS)


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as WARC records and read back through the capture index."""
    pages = table(spark, folder, "pages")
    place = new_path(spark, "warc")
    captures = write_archives(pages, place, min_bytes=0)
    total = captures.agg(F.sum("length")).first()[0] or 0
    parts = write_index(captures, place)
    keys = pages.select(capture_key(F.col("url"), F.col("page_id")).alias("key"))
    return read_records(find_captures(keys, parts, place), place, total)
