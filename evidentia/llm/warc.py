"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing: each task writes files of gzip members, a record each, under names of
its own, and begins another after ``FILE_BYTES``; ``commit`` lists the files of
the successful attempts in a manifest, so a retried or lost task leaves no
records that count twice. A member's header tells its length (sub-field ``sl``). Rows need
``record_id, record_type, target_uri, payload`` and may have ``payload_digest,
payload_bytes, refers_to``.

Reading: the manifest (or a listing) is planned into partitions, one per slice
of files. Filters on ``record_type``, ``target_uri`` or ``record_id`` (equal or
in a list) are pushed down: headers are parsed first, and the block of a record
that fails them, or of any record if ``payload`` is not asked for, is passed over
by a seek, neither inflated nor decoded. Members that don't tell their length,
as those of other writers, are inflated in turn. Files are opened through Arrow's file systems, so a
shared local folder, HDFS or an object store will do.

Call ``load`` anew for each set of filters: Spark 4.1 keeps a Python source's
pushed filters with the loaded frame.

Defined results: a null payload is written as an empty one; null header values
are left out and read back as null; a header value's line breaks become spaces;
an empty table gives an archive without records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .shared import materialize, may_be_among

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"
MANIFEST = "_warc_manifest.json"
#: Columns that can be checked on headers alone.
HEADER_COLUMNS = ("record_type", "target_uri", "record_id")
#: Bytes of archive, about, in one read partition.
SLICE_BYTES = 16 << 20
#: Bytes after which a task begins another file.
FILE_BYTES = 64 << 20
_HEADERS = {
    "WARC-Record-ID": "record_id",
    "WARC-Type": "record_type",
    "WARC-Target-URI": "target_uri",
    "WARC-Payload-Digest": "payload_digest",
    "WARC-Payload-Length": "payload_bytes",
    "WARC-Refers-To": "refers_to",
}
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _open_fs(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def record_bytes(row: dict) -> bytes:
    """One record, uncompressed."""
    payload = bytes(row.get("payload") or b"")
    revisit = row["record_type"] == "revisit"
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    digest = row.get("payload_digest") or sha1_base32(payload)
    size = row.get("payload_bytes")
    values = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<{row['record_id']}>" if row["record_id"] is not None else None,
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": row.get("target_uri"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Payload-Length": len(payload) if size is None else size,
        "WARC-Refers-To": f"<{row['refers_to']}>" if row.get("refers_to") is not None else None,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = [f"{k}: {' '.join(str(v).splitlines())}" for k, v in values.items() if v is not None]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member that tells its own length, and that of ``data``, in its header."""
    deflate = zlib.compressobj(5, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    if max(size, len(data)) >> 32:  # too long for the sub-field
        plain = zlib.compressobj(5, zlib.DEFLATED, 31)
        return plain.compress(data) + plain.flush()
    head = struct.pack("<4sIBBH2sHII", b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, size, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def _told_length(head: bytes) -> int | None:
    """The length of the member that begins with ``head``, if it tells."""
    if len(head) < 24 or head[:4] != b"\x1f\x8b\x08\x04" or head[10:16] != b"\x0c\x00sl\x08\x00":
        return None
    return struct.unpack("<I", head[16:20])[0]


def file_records(raw: io.BufferedReader, wanted: dict[str, set], payload: bool) -> Iterator[dict]:
    """The records of a file of gzip members; of members that tell their length only the headers are inflated first."""
    at = 0
    while head := raw.read(24):
        size = _told_length(head)
        raw.seek(at)
        if size is None:
            yield from read_records(io.BufferedReader(_Source(raw), 1 << 17), wanted, payload)
            return
        inflate, found, left = zlib.decompressobj(31), b"", size
        while left and b"\r\n\r\n" not in found:
            part = raw.read(min(left, 4096))
            if not part:
                raise ValueError("an archive ends within a record")
            left -= len(part)
            found += inflate.decompress(part)
        row, length = _headers(io.BytesIO(found))
        if all(row[name] in values for name, values in wanted.items()):
            if payload and row["record_type"] != "revisit":
                found += inflate.decompress(raw.read(left))
                block = found.partition(b"\r\n\r\n")[2][:length]
                row["payload"] = block.partition(b"\r\n\r\n")[2]
            yield row
        at += size
        raw.seek(at)


class _Source(io.RawIOBase):
    """Inflated bytes of a file of gzip members, read forward."""

    def __init__(self, raw):
        self._raw, self._inflate = raw, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if self._inflate.eof:
                rest = self._inflate.unused_data
                self._inflate = zlib.decompressobj(31)
            else:
                rest = self._inflate.unconsumed_tail
            rest = rest or self._raw.read(1 << 16)
            if not rest:
                return 0
            if out := self._inflate.decompress(rest, len(into)):
                into[: len(out)] = out
                return len(out)


def _headers(stream) -> tuple[dict, int]:
    """A record's columns but for the payload, and the length of its block; the stream stands at its first line."""
    headers: dict[str, str] = {}
    stream.readline()
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.decode("utf-8").partition(":")
        headers[name.strip()] = value.strip()
    row: dict = {column: headers.get(name) for name, column in _HEADERS.items()}
    for name in ("record_id", "refers_to"):
        row[name] = row[name].strip("<>") if row[name] is not None else None
    row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
    row["payload_bytes"] = int(row["payload_bytes"]) if row["payload_bytes"] is not None else None
    row["payload"] = None
    return row, int(headers.get("Content-Length", 0))


def read_records(stream: io.BufferedReader, wanted: dict[str, set], payload: bool) -> Iterator[dict]:
    """Records of an inflated stream whose headers fit ``wanted``; only their blocks are kept."""
    while head := stream.peek(5):
        if not head.startswith(b"WARC/"):
            stream.readline()
            continue
        row, length = _headers(stream)
        fits = all(row[name] in values for name, values in wanted.items())
        if fits and payload and row["record_type"] != "revisit":
            row["payload"] = stream.read(length).partition(b"\r\n\r\n")[2]
        else:
            while length > 0:
                length -= len(stream.read(min(length, 1 << 16))) or length
        if fits:
            yield row


@dataclass
class _Files(InputPartition):
    paths: Sequence[str]


@dataclass
class _Written(WriterCommitMessage):
    files: Sequence[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names, self.wanted = path, schema.names, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in HEADER_COLUMNS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        files, root = _open_fs(self.path)
        with files.open_input_stream(f"{root}/{MANIFEST}") as f:
            listed = json.loads(f.read())
        slices: list[list[str]] = []
        room = 0
        for entry in sorted(listed, key=lambda x: x["name"]):
            if entry["size"] > room:
                slices.append([])
                room = SLICE_BYTES
            slices[-1].append(f"{root}/{entry['name']}")
            room -= entry["size"]
        return [_Files(s) for s in slices] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        files, _ = _open_fs(self.path)
        for path in partition.paths:
            with files.open_input_file(path) as raw:
                for row in file_records(io.BufferedReader(raw, 1 << 16), self.wanted, "payload" in self.names):
                    yield tuple(row[name] for name in self.names)


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        files, root = _open_fs(self.path)
        files.create_dir(root, recursive=True)
        written: list[tuple[str, int]] = []
        rows = iter(rows)
        row = next(rows, None)
        while row is not None:
            name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
            with files.open_output_stream(f"{root}/{name}", compression=None) as out:
                while row is not None and size < FILE_BYTES:
                    member = gzip_member(record_bytes(row.asDict()))
                    out.write(member)
                    size += len(member)
                    row = next(rows, None)
            written.append((name, size))
        return _Written(written)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _open_fs(self.path)
        files.create_dir(root, recursive=True)
        listed = [{"name": name, "size": size} for m in messages if m for name, size in m.files]
        with files.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _open_fs(self.path)
        for name, _ in (f for m in messages if m for f in m.files):
            files.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        if self.options.get("payload", "true") == "false":
            return SCHEMA.removesuffix(", payload binary")
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options["path"])


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark's own readers take it; tasks take a path without one for a local folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString()


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: str) -> Column:
    """Upper-case base 32 of the SHA-1: five hex digits are four letters. The payload is digested once a row."""
    groups = F.regexp_extract_all(F.sha1(payload), F.lit("(.{5})"), F.lit(1))
    bits = F.transform(groups, lambda g: F.conv(g, 16, 10).cast("int"))

    def four(b: Column) -> Column:
        return F.concat(*(F.substring(F.lit(_BASE32), F.shiftright(b, s).bitwiseAND(31) + 1, 1) for s in (15, 10, 5, 0)))

    return F.array_join(F.transform(bits, four), "")


def deduplicated(pages: DataFrame) -> DataFrame:
    """Rows to write from (page_id, url, html): of equal payloads, the largest page_id is the response.

    Only digests and ids meet by digest. Rows that can't be revisits are
    written where they are read; the others meet the table of revisits by
    page_id and digest, so no task gets the bytes of a popular payload. A null
    page_id is never the largest; rows without any other are all responses.
    """
    keyed = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    keyed = keyed.withColumn("payload_digest", payload_digest("payload"))
    repeated = keyed.groupBy("payload_digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("copies")).where("copies > 1 and holder is not null")
    ids = keyed.select("page_id", "payload_digest").join(repeated.select("payload_digest", "holder"), "payload_digest")
    revisits = materialize(ids.where(~F.col("page_id").eqNullSafe(F.col("holder"))).distinct(), "revisits")

    key = F.xxhash64("page_id", "payload_digest")
    rows = keyed.withColumn("maybe", may_be_among(revisits.select(key.alias("key")), key))
    known = revisits.select(F.col("page_id").alias("known_id"), F.col("payload_digest").alias("known_digest"), "holder")
    same = F.col("page_id").eqNullSafe(F.col("known_id")) & (F.col("payload_digest") == F.col("known_digest"))
    met = rows.where("maybe").join(known.hint("merge"), same, "left").drop("known_id", "known_digest")
    rows = rows.where("not maybe").withColumn("holder", F.lit(None).cast(pages.schema["page_id"].dataType)).unionByName(met)
    revisit = F.col("holder").isNotNull()

    def urn(page):
        return F.concat(F.lit("urn:page:"), page.cast("string"))

    return rows.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        "payload_digest",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.when(revisit, urn(F.col("holder"))).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_of(urn: str) -> Column:
    return F.regexp_extract(urn, r"urn:page:(-?\d+)", 1).try_cast("long")
