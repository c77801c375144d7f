"""WARC archives as a PySpark data source.

``warc`` reads and writes folders of ``.warc`` and ``.warc.gz`` files in any file system that
Arrow can open by URI. Written files have one gzip member a record, with the member's length in
the gzip header (the ``sl`` extra field), so that a reader can step over a record.

Reading plans one partition for a run of small files or one large file. Filters on the record
type and on other header columns are pushed down. Of each record the headers are parsed
first; the payload of a record that no filter wants, or any payload if ``payload`` is
``false``, is neither inflated nor decoded where the member's length is known.

Tasks write to names of their own and the manifest names only the files of tasks that the
driver accepted, so that retried and speculative tasks leave no records twice.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

FORMAT = "warc"
MANIFEST = "_manifest.json"
#: What is read; ``payload_length`` is that of the full payload, for revisits too.
READ_SCHEMA = (
    "record_id string, warc_type string, target_uri string, date string, payload_digest string, "
    "refers_to string, payload_length long, payload binary"
)
#: What is written, by name.
WRITE_COLUMNS = ("record_id", "warc_type", "target_uri", "payload_digest", "refers_to", "payload")
#: Header fields of the columns.
FIELDS = {
    "record_id": "WARC-Record-ID",
    "warc_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"
#: Bytes of a file before the next one is begun, of files that share a partition, of
#: payloads in one record batch, and of a read.
FILE_BYTES, PARTITION_BYTES, BATCH_BYTES, READ_BYTES = 64 << 20, 32 << 20, 8 << 20, 1 << 20
GZIP_HEAD = struct.Struct("<4BIBBH2sHI")


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of a binary or string column in upper-case base 32."""
    digest = F.sha1(data)
    fives = [F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


# Records


def _header_value(value: str) -> str:
    """As it can stand on a header line: control and other non-URI characters escaped."""
    return quote(value, safe="%/:?#[]@!$&'()*+,;=~-._<>")


def build_record(row: dict, date: str) -> bytes:
    """One record. A revisit holds the HTTP headers only, with the full payload's length."""
    payload = row["payload"] or b""
    revisit = row["warc_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1"]
    for column, name in FIELDS.items():
        value = date if column == "date" else row.get(column)
        if value is not None:
            lines.append(f"{name}: {_header_value(value)}")
    if revisit:
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines += [f"Content-Type: {HTTP_TYPE}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose header tells its own length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return GZIP_HEAD.pack(0x1F, 0x8B, 8, 4, 0, 0, 255, 8, b"sl", 4, GZIP_HEAD.size + len(body)) + body


def _headers(text: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines are joined."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", text).decode("utf-8", "replace").splitlines()
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if v}


class _Input:
    """Bytes of a file ahead of a position, read in blocks."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.buffer, self.at = file, b"", 0

    def peek(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n:
            more = self.file.read(max(READ_BYTES, n))
            if not more:
                break
            self.buffer = self.buffer[self.at :] + more
            self.at = 0
        return self.buffer[self.at : self.at + n]

    def skip(self, n: int) -> None:
        ahead = len(self.buffer) - self.at
        if n <= ahead:
            self.at += n
        else:
            self.file.seek(self.file.tell() + n - ahead)
            self.buffer, self.at = b"", 0


class _Plain:
    """The bytes of one record in an uncompressed file."""

    def __init__(self, source: _Input):
        self.source, self.used = source, 0

    def upto(self, n: int) -> bytes:
        return self.source.peek(n)

    def end(self, length: int) -> None:
        self.source.skip(length)
        while self.source.peek(1) in (b"\r", b"\n"):
            self.source.skip(1)


class _Member:
    """The bytes of one record that is a gzip member, inflated as far as asked for."""

    def __init__(self, source: _Input):
        self.source, self.data = source, b""
        head = source.peek(GZIP_HEAD.size)
        told = len(head) == GZIP_HEAD.size and head[3] & 4 and head[12:14] == b"sl"
        self.length = GZIP_HEAD.unpack(head)[-1] if told else None
        self.inflate, self.taken = zlib.decompressobj(31), 0

    def upto(self, n: int) -> bytes:
        while len(self.data) < n and not self.inflate.eof:
            block = self.inflate.unconsumed_tail
            if not block:
                block = self.source.peek(1 << 16 if self.length is None else min(1 << 16, self.length - self.taken))
                self.source.skip(len(block))
                self.taken += len(block)
            if not block:
                raise ValueError("a gzip member ends too soon")
            self.data += self.inflate.decompress(block, n - len(self.data))
        return self.data[:n]

    def end(self, length: int) -> None:
        if self.length is not None:
            self.source.skip(self.length - self.taken)
            return
        while not self.inflate.eof:
            self.data = b""
            self.upto(READ_BYTES)
        self.source.at -= len(self.inflate.unused_data)  # what was read of the next member


def _http_split(block: bytes) -> tuple[int, dict[str, str]] | None:
    found = re.search(rb"\r?\n\r?\n", block)
    return (found.end(), _headers(block[: found.start()])) if found else None


@dataclass
class _Wanted:
    """Pushed filters: per header column, the accepted values and prefixes."""

    values: dict[str, list[set]]
    prefixes: dict[str, list[str]]
    present: set[str]

    def __call__(self, row: dict) -> bool:
        return (
            all(row[k] in x for k, sets in self.values.items() for x in sets)
            and all(row[k] is not None and row[k].startswith(x) for k, xs in self.prefixes.items() for x in xs)
            and all(row[k] is not None for k in self.present)
        )


def read_records(file: pa.NativeFile, compressed: bool, wanted, payload: bool) -> Iterator[dict]:
    """The wanted records of one file; headers first, then the payload if it is asked for."""
    source = _Input(file)
    while source.peek(1):
        record = _Member(source) if compressed else _Plain(source)
        size = 1 << 11
        while (end := (head := record.upto(size)).find(b"\r\n\r\n")) < 0:
            if len(head) < size:
                raise ValueError("a WARC record has no end of headers")
            size *= 2
        end += 4
        fields = _headers(head[:end])
        length = int(fields.get("content-length", 0))
        row = {k: fields.get(name.lower()) for k, name in FIELDS.items()}
        if wanted(row):
            row["payload"], row["payload_length"] = None, length
            at, http = end, None
            if fields.get("content-type", "").startswith("application/http"):
                size = min(length, 1 << 11)
                while (http := _http_split(record.upto(end + size)[end:])) is None and size < length:
                    size = min(length, size * 2)
                if http:
                    at += http[0]
                    row["payload_length"] = length - http[0]
            if row["warc_type"] == "revisit":
                told = http[1].get("content-length") if http else None
                row["payload_length"] = int(told) if told and told.isdigit() else None
            elif payload:
                row["payload"] = record.upto(end + length)[at:]
            yield row
        record.end(end + length)


# The data source


@dataclass
class WarcPartition(InputPartition):
    files: list[str]

    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.payload = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.wanted = _Wanted({}, {}, set())

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for x in filters:
            name = x.attribute[0] if len(getattr(x, "attribute", ())) == 1 else None
            if name not in FIELDS:
                yield x
            elif isinstance(x, EqualTo):
                self.wanted.values.setdefault(name, []).append({x.value})
            elif isinstance(x, In):
                self.wanted.values.setdefault(name, []).append(set(x.value))
            elif isinstance(x, StringStartsWith):
                self.wanted.prefixes.setdefault(name, []).append(x.value)
            elif isinstance(x, IsNotNull):
                self.wanted.present.add(name)
            else:
                yield x

    def _files(self) -> list[tuple[str, int]]:
        store, root = _open_store(self.path)
        manifest = f"{root.rstrip('/')}/{MANIFEST}"
        if store.get_file_info(manifest).type == fs.FileType.File:
            with store.open_input_stream(manifest) as f:
                return [(f"{root.rstrip('/')}/{x['name']}", x["bytes"]) for x in json.loads(f.read())]
        if store.get_file_info(root).type == fs.FileType.File:
            return [(root, store.get_file_info(root).size)]
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [(x.path, x.size) for x in found if re.search(r"\.warc(\.gz)?$", x.path)]

    def partitions(self) -> list[InputPartition]:
        runs, room = [], 0
        for path, size in sorted(self._files()):
            if size > room or not runs:
                runs.append([])
                room = self.partition_bytes
            runs[-1].append(path)
            room -= size
        return [WarcPartition(x) for x in runs] or [WarcPartition([])]

    def read(self, partition: WarcPartition) -> Iterator[pa.RecordBatch]:
        kinds = {"payload": pa.binary(), "payload_length": pa.int64()}
        names = self.schema.names
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch({k: pa.array([x[k] for x in held], kinds.get(k, pa.string())) for k in names})

        store, _ = _open_store(self.path)
        for path in partition.files:
            with store.open_input_file(path) as file:
                for row in read_records(file, path.endswith(".gz"), self.wanted, self.payload):
                    held.append(row)
                    size += len(row["payload"] or b"") + 512
                    if size >= BATCH_BYTES:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()


@dataclass
class WarcCommit(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.date = options.get("date", "2024-01-01T00:00:00Z")
        self.file_bytes = int(options.get("filebytes", options.get("fileBytes", FILE_BYTES)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WarcCommit:
        store, root = _open_store(self.path)
        store.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.select(list(WRITE_COLUMNS)).to_pylist():
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, size = store.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None), 0
                member = gzip_member(build_record(row, self.date))
                out.write(member)
                size += len(member)
                if size >= self.file_bytes:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return WarcCommit(files)

    def commit(self, messages: list[WarcCommit | None]) -> None:
        store, root = _open_store(self.path)
        store.create_dir(root, recursive=True)
        manifest = f"{root.rstrip('/')}/{MANIFEST}"
        files = []
        if store.get_file_info(manifest).type == fs.FileType.File:  # appended to
            with store.open_input_stream(manifest) as f:
                files = json.loads(f.read())
        files += [{"name": a, "bytes": b} for x in messages if x for a, b in x.files]
        with store.open_output_stream(manifest) as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages: list[WarcCommit | None]) -> None:
        store, root = _open_store(self.path)
        for x in messages:
            for name, _ in x.files if x else ():
                store.delete_file(f"{root.rstrip('/')}/{name}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc").mode("append")``.

    Options: path; ``payload`` (false: payloads are null), ``partitionBytes``, ``fileBytes``,
    ``date``. Writing takes the columns of WRITE_COLUMNS by name, others are left out.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach it."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
