"""WARC archives as a PySpark Python data source.

``WarcSource`` (format ``warc``) reads and writes ``.warc.gz`` archives, one
gzip member a record, and reads plain ``.warc`` too. Files are opened through
``pyarrow.fs``, so a path may be in any store that it knows.

Reading plans partitions of whole files, about ``partition_bytes`` each. Filters
on the record type and on other header columns are pushed down: a record's
headers are parsed first, and the payload of a record that they exclude, or
that isn't wanted (option ``payload`` = false and ``verify`` = false), is not
decoded; the member's length in its gzip header (the ``sl`` extra field of the
WARC standard) leads to the next record. Members without that field are
decompressed to find their end, but kept in no memory.

Each write task makes files of about ``file_bytes`` under names of its own,
and the commit lists them in a manifest; readers take only listed files, so
what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from vetrina.llm.text import chunks, small_batches
from vetrina.session import checkpoint_dir

MIN_REVISIT_BYTES = 0
SCHEMA = ("record_type string, record_id string, target_uri string, date string, page_id bigint, refers_to bigint, "
          "payload_digest string, payload_bytes bigint, payload binary")
_ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
                    ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload", pa.binary())])
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = re.compile(r"<urn:page:(-?\d+)>")
_MANIFEST = "_warc-"
_READ = 1 << 20


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


# ---- records

def member(record: bytes, level: int) -> bytes:
    """A gzip member that names its own length."""
    press = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = press.compress(record) + press.flush()
    length = 10 + 2 + 12 + len(body) + 8
    known = length < 1 << 32 and len(record) < 1 << 32
    extra = b"sl" + struct.pack("<HII", 8, length, len(record)) if known else b""
    head = b"\x1f\x8b\x08" + (b"\x04" if known else b"\x00") + b"\0\0\0\0\0\xff" + (struct.pack("<H", len(extra)) + extra if known else b"")
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _line(value: str) -> str:
    """A header value: what would end its line is percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, uri: str | None, kind: str, refers_to: int | None, sha1: str, size: int, payload: bytes, date: str) -> bytes:
    """A response (HTTP headers and payload) or revisit (HTTP headers only)."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>" if page_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_line(uri)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File:
    """Bytes of a file by position, read in large pieces; jumps cost a seek."""

    def __init__(self, store: pafs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        self.size, self.start, self.held = self.file.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not self.start <= at <= at + n <= self.start + len(self.held):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(max(n, _READ))
        return self.held[at - self.start:at - self.start + n]


class _Block:
    """A record's bytes as far as asked for. ``skip`` gives the next record's place."""

    def __init__(self, file: _File, at: int):
        self.file, self.at, self.out, self.length = file, at, bytearray(), None
        self.gzip = file.get(at, 2) == b"\x1f\x8b"
        self.unzip = zlib.decompressobj(31) if self.gzip else None
        if self.gzip and (head := file.get(at, 24))[3] & 4:
            extra = file.get(at + 12, struct.unpack_from("<H", head, 10)[0])
            while len(extra) >= 4:
                size = struct.unpack_from("<H", extra, 2)[0]
                if extra[:2] == b"sl" and size == 8:
                    self.length = struct.unpack_from("<I", extra, 4)[0]
                extra = extra[4 + size:]

    def more(self, n: int) -> bool:
        """Up to n input bytes more; False at the member's or file's end."""
        if self.unzip and self.unzip.eof:
            return False
        piece = self.file.get(self.at, min(n, self.file.size - self.at))
        if not piece:
            return False
        if self.unzip:
            self.out += self.unzip.decompress(piece)
            self.at += len(piece) - len(self.unzip.unused_data)
        else:
            self.out += piece
            self.at += len(piece)
        return True

    def until(self, mark: bytes, start: int) -> int:
        """Position behind ``mark``; an error if the record has none."""
        seen = start
        while (found := self.out.find(mark, seen)) < 0:
            seen = max(start, len(self.out) - len(mark) + 1)
            if not self.more(2048):
                raise ValueError("a WARC record ends within its headers")
        return found + len(mark)

    def bytes(self, start: int, end: int) -> bytes:
        while len(self.out) < end:
            if not self.more(max(2048, end - len(self.out))):
                raise ValueError("a WARC record is shorter than its Content-Length")
        return bytes(self.out[start:end])

    def skip(self, begin: int, end: int) -> int:
        if not self.gzip:
            return begin + end + 4
        if self.length is not None:
            return begin + self.length
        while not self.unzip.eof:
            self.out = bytearray()
            if not self.more(_READ):
                raise ValueError("a gzip member is cut off")
        return self.at


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        out[key.strip().lower()] = value.strip()
    return out


def _page_of(value: str | None) -> int | None:
    m = _PAGE.fullmatch(value or "")
    return int(m[1]) if m else None


def read_file(store: pafs.FileSystem, path: str, wanted: Callable[[dict], bool], payload: bool, verify: bool) -> Iterator[dict]:
    """Rows of the records whose headers ``wanted`` accepts."""
    file, at = _File(store, path), 0
    while at < file.size:
        block = _Block(file, at)
        end = block.until(b"\r\n\r\n", 0)
        head = _headers(bytes(block.out[:end - 4]))
        size = int(head["content-length"])
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        row = {"record_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "target_uri": head.get("warc-target-uri"),
               "date": head.get("warc-date"), "page_id": _page_of(head.get("warc-record-id")), "refers_to": _page_of(head.get("warc-refers-to")),
               "payload_digest": digest, "payload_bytes": size, "payload": None}
        if wanted(row):
            body = end
            if "msgtype=response" in head.get("content-type", "") and size:
                body = block.until(b"\r\n\r\n", end)
                http = _headers(bytes(block.out[end:body - 4]))
                row["payload_bytes"] = int(http.get("content-length", end + size - body))
            if row["record_type"] != "revisit" and (payload or verify):
                data = block.bytes(body, end + size)
                if verify and digest and base64.b32encode(hashlib.sha1(data).digest()).decode() != digest:
                    raise ValueError(f"{path}: record {row['record_id']} doesn't have its digest")
                row["payload_bytes"] = len(data)
                row["payload"] = data if payload else None
            yield row
        at = block.skip(at, end + size)


# ---- the data source

_TESTS = {EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
          LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v,
          StringStartsWith: lambda x, v: x.startswith(v)}
_HEADER_COLUMNS = frozenset(["record_type", "record_id", "target_uri", "date", "page_id", "refers_to", "payload_digest"])


def _test(f: Filter) -> Callable[[dict], bool] | None:
    """A check of header columns, or None for what Spark must filter itself."""
    column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if column not in _HEADER_COLUMNS:
        return None
    if isinstance(f, IsNotNull):
        return lambda row: row[column] is not None
    if isinstance(f, IsNull):
        return lambda row: row[column] is None
    test = _TESTS.get(type(f))
    return test and (lambda row: row[column] is not None and test(row[column], f.value))


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "true").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if _test(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, path = _store(self.path)
        found = {x.path: x.size for x in store.get_file_info(pafs.FileSelector(path, recursive=True)) if x.type == pafs.FileType.File}
        listed = [p for p in found if p.rpartition("/")[2].startswith(_MANIFEST)]
        if listed:
            names = set()
            for p in listed:
                with store.open_input_stream(p) as f:
                    names |= {f"{path.rstrip('/')}/{x}" for x in json.loads(f.read())}
        else:
            names = {p for p in found if p.endswith((".warc", ".warc.gz"))}
        out, held = [Files([])], 0
        for p in sorted(names):
            if out[-1].paths and held + found[p] > self.partition_bytes:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(p)
            held += found[p]
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        tests = [_test(f) for f in self.filters]
        rows, held = [], 0
        for path in partition.paths:
            for row in read_file(store, path, lambda x: all(t(x) for t in tests), self.payload, self.verify):
                rows.append(row)
                held += len(row["payload"] or b"") + 200
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows need page_id, url, record_type, refers_to, sha1 (hex), payload_bytes and payload (text)."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.level = int(options.get("level", 3))
        self.file_bytes = int(options.get("file_bytes", 256 << 20))
        self.date = options.get("date", "2000-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        names, out, held = [], None, 0
        try:
            for batch in chunks(iterator, "payload"):
                for x in batch.to_pylist():
                    if out is None:
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, held = store.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                    data = member(record(x["page_id"], x["url"], x["record_type"], x["refers_to"], x["sha1"], x["payload_bytes"],
                                         (x["payload"] or "").encode("utf-8", "surrogatepass"), self.date), self.level)
                    out.write(data)
                    held += len(data)
                    if held >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{_MANIFEST}{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = _store(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{path}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


# ---- pages

def records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """A record per row of ``pages(page_id, url, html)``, as ``WarcWriter``
    takes them. Of records with equal payloads of ``min_bytes`` or more, those
    with the smallest page_id are responses, others revisit it; smaller ones
    are responses. A null html is an empty payload. Among equal payloads a
    null page_id comes after all others; if all are null, all are responses.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    first = rows.groupBy(F.col("sha1").alias("same")).agg(F.min("page_id").alias("first"))
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, F.col("sha1") == F.col("same")).select(
        F.col("page_id").cast("bigint"), "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first").cast("bigint")).alias("refers_to"), "sha1", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"))


def register(spark: SparkSession) -> None:
    """Makes format ``warc`` known to the session, with filters pushed down."""
    small_batches(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write(rows: DataFrame, path: str, **options: str) -> None:
    register(rows.sparkSession)
    rows.write.format("warc").options(**options).mode("append").save(path)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Rows of all archives below ``path``; see ``SCHEMA``."""
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    found = read(spark, path, payload="false").where(F.col("record_type").isin("response", "revisit"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
