"""WARC archives as a Python data source, written and read by Spark."""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from .common import fresh_path, small_batches, table, valid

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, "
    "refers_to string, payload_length long, payload binary"
)
#: The header that holds each column. Fixed values.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_length": "X-Payload-Length",
}
MANIFEST = "_manifest.json"
#: A file is closed once it is so long, so that files are the partitions of a later read.
FILE_BYTES = 64 << 20
#: Bytes of payload in one Arrow batch of a read, and of a file in one request.
BATCH_BYTES = 8 << 20
CHUNK = 1 << 16


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _safe(value: object) -> str:
    """A header's value in one line."""
    return " ".join(str(value).split())


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member with its own length in the 'sl' field of the header, so that a reader can skip it unread."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    whole = 10 + 2 + 12 + len(body) + len(tail)
    if whole >= 1 << 32 or len(data) >= 1 << 32:
        return b"\x1f\x8b\x08\x00" + bytes(5) + b"\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, whole, len(data))
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def record(row: dict) -> bytes:
    """One record: a response carries an HTTP head and its payload, a revisit none."""
    kind, payload = row["record_type"], row["payload"] or b""
    block = b""
    if kind == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    elif kind != "revisit":
        block = payload
    head = ["WARC/1.1"] + [f"{name}: {_safe(row[column])}" for column, name in HEADERS.items() if column != "payload_digest" and row[column] is not None]
    if row["payload_digest"]:
        head.append(f"{HEADERS['payload_digest']}: sha1:{base64.b32encode(bytes.fromhex(row['payload_digest'])).decode()}")
    if kind in ("response", "revisit"):
        head.append("Content-Type: application/http; msgtype=response")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Files(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own; only those named in the manifest, written at the end, belong to the archive."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        fs, base = _open(self.path)
        fs.create_dir(base, recursive=True)
        done: list[tuple[str, int]] = []
        out, name, size = None, "", 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                size += out.write(data := member(record(row))) or len(data)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((name, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size))
        return Files(done)

    def commit(self, messages: list[Files | None]) -> None:
        fs, base = _open(self.path)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{MANIFEST}") as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())

    def abort(self, messages: list[Files | None]) -> None:
        fs, base = _open(self.path)
        for name in (name for m in messages if m for name, _ in m.files):
            fs.delete_file(f"{base}/{name}")


class Source:
    """Bytes of a file from one place on, read in chunks."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.held = file, b""

    def need(self, n: int) -> bytes:
        """n bytes without taking them, fewer at the end of the file."""
        while len(self.held) < n:
            more = self.file.read(max(CHUNK, n - len(self.held)))
            if not more:
                break
            self.held += more
        return self.held[:n]

    def take(self, n: int) -> bytes:
        out = self.need(n)
        self.held = self.held[n:]
        return out

    def skip(self, n: int) -> None:
        if n <= len(self.held):
            self.held = self.held[n:]
        else:
            self.file.seek(n - len(self.held), 1)
            self.held = b""


class Member:
    """The uncompressed bytes of one gzip member, decoded no further than asked for."""

    def __init__(self, source: Source):
        self.source, self.length, self.used, self.held = source, None, 0, b""
        head = source.need(24)
        if len(head) >= 24 and head[3] & 4 and head[12:14] == b"sl":
            self.length = struct.unpack("<I", head[16:20])[0]
        self.inflate = zlib.decompressobj(31)

    def need(self, n: int) -> bytes:
        while len(self.held) < n and not self.inflate.eof:
            raw = self.inflate.unconsumed_tail
            if not raw:
                left = CHUNK if self.length is None else min(CHUNK, self.length - self.used)
                raw = self.source.take(left) if left > 0 else b""
                if not raw:
                    raise ValueError("the archive ends within a record")
                self.used += len(raw)
            self.held += self.inflate.decompress(raw, max(CHUNK, n - len(self.held)))
        return self.held[:n]

    def take(self, n: int) -> bytes:
        out = self.need(n)
        self.held = self.held[n:]
        return out

    def skip(self, n: int) -> None:
        while n > 0 and (piece := self.take(min(n, CHUNK))):
            n -= len(piece)

    def close(self) -> None:
        """Go to the end of the member, without decoding where its length is known."""
        if self.length is not None:
            self.source.skip(self.length - self.used)
            return
        while not self.inflate.eof:
            self.held = b""
            self.need(1)
        self.source.held = self.inflate.unused_data + self.source.held


def headers(source: Source | Member) -> dict[str, str] | None:
    """The header lines of the next record, by lower-case name; None at the end."""
    size = 512
    while True:
        got = source.need(size)
        skipped = len(got) - len(got.lstrip(b"\r\n"))
        end = got.find(b"\r\n\r\n", skipped)
        if end >= 0:
            lines = source.take(end + 4)[skipped:-4].decode("utf-8", "replace").split("\r\n")
            return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if len(got) < size:
            if got.strip(b"\r\n"):
                raise ValueError("the archive ends within a header")
            source.take(len(got))  # the blank lines after the last record
            return None
        size *= 2


def _hex(digest: str) -> str:
    kind, _, value = digest.partition(":")
    return base64.b32decode(value).hex() if kind == "sha1" and len(value) == 32 else value or kind


def from_headers(h: dict[str, str]) -> dict:
    row = {column: h.get(name.lower()) for column, name in HEADERS.items()}
    row["payload_digest"] = _hex(row["payload_digest"]) if row["payload_digest"] else None
    row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
    return row


def read_records(file: pa.NativeFile, wanted: Callable[[dict], bool], payload: bool) -> Iterator[dict]:
    """The records whose headers are wanted; the blocks of others are passed over, and payloads are decoded only if asked for."""
    source = Source(file)
    packed = source.need(2) == b"\x1f\x8b"
    while source.need(1):
        part: Source | Member = Member(source) if packed else source
        while (h := headers(part)) is not None:
            length = int(h.get("content-length", 0))
            row = from_headers(h)
            if use := wanted(row):
                row["payload"] = None
                if payload and length:
                    block = part.take(length)
                    # An HTTP message's payload begins after its own head.
                    row["payload"] = block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").startswith("application/http") else block
                elif payload and row["record_type"] != "revisit":
                    row["payload"] = b""
                yield row
            if packed and isinstance(part, Member) and part.length is not None:
                break  # a member is a record; its rest need not be decoded
            if not (use and payload):
                part.skip(length)
        if isinstance(part, Member):
            part.close()


@dataclass
class FilePartition(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    """A partition per file. Equality, IN and prefix predicates on header columns are tested before a payload is decoded."""

    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, EqualTo | EqualNullSafe):
                self.tests.append((column, "in", [f.value]))
            elif isinstance(f, In):
                self.tests.append((column, "in", list(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "prefix", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "some", None))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        return all(
            value in given if how == "in" else value is not None and (how == "some" or str(value).startswith(given))
            for column, how, given in self.tests
            for value in (row[column],)
        )

    def partitions(self) -> Sequence[InputPartition]:
        fs, base = _open(self.path)
        if fs.get_file_info(base).type == pafs.FileType.File:
            return [FilePartition(self.path)]
        if fs.get_file_info(f"{base}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
                names = [name for name, _ in json.loads(f.read())]
        else:
            names = [x.base_name for x in fs.get_file_info(pafs.FileSelector(base)) if x.base_name.endswith((".warc", ".warc.gz"))]
        return [FilePartition(f"{self.path}/{name}") for name in sorted(names)] or [FilePartition("")]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in SCHEMA.split(", ")])
        if not partition.path:
            yield pa.RecordBatch.from_pylist([], schema)
            return
        fs, path = _open(partition.path)
        with fs.open_input_file(path) as file:
            rows, size = [], 0
            for row in read_records(file, self.wanted, self.payload):
                rows.append({"payload": None} | row)
                size += 1000 + len(rows[-1]["payload"] or b"")
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcDataSource(DataSource):
    """format("warc"). Options: path, and payload=false to read headers only."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"].rstrip("/"), self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"].rstrip("/"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write rows of SCHEMA as an archive; the folder should be new."""
    small_batches(records.sparkSession)
    records.sparkSession.dataSource.register(WarcDataSource)
    records.select(*(x.split()[0] for x in SCHEMA.split(", "))).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive (or of a single file, from any writer), rows of SCHEMA."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


#: Payloads shorter than this are stored again rather than referred to.
LEAST_REVISIT = 1000


def page_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Rows of SCHEMA for pages (page_id, url, html).

    Of pages with equal payloads of at least `least` bytes the largest page_id is the
    response, and the others revisit it; a row that repeats that page_id is a response
    as well, a null page_id a revisit. Null html is an empty payload. Only digests
    are grouped and joined, so a payload that very many pages have costs no more than
    any other.
    """
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), valid("url").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    d = d.withColumns({"digest": F.sha1("payload"), "length": F.octet_length("payload").cast("long")})
    groups = d.where(F.col("length") >= least).groupBy("digest", "length").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null")
    revisits = d.select("page_id", "digest", "length").join(groups.drop("n"), ["digest", "length"]).where(~F.col("page_id").eqNullSafe(F.col("keeper")))
    revisits = revisits.select(F.col("page_id").alias("p"), F.col("digest").alias("h"), "keeper").distinct()
    all_ = d.join(revisits, d.page_id.eqNullSafe(revisits.p) & (d.digest == revisits.h), "left")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return all_.select(
        name(F.col("page_id")).alias("record_id"),
        F.when(F.col("keeper").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.col("digest").alias("payload_digest"),
        F.when(F.col("keeper").isNotNull(), name(F.col("keeper"))).alias("refers_to"),
        F.col("length").alias("payload_length"),
        F.when(F.col("keeper").isNull(), F.col("payload")).alias("payload"),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "pages-warc")
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    back = read_warc(spark, path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(.*)>', 1) as bigint)")
    response = F.col("record_type") == "response"
    return back.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(~response, number("refers_to")).alias("refers_to"),
    )


#: The pages whose html others repeat, by the contract alone.
OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n < {LEAST_REVISIT} OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n >= {LEAST_REVISIT} AND page_id <> keeper THEN keeper END AS refers_to
FROM k
"""
