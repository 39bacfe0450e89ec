"""Fixed-width records in pages, as a Python data source: format("fixedrec").

A page holds as many whole records as fit and is padded with zero bytes. Text is padded
with zero bytes as well, and longer text is an error. A null is written as zero bytes;
zero bytes are read as null in text and dates, and as 0 in numbers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .schema import DATE, STRING, Layout, parse

PAGE = 4096
MANIFEST = "_manifest.json"
#: Pages that one task reads.
PAGES_PER_TASK = 16_384
PAGES_PER_BATCH = 1024


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def encode(batch: pa.RecordBatch, layout: Layout) -> np.ndarray:
    out = np.zeros(batch.num_rows, layout.record)
    for a in layout.attributes:
        column = batch.column(a.name)
        if a.code in (STRING, DATE):
            raw = [b"" if v is None else str(v).encode() for v in column.to_pylist()]
            if longest := max((len(x) for x in raw if len(x) > a.size), default=0):
                raise ValueError(f"{a.name} has room for {a.size} bytes, not {longest}")
            out[a.name] = raw
        else:
            out[a.name] = column.fill_null(0).to_numpy(zero_copy_only=False)
    return out


def decode(records: np.ndarray, layout: Layout) -> pa.RecordBatch:
    columns = []
    for a, field in zip(layout.attributes, layout.struct, strict=True):
        v = records[a.name]
        if a.code == STRING:
            columns.append(pa.array([x.decode("utf-8", "replace") or None for x in v.tolist()], pa.string()))
        elif a.code == DATE:
            columns.append(pa.array([date.fromisoformat(x.decode()) if x else None for x in v.tolist()], pa.date32()))
        else:
            kind = {"int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}[field.dataType.simpleString()]
            columns.append(pa.array(v.astype(kind.to_pandas_dtype()), kind))
    return pa.RecordBatch.from_arrays(columns, [a.name for a in layout.attributes])


@dataclass
class Files(WriterCommitMessage):
    files: list[tuple[str, int]]


class FixedWriter(DataSourceArrowWriter):
    """A file per task; the manifest, written last, names those that count and their records."""

    def __init__(self, path: str, layout: Layout):
        self.path, self.layout = path, layout

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        fs, base = _open(self.path)
        fs.create_dir(base, recursive=True)
        name, rows, size = f"part-{uuid.uuid4().hex}.dat", 0, self.layout.record.itemsize
        per_page, held = PAGE // size, np.zeros(0, self.layout.record)
        if not per_page:
            raise ValueError(f"a record of {size} bytes doesn't fit in a page")
        with fs.open_output_stream(f"{base}/{name}") as out:
            for batch in iterator:
                held = np.concatenate([held, encode(batch, self.layout)])
                rows += batch.num_rows
                full = len(held) // per_page
                self._put(out, held[: full * per_page], per_page)
                held = held[full * per_page :]
            self._put(out, held, per_page)
        return Files([(name, rows)])

    def _put(self, out, records: np.ndarray, per_page: int) -> None:
        pages = -(-len(records) // per_page)
        room = np.zeros(pages * per_page, records.dtype)
        room[: len(records)] = records
        used = per_page * records.dtype.itemsize
        block = np.zeros((pages, PAGE), np.uint8)
        block[:, :used] = room.view(np.uint8).reshape(pages, used)
        out.write(block.tobytes())

    def commit(self, messages: list[Files | None]) -> None:
        fs, base = _open(self.path)
        fs.create_dir(base, recursive=True)
        files = sorted(f for m in messages if m for f in m.files)
        with fs.open_output_stream(f"{base}/{MANIFEST}") as out:
            out.write(json.dumps({"schema": self.layout.text, "files": files}).encode())

    def abort(self, messages: list[Files | None]) -> None:
        fs, base = _open(self.path)
        for name in (name for m in messages if m for name, _ in m.files):
            fs.delete_file(f"{base}/{name}")


@dataclass
class Pages(InputPartition):
    file: str
    first: int
    rows: int


class FixedReader(DataSourceReader):
    def __init__(self, path: str, layout: Layout):
        self.path, self.layout = path, layout

    def partitions(self) -> Sequence[InputPartition]:
        fs, base = _open(self.path)
        with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
            files = json.loads(f.read())["files"]
        step = PAGES_PER_TASK * (PAGE // self.layout.record.itemsize)
        parts = [Pages(name, at // step * PAGES_PER_TASK, min(step, rows - at)) for name, rows in files for at in range(0, rows, step)]
        return parts or [Pages("", 0, 0)]

    def read(self, part: Pages) -> Iterator[pa.RecordBatch]:
        record = self.layout.record
        if not part.rows:
            yield decode(np.zeros(0, record), self.layout)
            return
        fs, base = _open(self.path)
        per_page, left = PAGE // record.itemsize, part.rows
        with fs.open_input_file(f"{base}/{part.file}") as f:
            f.seek(part.first * PAGE)
            while left:
                pages = np.frombuffer(f.read(PAGES_PER_BATCH * PAGE), np.uint8).reshape(-1, PAGE)
                records = np.ascontiguousarray(pages[:, : per_page * record.itemsize]).reshape(-1).view(record)[:left]
                left -= len(records)
                yield decode(records, self.layout)


class FixedRecords(DataSource):
    """Options: path, and schemaText, the text of a schema file (a written folder knows its own)."""

    @classmethod
    def name(cls) -> str:
        return "fixedrec"

    def _layout(self) -> Layout:
        if text := self.options.get("schemaText"):
            return parse(text)
        fs, base = _open(self.options["path"].rstrip("/"))
        with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
            return parse(json.loads(f.read())["schema"])

    def schema(self):
        return self._layout().struct

    def reader(self, schema) -> FixedReader:
        return FixedReader(self.options["path"].rstrip("/"), self._layout())

    def writer(self, schema, overwrite: bool) -> FixedWriter:
        return FixedWriter(self.options["path"].rstrip("/"), self._layout())
