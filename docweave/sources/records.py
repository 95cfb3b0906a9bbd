"""Blobs of fixed-size little-endian records as a Spark data source: format ``records``.

A blob has no header; ``layout`` says what a record holds, ``name:type`` or
``name:type*count`` joined by commas, with types i2 i4 i8 f4 f8. A path is a file or
a folder of blobs. A read is cut into ranges of records of about ``partitionBytes``, and a
task reads its range only. Every blob's length must be a whole number of records, and with ``records`` given
all together exactly that many. Files are opened through Arrow's file systems, so
any store that they know works.

    spark.dataSource.register(RecordSource)
    spark.read.format("records").option("layout", "id:i8,v:f4*64").load(path)
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

TYPES = {"i2": (pa.int16(), T.ShortType()), "i4": (pa.int32(), T.IntegerType()), "i8": (pa.int64(), T.LongType()), "f4": (pa.float32(), T.FloatType()), "f8": (pa.float64(), T.DoubleType())}
SUFFIX = ".blob"
#: Bytes of a range by default, and records in an Arrow batch.
RANGE_BYTES, BATCH = 32 << 20, 1 << 14


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    count: int | None  # None: a plain value

    @property
    def width(self) -> int:
        return int(self.kind[1]) * (1 if self.count is None else self.count)


def layout_of(text: str | None) -> list[Field]:
    fields = []
    for part in (text or "").split(","):
        m = re.fullmatch(r"\s*(\w+):(i2|i4|i8|f4|f8)(?:\*([1-9][0-9]*))?\s*", part)
        if not m:
            raise ValueError(f"layout: {part!r} isn't name:type or name:type*count")
        fields.append(Field(m[1], m[2], int(m[3]) if m[3] else None))
    if len({f.name.lower() for f in fields}) != len(fields):
        raise ValueError("layout: names repeat")
    return fields


def _numpy(fields: list[Field]) -> np.dtype:
    return np.dtype([(f.name, f"<{f.kind}", () if f.count is None else (f.count,)) for f in fields])


def _arrow(fields: list[Field]) -> pa.Schema:
    return pa.schema([(f.name, TYPES[f.kind][0] if f.count is None else pa.list_(TYPES[f.kind][0])) for f in fields])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    path: str
    first: int
    count: int


class RecordReader(DataSourceReader):
    def __init__(self, fields: list[Field], options: dict) -> None:
        self.fields, self.path = fields, options["path"]
        self.range_bytes, self.records = int(options.get("partitionBytes", RANGE_BYTES)), options.get("records")
        self.size = sum(f.width for f in fields)

    def partitions(self) -> list[Range]:
        store, path = _store(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else sorted((f for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and f.path.endswith(SUFFIX)), key=lambda f: f.path)
        odd = [f.path for f in files if f.size % self.size]
        if odd:
            raise ValueError(f"{odd[0]} isn't a whole number of records of {self.size} bytes")
        total = sum(f.size for f in files) // self.size
        if self.records is not None and total != int(self.records):
            raise ValueError(f"{self.path} must hold exactly {int(self.records)} records; it holds {total}")
        step = max(1, self.range_bytes // self.size)
        return [Range(f.path, k, min(step, f.size // self.size - k)) for f in files for k in range(0, f.size // self.size, step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        kind, schema = _numpy(self.fields), _arrow(self.fields)
        with store.open_input_file(partition.path) as f:
            f.seek(partition.first * self.size)
            for at in range(0, partition.count, BATCH):
                n = min(BATCH, partition.count - at)
                rows = np.frombuffer(f.read(n * self.size), kind)
                if len(rows) != n:
                    raise ValueError(f"{partition.path} was cut short while it was read")
                columns = []
                for field in self.fields:
                    flat = pa.array(np.ascontiguousarray(rows[field.name]).reshape(-1))
                    columns.append(flat if field.count is None else pa.ListArray.from_arrays(pa.array(np.arange(0, n * field.count + 1, field.count, dtype=np.int32)), flat))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class RecordWriter(DataSourceArrowWriter):
    """A blob for each task, under a name that counts only once the job commits; what failed tasks left has another suffix."""

    def __init__(self, fields: list[Field], options: dict, overwrite: bool) -> None:
        self.fields, self.path, self.overwrite, self.job = fields, options["path"], overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, path = _store(self.path)
        kind, name = _numpy(self.fields), None
        store.create_dir(path, recursive=True)
        out = None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    name = f"{path}/part-{self.job}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(f"{name}.part")
                rows = np.empty(batch.num_rows, kind)
                for field in self.fields:
                    column = batch.column(batch.schema.get_field_index(field.name))
                    flat = column if field.count is None else column.flatten()
                    if column.null_count or flat.null_count or (field.count is not None and set(np.diff(column.offsets.to_numpy()).tolist()) - {field.count}):
                        raise ValueError(f"{field.name}: a record has no place for nulls or for other than {field.count or 1} values")
                    rows[field.name] = flat.to_numpy(zero_copy_only=False).reshape((-1,) if field.count is None else (-1, field.count))
                out.write(rows.tobytes())
        finally:
            if out is not None:
                out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        old = [f.path for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.is_file and f.path.endswith(SUFFIX)] if self.overwrite else []
        for m in messages:
            if m is not None and m.path is not None:
                store.move(f"{m.path}.part", m.path + SUFFIX)
        for f in old:
            store.delete_file(f)

    def abort(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.is_file and f.path.endswith(".part") and self.job in f.path:
                store.delete_file(f.path)


class RecordSource(DataSource):
    """Format ``records``."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, TYPES[f.kind][1] if f.count is None else T.ArrayType(TYPES[f.kind][1])) for f in layout_of(self.options.get("layout"))])

    def reader(self, schema: T.StructType) -> RecordReader:
        return RecordReader(layout_of(self.options.get("layout")), self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(layout_of(self.options.get("layout")), self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)
