"""Folders of columns: one raw array for each column and part, read by ranges of rows and only as far as columns are wanted.

Layout: ``manifest.json`` holds ``columns``, name to type (``TYPES``), and ``parts``, a list of name and rows in order. The values
of column c of part p are the file ``p.c``: little-endian, one after the other, without a header or nulls. A row's place is its
number over all parts in the manifest's order. Files that the manifest does not name do not count, so a task that ran twice
or a write that broke off leaves nothing that is read. Paths are those of pyarrow's file systems (local, file://, hdfs://, s3:// ..).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST = "manifest.json"
TYPES = {"int32": T.IntegerType(), "int64": T.LongType(), "float32": T.FloatType(), "float64": T.DoubleType()}
ROWS = 4_000_000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def manifest(path: str) -> dict:
    files, root = _opened(path)
    with files.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def is_folder(path: str) -> bool:
    """Whether a path that pyarrow can look at holds a manifest."""
    try:
        files, root = _opened(path)
        return files.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File
    except (pa.ArrowException, OSError):
        return False


@dataclass
class Rows(InputPartition):
    """A range of rows of one part; ``place`` is the number of the first."""

    part: str
    start: int
    rows: int
    place: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, rows: int, position: str | None):
        self.path, self.rows, self.position = path, rows, position
        self.names = [f.name for f in schema]
        found = manifest(path)
        self.types, self.parts = found["columns"], found["parts"]
        missing = [n for n in self.names if n != position and n not in self.types]
        if missing:
            raise ValueError(f"{path} has no column {', '.join(missing)}")
        self.schema = pa.schema([(f.name, pa.int64() if f.name == position else pa.from_numpy_dtype(self.types[f.name])) for f in schema])

    def partitions(self) -> Sequence[InputPartition]:
        out, place = [], 0
        for p in self.parts:
            out += [Rows(p["name"], s, min(self.rows, p["rows"] - s), place + s) for s in range(0, p["rows"], self.rows)]
            place += p["rows"]
        return out or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        files, root = _opened(self.path)
        step = 1 << 16
        opened = {n: files.open_input_file(f"{root}/{partition.part}.{n}") for n in self.names if n != self.position} if partition.rows else {}
        try:
            for s in range(0, partition.rows, step):
                n = min(step, partition.rows - s)
                columns = []
                for name in self.names:
                    if name == self.position:
                        columns.append(pa.array(np.arange(partition.place + s, partition.place + s + n)))
                        continue
                    kind = np.dtype(self.types[name]).newbyteorder("<")
                    data = opened[name].read_at(n * kind.itemsize, (partition.start + s) * kind.itemsize)
                    if len(data) != n * kind.itemsize:
                        raise ValueError(f"{partition.part}.{name} ends before row {partition.start + s + n}")
                    columns.append(pa.array(np.frombuffer(data, kind)))
                yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
        finally:
            for f in opened.values():
                f.close()


@dataclass
class _Part(WriterCommitMessage):
    number: int
    name: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType):
        self.path = path
        kinds = {v.simpleString(): k for k, v in TYPES.items()}
        bad = [f.name for f in schema if f.dataType.simpleString() not in kinds]
        if bad:
            raise ValueError(f"no raw array for the types of {', '.join(bad)}")
        self.types = {f.name: kinds[f.dataType.simpleString()] for f in schema}
        files, root = _opened(path)
        files.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        number = TaskContext.get().partitionId()
        name, rows = f"part-{number:05d}-{uuid.uuid4().hex[:8]}", 0
        files, root = _opened(self.path)
        opened = {n: files.open_output_stream(f"{root}/{name}.{n}") for n in self.types}
        try:
            for batch in iterator:
                rows += batch.num_rows
                for i, (n, kind) in enumerate(self.types.items()):
                    column = batch.column(i)
                    if column.null_count:
                        raise ValueError(f"column {n} holds nulls")
                    opened[n].write(np.asarray(column).astype(np.dtype(kind).newbyteorder("<")).tobytes())
        finally:
            for f in opened.values():
                f.close()
        return _Part(number, name, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = [{"name": m.name, "rows": m.rows} for m in sorted((m for m in messages if m), key=lambda m: m.number) if m.rows]
        files, root = _opened(self.path)
        with files.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps({"columns": self.types, "parts": parts}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Without a manifest nothing of it is read."""


class ColumnFolder(DataSource):
    """``spark.read.format("column_folder")``; options ``rows`` (of a task) and ``position`` (a column with each row's place)."""

    @classmethod
    def name(cls) -> str:
        return "column_folder"

    def schema(self) -> T.StructType:
        found = [T.StructField(n, TYPES[k], False) for n, k in manifest(self.options["path"])["columns"].items()]
        position = self.options.get("position")
        return T.StructType([*([T.StructField(position, T.LongType(), False)] if position else []), *found])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, int(self.options.get("rows", ROWS)), self.options.get("position"))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if is_folder(self.options["path"]):
            raise ValueError(f"{self.options['path']} exists")
        return _Writer(self.options["path"], schema)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str] | None = None, position: str | None = None, rows: int = ROWS) -> DataFrame:
    """The wanted columns of a folder, all if none are named, with each row's place in ``position``. Files of others stay closed."""
    spark.dataSource.register(ColumnFolder)
    types = manifest(path)["columns"]
    wanted = list(types) if columns is None else list(columns)
    missing = [c for c in wanted if c not in types]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    schema = T.StructType([*([T.StructField(position, T.LongType(), False)] if position else []), *[T.StructField(c, TYPES[types[c]], False) for c in wanted]])
    reader = spark.read.format("column_folder").schema(schema).option("rows", rows)
    return (reader.option("position", position) if position else reader).load(path)


def write_columns(df: DataFrame, path: str, order: str, rows_per_part: int = ROWS) -> None:
    """Writes a table as a folder in the order of a column, which is not written itself: a row's place stands for it."""
    df.sparkSession.dataSource.register(ColumnFolder)
    parts = max(1, -(-df.count() // rows_per_part))
    df.repartitionByRange(parts, order).sortWithinPartitions(order).drop(order).write.format("column_folder").mode("append").save(path)


def read_library(spark: SparkSession, path: str, columns: Sequence[str] = ("mz", "score", "intensity")) -> DataFrame:
    """A library with ``fragment_idx``: a folder of columns, of which only ``columns`` are read, or a Parquet table."""
    if is_folder(path):
        return read_columns(spark, path, columns, "fragment_idx")
    return spark.read.parquet(path).select("fragment_idx", *columns)
