"""Matrix files and flat vector indexes as a Spark data source: `spark.read.format("matrix")` and `df.write.format("matrix")`.

A path is one file or a folder of parts, which follow each other in order of their names. Readers deal ranges of rows to
tasks; a task reads its bytes by offset through the store's own file system, so nothing has to be mounted and nothing is read
whole. Writers put each task's rows into a part under a name of its own; the commit moves the parts that were told to it
to their places and marks the folder, so failed and repeated tasks leave nothing behind.

Stores are those that Arrow opens by URI, or any that the option `filesystem` names, as `module:function`: it takes the
URI and returns an Arrow file system and a path. Stores that only Spark opens are read by Spark (whole parts, under 2 GB each).
"""

from __future__ import annotations

import importlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from chimerant.operators import ranges

# The first four bytes of a flat vector index by metric, the number that stands for the metric, and the length of its header.
FLAT_INDEXES = {b"IxFI": "ip", b"IxF2": "l2"}
METRIC_NUMBERS = {"ip": 0, "l2": 1}
FLAT_HEADER = 45
# Fixed value: a field of a flat index that readers skip.
FLAT_FILLER = 1 << 20
NPY_MARK = b"\x93NUMPY"

SCHEMA = "pos long, vec array<float>"
ROWS_PER_TASK, ROWS_PER_BATCH, ROWS_PER_PART = 65_536, 4_096, 1 << 20
SUFFIXES = {"npy": "npy", "ip": "index", "l2": "index"}


def store_of(uri: str, opener: str | None = None) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    if opener:
        module, function = opener.split(":")
        return getattr(importlib.import_module(module), function)(uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass(frozen=True)
class Header:
    rows: int
    columns: int
    offset: int
    metric: str | None


def header_of(start: bytes, name: str) -> Header:
    """Of a file's first bytes: rows, columns, the place of the first number, and the metric of an index."""
    import io

    if start[:6] == NPY_MARK:
        f = io.BytesIO(start)
        f.seek(6)
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[tuple(f.read(2))]
        shape, by_column, kind = read(f)
        if by_column or kind != np.dtype("<f4") or len(shape) != 2:
            raise ValueError(f"{name}: only rows of little-endian 32-bit floats can be read")
        return Header(*shape, f.tell(), None)
    if start[:4] not in FLAT_INDEXES:
        raise ValueError(f"{name}: neither a .npy matrix nor a flat index")
    columns, rows = int.from_bytes(start[4:8], "little"), int.from_bytes(start[8:16], "little")
    if int.from_bytes(start[FLAT_HEADER - 8 : FLAT_HEADER], "little") != rows * columns:
        raise ValueError(f"{name}: the header's counts don't agree")
    return Header(rows, columns, FLAT_HEADER, FLAT_INDEXES[start[:4]])


def header_bytes(kind: str, rows: int, columns: int) -> bytes:
    """The first bytes of a file of that kind: npy, ip or l2."""
    import io

    if kind == "npy":
        out = io.BytesIO()
        np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (rows, columns)})
        return out.getvalue()
    mark = next(m for m, k in FLAT_INDEXES.items() if k == kind)
    number = lambda x, size: int(x).to_bytes(size, "little")
    return mark + number(columns, 4) + number(rows, 8) + 2 * number(FLAT_FILLER, 8) + number(1, 1) + number(METRIC_NUMBERS[kind], 4) + number(rows * columns, 8)


def parts_of(store: fs.FileSystem, path: str) -> list[str]:
    """The file, or the parts of a folder in order; names that begin with _ or . are no parts."""
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [path]
    found = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", "."))]
    return sorted(found)


def part_header(store: fs.FileSystem, path: str) -> Header:
    with store.open_input_file(path) as f:
        return header_of(f.read(4_096), path)


def vectors_batch(first: int, numbers: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(len(numbers) + 1, dtype=np.int32) * numbers.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(numbers))), pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(numbers).ravel()))], ["pos", "vec"])


class Rows(InputPartition):
    """Rows begin .. end - 1 of a part, the first of which is the row `first` of the whole."""

    def __init__(self, part: str, header: Header, begin: int, end: int, first: int):
        self.part, self.header, self.begin, self.end, self.first = part, header, begin, end, first


class MatrixReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.opener = options["path"], options.get("filesystem")
        self.rows = int(options.get("rowsPerTask", ROWS_PER_TASK))

    def partitions(self) -> list[Rows]:
        store, path = store_of(self.path, self.opener)
        out, first, widths = [], 0, set()
        for part in parts_of(store, path):
            h = part_header(store, part)
            widths |= {h.columns} if h.rows else set()
            if len(widths) > 1:
                raise ValueError(f"{self.path}: parts of different widths")
            out += [Rows(part, h, begin, min(begin + self.rows, h.rows), first + begin) for begin in range(0, h.rows, self.rows)]
            first += h.rows
        return out or [Rows("", Header(0, 0, 0, None), 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.begin == partition.end:
            return
        store, _ = store_of(self.path, self.opener)
        h = partition.header
        with store.open_input_file(partition.part) as f:
            for at in range(partition.begin, partition.end, ROWS_PER_BATCH):
                n = min(ROWS_PER_BATCH, partition.end - at)
                raw = f.read_at(n * h.columns * 4, h.offset + at * h.columns * 4)
                if len(raw) < n * h.columns * 4:
                    raise ValueError(f"{partition.part}: shorter than its header tells")
                yield vectors_batch(partition.first + at - partition.begin, np.frombuffer(raw, "<f4").reshape(n, h.columns))


class Written(WriterCommitMessage):
    def __init__(self, part: str, rows: int, columns: int):
        self.part, self.rows, self.columns = part, rows, columns


class MatrixWriter(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType, overwrite: bool):
        self.uri, self.opener, self.kind = options["path"], options.get("filesystem"), options.get("kind", "npy")
        if self.kind not in SUFFIXES:
            raise ValueError(f"kind is one of {', '.join(SUFFIXES)}")
        self.at, self.overwrite, self.attempt = schema.names.index("vec"), overwrite, f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, path = store_of(self.uri, self.opener)
        rows = columns = 0
        with tempfile.TemporaryFile() as body:  # a task's own scratch, as the header comes first and tells the rows
            for batch in iterator:
                vec = batch.column(self.at)
                if not len(vec):
                    continue
                if vec.null_count or vec.flatten().null_count:
                    raise ValueError("a matrix has no nulls")
                numbers = vec.flatten().to_numpy(zero_copy_only=False).astype("<f4")
                width = len(numbers) // len(vec)
                if (np.diff(vec.offsets.to_numpy()) != (columns or width)).any():
                    raise ValueError("vectors of different widths")
                columns, rows = columns or width, rows + len(vec)
                body.write(numbers.tobytes())
            if not rows:
                return Written("", 0, 0)
            body.seek(0)
            folder = f"{path}/{self.attempt}"
            store.create_dir(folder, recursive=True)
            # The name orders parts; the attempt's id keeps a task that runs twice apart from itself.
            part = f"{folder}/part-{task.partitionId():08d}-{task.taskAttemptId()}.{SUFFIXES[self.kind]}"
            with store.open_output_stream(part) as f:
                f.write(header_bytes(self.kind, rows, columns))
                shutil.copyfileobj(body, f, 8 << 20)
        return Written(part, rows, columns)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = store_of(self.uri, self.opener)
        good = [m for m in messages if m is not None and m.part]
        if len({m.columns for m in good}) > 1:
            self.abort(messages)
            raise ValueError("vectors of different widths")
        there = [f.path for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.is_file]
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.uri)
        store.create_dir(path, recursive=True)
        for old in there:
            store.delete_file(old)
        for m in good:
            name = m.part.rsplit("/", 1)[1]
            store.move(m.part, f"{path}/{name.rsplit('-', 1)[0]}.{SUFFIXES[self.kind]}")
        if good:
            store.delete_dir(f"{path}/{self.attempt}")
        with store.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        store, path = store_of(self.uri, self.opener)
        if store.get_file_info(f"{path}/{self.attempt}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.attempt}")


class MatrixSource(DataSource):
    """Options: path, filesystem (module:function), rowsPerTask; for writing kind: npy (a matrix), ip or l2 (a flat index of that metric)."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options, schema, overwrite)


def _only_spark(path: str, opener: str | None) -> bool:
    if opener or "://" not in path:
        return False
    try:
        store_of(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return True
    return False


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def read_vectors(spark: SparkSession, path: str, rows_per_task: int = ROWS_PER_TASK, filesystem: str | None = None) -> DataFrame:
    """(pos, vec) of a matrix or a flat index: one file, or a folder of parts."""
    if not _only_spark(path, filesystem):
        index_metric(spark, path, filesystem)  # a file of another kind is an error here, not in a task
        spark.dataSource.register(MatrixSource)
        options = {"path": path, "rowsPerTask": str(rows_per_task)} | ({"filesystem": filesystem} if filesystem else {})
        return spark.read.format("matrix").options(**options).load()

    # Spark hands over whole parts; the places of their rows come from headers alone.
    parts = _binary(spark, path)
    heads = parts.select("path", F.substring("content", 1, 4_096).alias("start")).orderBy("path").collect()  # a row for each part
    first, firsts = 0, []
    for r in heads:
        firsts.append((r.path, first))
        first += header_of(bytes(r.start), r.path).rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, begin in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = content.as_buffer()
                h = header_of(raw[:4_096].to_pybytes(), name)
                numbers = np.frombuffer(raw, "<f4", h.rows * h.columns, h.offset).reshape(h.rows, h.columns)
                for at in range(0, h.rows, ROWS_PER_BATCH):
                    yield vectors_batch(begin + at, numbers[at : at + ROWS_PER_BATCH])

    starts = spark.createDataFrame(firsts, "path string, first long")
    return parts.join(F.broadcast(starts), "path").select("path", "content", "first").mapInArrow(run, SCHEMA)


def index_metric(spark: SparkSession, path: str, filesystem: str | None = None) -> str | None:
    """ip or l2 for a flat index, None for a matrix."""
    if _only_spark(path, filesystem):
        r = _binary(spark, path).select("path", F.substring("content", 1, 4_096).alias("start")).first()
        return header_of(bytes(r.start), r.path).metric
    store, inner = store_of(path, filesystem)
    parts = parts_of(store, inner)
    return part_header(store, parts[0]).metric if parts else None


def save_vectors(df: DataFrame, path: str, kind: str = "npy", filesystem: str | None = None, rows_per_part: int = ROWS_PER_PART, mode: str = "errorifexists") -> str:
    """Vectors (pos, vec) in order of pos as a folder of parts; kind: npy (a matrix), ip or l2 (a flat index).

    read_vectors() numbers them from 0 in that order, whatever their pos was."""
    df.sparkSession.dataSource.register(MatrixSource)
    rows = df.select("pos", F.col("vec").cast("array<float>").alias("vec"))
    parts = max(1, -(-rows.count() // rows_per_part))
    dealt = ranges.ordered(rows, ["pos"], parts).select("pos", "vec")
    options = {"path": path, "kind": kind} | ({"filesystem": filesystem} if filesystem else {})
    dealt.write.format("matrix").mode("overwrite" if mode == "overwrite" else "append").options(**options).save()
    return path
