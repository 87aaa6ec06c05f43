"""NPY files as a Spark data source: scans planned from names and headers, writes that are kept whole or not at all.

`spark.read.format("npy")` has one row a file (or a slice of one): path, folder (below the root), patch_id and variant from the
name, dtype, shape, first (the slice's first row), values in row-major order (floats, doubles if the schema says so), error. A schema with fewer of these columns
reads less: without `values` no array body is opened, and without shape, dtype, values and error no file is.
Equality and IN filters on patch_id, variant and folder choose files before any is opened. Options: `partition_bytes` of a task; `slice_rows`, the rows of the first axis in a
row, for arrays that are not to be read whole; `suffix` of the files (contents are read of NPY files only).

`df.write.format("npy")` takes patch_id, variant (may be null), shape and values, and folder if there is one; with the
option suffix ".png" values of [0, 1] become images of 8 bits. Tasks write beside the
root and a job's end moves the finished tasks' files in; a task that dies or is run twice, and a job that fails, leave
nothing. `mode("overwrite")` replaces files of the same name only; `append` fails where one is there.

Roots are paths or URIs that pyarrow's file systems open. Names begin with the patch's number, seven digits at least:
0000042_clean.npy. Files of other names have a null patch_id. An empty table writes no file.
"""

from __future__ import annotations

import ast
import os
import re
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..functions import png
from ..session import ship

SCHEMA = "path string, folder string, patch_id long, variant string, dtype string, shape array<int>, first long, values array<float>, error string"
NAME = re.compile(r"(\d+)(?:_(.*))?\.(?:npy|png)$")
PARTITION_BYTES = 64 << 20
FROM_NAME = {"path", "folder", "patch_id", "variant"}


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    root = re.sub(r"^file:/+", "/", root)
    return (pafs.LocalFileSystem(), os.path.abspath(root)) if root.startswith("/") or "://" not in root else pafs.FileSystem.from_uri(root)


def header(file) -> tuple[np.dtype, tuple[int, ...], bool, int]:
    """dtype, shape, whether columns come first, and the number of bytes before the body."""
    start = file.read(8)
    if len(start) < 8 or start[:6] != b"\x93NUMPY":
        raise ValueError("no NPY file")
    kind = "<H" if start[6] == 1 else "<I"
    size = struct.unpack(kind, file.read(struct.calcsize(kind)))[0]
    said = ast.literal_eval(file.read(size).decode("latin1" if start[6] < 3 else "utf8"))
    dtype = np.dtype(said["descr"])
    if dtype.hasobject:
        raise ValueError("arrays of objects are not read")
    return dtype, tuple(said["shape"]), said["fortran_order"], 8 + struct.calcsize(kind) + size


@dataclass
class Files(InputPartition):
    """Files of one task: path and folder below the root."""

    names: list[tuple[str, str]]

    def __post_init__(self):
        super().__init__(self.names)


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.fieldNames()
        self.kind = np.float64 if "values" in self.columns and schema["values"].dataType == ArrayType(DoubleType()) else np.float32
        self.root = options["path"]
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))
        self.rows = int(options.get("slice_rows", 0))
        self.suffix = options.get("suffix", ".npy")
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, (EqualTo, In)) and column in ("patch_id", "variant", "folder"):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            else:
                yield f

    def partitions(self):
        fs, root = opened(self.root)
        out, held, size = [], [], 0
        for info in sorted(fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)), key=lambda x: x.path):
            below = os.path.relpath(info.path, root)
            if info.type != pafs.FileType.File or not below.endswith(self.suffix) or below.startswith("_") or "/_" in below or not self._chosen(below):
                continue
            # what no body is read of weighs a page
            weight = max(info.size or 0, 4096) if "values" in self.columns else 4096
            if held and size + weight > self.most:
                out, held, size = [*out, Files(held)], [], 0
            held.append((info.path, os.path.dirname(below)))
            size += weight
        return [*out, Files(held)] if held or not out else out

    def _chosen(self, below: str) -> bool:
        patch, variant = named(below)
        return all(v in self.wanted[c] for c, v in (("patch_id", patch), ("variant", variant), ("folder", os.path.dirname(below))) if c in self.wanted)

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = opened(self.root)
        for path, folder in partition.names:
            patch, variant = named(path)
            row = {"path": path, "folder": folder, "patch_id": patch, "variant": variant}
            if set(self.columns) <= FROM_NAME:
                yield tuple(row[c] for c in self.columns)
                continue
            try:
                with fs.open_input_file(path) as file:
                    for found in self._slices(file):
                        yield tuple((row | found).get(c) for c in self.columns)
            except (ValueError, OSError, SyntaxError, KeyError, TypeError, MemoryError) as e:  # the file's own fault is its row
                yield tuple((row | {"error": f"{type(e).__name__}: {e}"}).get(c) for c in self.columns)

    def _slices(self, file) -> Iterator[dict]:
        dtype, shape, columns_first, start = header(file)
        said = {"dtype": dtype.str, "shape": list(shape), "first": 0}
        if "values" not in self.columns:
            yield said
            return
        whole = not self.rows or columns_first or not shape or shape[0] <= self.rows
        row_bytes = int(np.prod(shape[0 if whole else 1 :], dtype=np.int64)) * dtype.itemsize
        for first in [0] if whole else range(0, shape[0], self.rows):
            n = 1 if whole else min(self.rows, shape[0] - first)
            file.seek(start + first * row_bytes)
            raw = file.read(n * row_bytes)
            if len(raw) < n * row_bytes:
                raise ValueError("the file ends before its array")
            a = np.frombuffer(raw, dtype)
            if columns_first:
                a = a.reshape(shape, order="F").ravel()
            yield said | {"first": first, "values": a.astype(self.kind).tolist()}


def named(path: str) -> tuple[int | None, str | None]:
    """patch_id and variant of a file's name."""
    m = NAME.match(os.path.basename(path))
    return (int(m[1]), m[2]) if m else (None, None)


@dataclass
class Written(WriterCommitMessage):
    """The folder of a finished task attempt, null if it wrote nothing."""

    folder: str | None


class Writer(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        if missing := {"patch_id", "variant", "shape", "values"} - set(schema.fieldNames()):
            raise ValueError(f"an array table needs {', '.join(sorted(missing))}")
        self.root, self.overwrite = options["path"], overwrite
        self.dtype, self.suffix = options.get("dtype", "float32"), options.get("suffix", ".npy")
        self.staging = f"_writing-{uuid.uuid4().hex}"
        fs, root = opened(self.root)
        fs.create_dir(f"{root}/{self.staging}", recursive=True)

    def write(self, iterator) -> Written:
        fs, root = opened(self.root)
        context = TaskContext.get()
        folder = f"{root}/{self.staging}/{context.partitionId()}-{context.taskAttemptId()}"
        some = False
        for row in iterator:
            r = row.asDict()
            at = "/".join(x for x in (folder, r.get("folder")) if x)
            a = np.asarray(r["values"], self.dtype).reshape(r["shape"])
            self._within(fs, root, at)
            name = f"{at}/{r['patch_id']:07d}{'' if r['variant'] is None else '_' + r['variant']}{self.suffix}"
            some = True
            if fs.get_file_info(name).type != pafs.FileType.NotFound:
                raise ValueError("two rows have the same file")
            with fs.open_output_stream(name) as out:
                if self.suffix == ".png":
                    out.write(png.encode(np.clip(np.floor(a * 255.0 + 0.5), 0, 255)))
                    continue
                np.lib.format.write_array(_Sink(out), a, allow_pickle=False)
        return Written(folder if some else None)

    def _within(self, fs: pafs.FileSystem, root: str, folder: str) -> None:
        """The folders down to one below the staging folder; an error where that is gone, as after a job has failed."""
        at = f"{root}/{self.staging}"
        if fs.get_file_info(at).type != pafs.FileType.Directory:
            raise OSError("the job that this task belongs to has ended")
        for name in os.path.relpath(folder, at).split("/"):
            at = f"{at}/{name}"
            fs.create_dir(at, recursive=False)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.root)
        moves = []
        for m in messages:
            if m and m.folder:
                for info in fs.get_file_info(pafs.FileSelector(m.folder, recursive=True)):
                    if info.type == pafs.FileType.File:
                        moves.append((info.path, f"{root}/{os.path.relpath(info.path, m.folder)}"))
        targets = [b for _, b in moves]
        twice = len(set(targets)) < len(targets)
        there = [] if self.overwrite else [b for b in targets if fs.get_file_info(b).type != pafs.FileType.NotFound]
        if twice or there:
            self.abort(messages)
            raise ValueError("two rows have the same file" if twice else f"{there[0]} and {len(there) - 1} more are there already")
        for d in {os.path.dirname(b) for b in targets}:
            fs.create_dir(d, recursive=True)
        for a, b in moves:
            fs.move(a, b)
        self.abort(messages)

    def abort(self, messages) -> None:
        """Deletes what the job staged; tasks that still run find no folder and end."""
        fs, root = opened(self.root)
        for k in range(20):
            try:
                if fs.get_file_info(f"{root}/{self.staging}").type != pafs.FileType.Directory:
                    return
                fs.delete_dir(f"{root}/{self.staging}")
            except OSError:  # a task has put a file in while the folder was emptied
                time.sleep(0.1 * k)


class _Sink:
    """What numpy writes an array to: bytes go on to a stream."""

    def __init__(self, out):
        self.out = out

    def write(self, raw) -> int:
        self.out.write(pa.py_buffer(raw))
        return len(raw)


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options, overwrite)


def _registered(spark: SparkSession) -> SparkSession:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a reader that takes filters is refused without it
    spark.dataSource.register(NpySource)
    return spark


def arrays(spark: SparkSession, path: str, columns: str = SCHEMA, **options) -> DataFrame:
    """The files of a folder with the columns that are named in a schema; see the module for options."""
    return _registered(spark).read.format("npy").schema(columns).options(**options).load(path)


def write(df: DataFrame, path: str, overwrite: bool = False, **options) -> None:
    """Rows of patch_id, variant, shape, values (and folder) as files, all or none."""
    _registered(df.sparkSession)
    df.write.format("npy").options(**options).mode("overwrite" if overwrite else "append").save(path)
