"""Shards of arrays as a source and a sink of Spark: npy files, one for each column and shard, or npz files, one for each shard with a member for each column. Nothing is pickled or unpickled.

spark.dataSource.register(Arrays), or read and write below. A row of the table is a row of the arrays' first dimension, a column an array; which columns are read is told by the schema, and only their bytes are.
"""

from __future__ import annotations

import re
import sys
import uuid
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers needn't have the package on their path

TYPES = {FloatType: "<f4", DoubleType: "<f8", ByteType: "|i1", ShortType: "<i2", IntegerType: "<i4", LongType: "<i8", BooleanType: "|b1"}
#: Columns that a schema may name besides the arrays: the shard, as in the file's name, and the row's number in it.
SHARD, ROW = "shard", "row"
#: About so many bytes of arrays are read by a task, and held by one at a time.
TASK_BYTES, BATCH_BYTES = 32 << 20, 4 << 20


def _inner(kind: DataType) -> tuple[str, int]:
    """The dtype of a column's numbers and how many dimensions a value has."""
    depth = 0
    while isinstance(kind, ArrayType):
        kind, depth = kind.elementType, depth + 1
    if type(kind) not in TYPES:
        raise ValueError(f"no array of {kind.simpleString()}")
    return TYPES[type(kind)], depth


def _files(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if re.match(r"^[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


def _header(f) -> tuple[str, tuple[int, ...]]:
    """dtype and shape of the array that a stream is at the beginning of; what is pickled or in columns' order is an error."""
    import numpy as np

    version = np.lib.format.read_magic(f)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if kind.hasobject:
        raise ValueError("arrays of objects aren't read")
    if not shape or fortran and len(shape) > 1:
        raise ValueError("arrays have rows, one after another")
    return kind.str, shape


@dataclass
class Rows(InputPartition):
    """Rows first to last (exclusive) of a shard; files by column."""

    shard: str
    files: dict
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.kind, self.bytes = options["path"].rstrip("/"), options.get("kind", "npy"), int(options.get("taskbytes", TASK_BYTES))
        self.fields = [(f.name, None if f.name in (SHARD, ROW) else _inner(f.dataType)) for f in schema.fields]
        self.arrays = [(c, k) for c, k in self.fields if k is not None]
        if not self.arrays:
            raise ValueError("the schema names no array")

    def _open(self, system, name: str, column: str):
        """A stream of a column's array, and whether places in it can be looked up."""
        import zipfile

        f = system.open_input_file(name)
        if self.kind == "npy":
            return f, True
        member = zipfile.ZipFile(f).getinfo(f"{column}.npy")
        return zipfile.ZipFile(f).open(member), member.compress_type == zipfile.ZIP_STORED

    def partitions(self) -> list[Rows]:
        """Shards in the order of their names, cut into ranges of rows; compressed ones are read whole. Columns of a shard must have equally many rows, and each shard each column."""
        import math

        import numpy as np
        from pyarrow import fs

        system, root = _files(self.path)
        names = sorted(i.path for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File)
        shards: dict[str, dict[str, str]] = {}
        for name in names:
            base = name.rsplit("/", 1)[1]
            if self.kind == "npz" and base.endswith(".npz"):
                shards[base[:-4]] = {c: name for c, _ in self.arrays}
            for c, _ in self.arrays if self.kind == "npy" else ():
                if base.startswith(f"{c}_") and base.endswith(".npy"):
                    shards.setdefault(base[len(c) + 1 : -4], {})[c] = name
        if not shards:
            raise ValueError(f"no shard in {self.path}")
        out = []
        for shard, files in sorted(shards.items()):
            sizes, width, seeks = {}, 0, True
            for c, (kind, depth) in self.arrays:
                if c not in files:
                    raise ValueError(f"shard {shard} has no {c}")
                f, can = self._open(system, files[c], c)
                with f:
                    stored, shape = _header(f)
                if len(shape) != depth + 1 or not np.can_cast(stored, kind, "same_kind"):
                    raise ValueError(f"{c} of shard {shard} is {stored} in {len(shape)} dimensions")
                sizes[c], seeks = shape[0], seeks and can
                width += max(1, math.prod(shape[1:])) * np.dtype(stored).itemsize
            if len(set(sizes.values())) > 1:
                raise ValueError(f"shard {shard} has different numbers of rows: {sizes}")
            n = max(sizes.values())
            step = max(1, self.bytes // max(1, width)) if seeks else max(1, n)
            out += [Rows(shard, files, k, min(n, k + step)) for k in range(0, n, step)]
        return out

    def read(self, part: Rows):
        import math
        from contextlib import ExitStack

        import numpy as np

        system, _ = _files(self.path)
        with ExitStack() as stack:
            open_ = {}
            for c, (kind, _) in self.arrays:
                f, _ = self._open(system, part.files[c], c)
                stack.enter_context(f)
                stored, shape = _header(f)
                size = math.prod(shape[1:]) * np.dtype(stored).itemsize
                f.seek(f.tell() + part.first * size)
                open_[c] = (f, stored, shape[1:], size, kind)
            step = max(1, BATCH_BYTES // max(1, sum(o[3] for o in open_.values())))
            for start in range(part.first, part.last, step):
                n = min(step, part.last - start)
                values = {}
                for c, (f, stored, shape, size, kind) in open_.items():
                    raw = f.read(n * size)
                    if len(raw) != n * size:
                        raise ValueError(f"{part.files[c]} is cut off")
                    values[c] = np.frombuffer(raw, stored).astype(kind).reshape(n, *shape).tolist()
                own = {SHARD: lambda i: part.shard, ROW: lambda i, s=start: s + i}
                for i in range(n):
                    yield tuple(values[c][i] if k is not None else own[c](i) for c, k in self.fields)


@dataclass
class Written(WriterCommitMessage):
    """The files that a task has written, in order: (number of the task, place, column, path)."""

    files: list


class _Writer(DataSourceWriter):
    """Tasks write to a folder of their own; the files get their names once all tasks are done, so that a failed task or job leaves none."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.path, self.kind, self.rows = options["path"].rstrip("/"), options.get("kind", "npy"), int(options.get("rows", 1000))
        self.overwrite, self.fields = overwrite, [(f.name, *_inner(f.dataType)) for f in schema.fields]
        self.temporary = f"{self.path}/_writing-{uuid.uuid4().hex}"
        system, root = _files(self.temporary)
        system.create_dir(root)  # here and not in tasks, so that one that goes on for a while after the end of its job doesn't bring it back

    def write(self, iterator) -> Written:
        import io
        import itertools
        import zipfile

        import numpy as np
        from pyspark import TaskContext

        system, root = _files(self.temporary)
        task, mine = TaskContext.get().partitionId(), uuid.uuid4().hex
        files: list = []

        def put(column: str, k: int, content: bytes) -> None:
            name = f"{root}/{mine}-{k}-{column}"
            with system.open_output_stream(name) as out:
                out.write(content)
            files.append((task, k, column, name))

        def packed(array) -> bytes:
            out = io.BytesIO()
            np.lib.format.write_array(out, array, allow_pickle=False)
            return out.getvalue()

        for k in itertools.count():
            rows = list(itertools.islice(iterator, self.rows))
            if not rows:
                return Written(files)
            arrays = {}
            for c, kind, depth in self.fields:
                if any(r[c] is None for r in rows):
                    raise ValueError(f"{c} has nulls")
                arrays[c] = np.array([r[c] for r in rows]).astype(kind)  # rows of different lengths are an error
                if arrays[c].ndim != depth + 1:
                    raise ValueError(f"{c} has values of different shapes")
            if self.kind == "npy":
                for c, a in arrays.items():
                    put(c, k, packed(a))
            else:
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                    for c, a in arrays.items():
                        z.writestr(f"{c}.npy", packed(a))
                put("", k, out.getvalue())

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, root = _files(self.path)
        old = [i.path for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and i.path.endswith(f".{self.kind}")]
        if self.overwrite:
            for name in old:
                system.delete_file(name)
            old = []
        shards = sorted({(t, k) for m in messages if m for t, k, _, _ in m.files})
        taken = [int(x[1]) for x in (re.search(r"(\d+)\.\w+$", name) for name in old) if x]
        number = {s: i for i, s in enumerate(shards, max(taken, default=-1) + 1)}
        for m in messages:
            for t, k, c, name in m.files if m else ():
                system.move(name, f"{root}/{c}{'_' if c else ''}{number[t, k]}.{self.kind}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, root = _files(self.temporary)
        if system.get_file_info(root).type == fs.FileType.Directory:
            system.delete_dir(root)


class Arrays(DataSource):
    """Options: path (a folder), kind (npy or npz), taskBytes for reading, rows (of a shard at most) for writing.

    Reading needs a schema: columns of numbers or of arrays of them, nested as deep as the arrays have further dimensions, and shard and row where wanted. Shards whose columns have different numbers of rows,
    lack a column or aren't of a type that can be cast are errors, as are nulls and values of different shapes in writing. An empty table writes no shard; a column may not be called shard or row.
    """

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        raise ValueError("arrays are read with a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(schema, dict(self.options), overwrite)


def read(spark: SparkSession, path: str, schema: str, kind: str = "npy", task_bytes: int = TASK_BYTES) -> DataFrame:
    """The shards of a folder, with the columns that the schema names."""
    spark.dataSource.register(Arrays)
    return spark.read.format("arrays").schema(schema).option("kind", kind).option("taskBytes", task_bytes).load(path)


def write(df: DataFrame, path: str, kind: str = "npy", rows: int = 1000, mode: str = "overwrite") -> None:
    """df as shards of at most so many rows; numbers of shards go on after those there where mode is append. Partitions and their order give the shards', so sort df where that matters."""
    df.sparkSession.dataSource.register(Arrays)
    df.write.format("arrays").option("kind", kind).option("rows", rows).mode(mode).save(path)
