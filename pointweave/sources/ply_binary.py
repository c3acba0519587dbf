"""Binary PLY files as a Spark data source, format "ply": records of fixed width, read by byte ranges and written per task.

    spark.dataSource.register(PlySource)
    spark.read.format("ply").load(folder)
    points.write.format("ply").mode("append").save(folder)

The driver lists files and their sizes; each task reads the header of its file and then the records that start in its byte
range, a chunk at a time, so a large file is split and no header is trusted for another file. Columns are the vertex
properties of the first file, or those that a schema of the reader names; properties are found by name, and one that a
file lacks is null. Both byte orders and text files are read; text files are not split, and an unreadable number in one
is null. Elements before the vertices need a fixed width, what stands behind them is ignored. A file shorter than its
header says, and a vertex with a list, are errors.

A task writes one file under _temporary, its header once its points are counted; the commit moves the files of all tasks
that succeeded and leaves nothing of others. Null numbers are written as NaN, or 0 where a type has none. Paths are those
of a file system that all machines mount.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from pointweave.sources.ply import TYPES

#: numpy's names of PLY's types, and the byte orders.
NUMPY = {
    "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8",
}
ORDERS = {"binary_little_endian": "<", "binary_big_endian": ">", "ascii": ""}
SPARK = {"tinyint": "char", "smallint": "short", "int": "int", "bigint": "double", "float": "float", "double": "double"}
#: Records of a chunk, and bytes of a partition.
CHUNK, SPLIT = 1 << 16, 64 << 20


@dataclass
class Header:
    order: str
    properties: list[tuple[str, str]]  # (type, name) of the vertices
    count: int
    start: int  # the first vertex's byte

    @property
    def record(self) -> np.dtype:
        return np.dtype([(n, self.order + NUMPY[t]) for t, n in self.properties])


def header(path: str) -> Header:
    order, elements = None, []
    with open(path, "rb") as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"{path}: no PLY file")
        while line := f.readline():
            w = line.decode("ascii", "replace").split()
            if w[:1] == ["format"]:
                order = ORDERS[w[1]]
            elif w[:1] == ["element"]:
                elements.append((w[1], int(w[2]), []))
            elif w[:1] == ["property"]:
                elements[-1][2].append((w[1], w[-1]))
            elif w[:1] == ["end_header"]:
                break
        else:
            raise ValueError(f"{path}: the header does not end")
        start = f.tell()
    if order is None:
        raise ValueError(f"{path}: no format")
    for name, count, properties in elements:
        if any(t not in NUMPY for t, _ in properties):
            raise ValueError(f"{path}: element {name} has a list or an unknown type")
        if name == "vertex":
            return Header(order, properties, count, start)
        if not order:
            raise ValueError(f"{path}: element {name} stands before the vertices of a text file")
        start += count * sum(np.dtype(NUMPY[t]).itemsize for t, _ in properties)
    raise ValueError(f"{path}: no vertices")


def files(path: str) -> list[str]:
    """The file, or all .ply files below the folder but for unfinished ones."""
    path = path.removeprefix("file://")
    if os.path.isfile(path):
        return [path]
    return sorted(str(p) for p in Path(path).rglob("*.ply") if "_temporary" not in p.parts)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class PlyReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split: int) -> None:
        self.path, self.split = path, split
        self.columns = [f.name for f in schema]
        self.types = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in schema])

    def partitions(self) -> list[Range]:
        out = []
        for path in files(self.path):
            size = os.path.getsize(path)
            out += [Range(path, at, min(at + self.split, size)) for at in range(0, size, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        top = header(partition.path)
        if not top.order:
            if partition.start == 0:
                yield from self.text(partition.path, top)
            return
        width = top.record.itemsize
        if os.path.getsize(partition.path) < top.start + width * top.count:
            raise ValueError(f"{partition.path}: shorter than its {top.count} vertices")
        first, last = (min(top.count, max(0, -(-(at - top.start) // width))) for at in (partition.start, partition.end))
        with open(partition.path, "rb") as f:
            f.seek(top.start + first * width)
            for at in range(first, last, CHUNK):
                rows = np.frombuffer(f.read(width * min(CHUNK, last - at)), top.record)
                yield self.batch(partition.path, len(rows), {n: rows[n] for n in rows.dtype.names or ()})

    def text(self, path: str, top: Header) -> Iterator[pa.RecordBatch]:
        names = [n for _, n in top.properties]
        with open(path, "rb") as f:
            f.seek(top.start)
            left = top.count
            while left:
                rows = [w for w in (f.readline().split() for _ in range(min(CHUNK, left)))]
                if not rows[-1] and f.read(1) == b"":
                    rows = [w for w in rows if w]
                    if len(rows) < min(CHUNK, left):
                        raise ValueError(f"{path}: shorter than its {top.count} vertices")
                yield self.batch(path, len(rows), {n: np.array([number(w, i) for w in rows]) for i, n in enumerate(names)})
                left -= len(rows)

    def batch(self, path: str, n: int, found: dict[str, np.ndarray]) -> pa.RecordBatch:
        columns = []
        for field in self.types:
            if field.name == "file":
                columns.append(pa.array([path] * n, pa.string()))
            elif field.name not in found:
                columns.append(pa.nulls(n, field.type))
            else:
                x = found[field.name]
                x = x.astype(x.dtype.newbyteorder("=")) if x.dtype.kind != "O" else x
                floating = pa.types.is_floating(field.type)
                columns.append(pa.array(x).cast(field.type, safe=False) if floating or x.dtype.kind in "iu" else pa.array([None if v != v else int(v) for v in x.tolist()], field.type))
        return pa.RecordBatch.from_arrays(columns, schema=self.types)


def number(words: list[bytes], i: int) -> float:
    try:
        return float(words[i])
    except (ValueError, IndexError):
        return float("nan")


_ARROW = {"string": pa.string(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}


@dataclass
class Written(WriterCommitMessage):
    part: str
    count: int


class PlyWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        self.path = path.removeprefix("file://")
        self.properties = [(SPARK[f.dataType.simpleString()], f.name) for f in schema if f.dataType.simpleString() in SPARK]
        if len(self.properties) < len(schema.fields):
            raise ValueError("PLY files hold numbers alone")
        self.overwrite, self.temporary = overwrite, os.path.join(self.path, "_temporary", uuid.uuid4().hex)

    def top(self, count: int, size: int = 0) -> bytes:
        """The header, filled up to a size by a comment."""
        order = "binary_little_endian" if sys.byteorder == "little" else "binary_big_endian"
        lines = ["ply", f"format {order} 1.0", f"element vertex {count}", *(f"property {t} {n}" for t, n in self.properties)]
        plain = "\n".join([*lines, "comment ", "end_header", ""]).encode()
        return plain.replace(b"comment ", b"comment " + b"-" * max(0, size - len(plain)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.temporary, exist_ok=True)
        part, count = os.path.join(self.temporary, f"part-{uuid.uuid4().hex}.ply"), 0
        record = np.dtype([(n, NUMPY[t]) for t, n in self.properties])
        size = len(self.top(1 << 62))
        with open(part, "wb") as f:
            f.write(self.top(0, size))
            for batch in iterator:
                rows = np.zeros(len(batch), record)
                for _, n in self.properties:
                    x = batch.column(n)
                    rows[n] = x.fill_null(float("nan") if pa.types.is_floating(x.type) else 0).to_numpy(zero_copy_only=False)
                f.write(rows.tobytes())
                count += len(rows)
            f.seek(0)
            f.write(self.top(count, size))
        return Written(part, count)

    def commit(self, messages: list[Written]) -> None:
        if self.overwrite:
            for old in files(self.path):
                os.remove(old)
        for m in messages:
            if m and m.count:
                os.replace(m.part, os.path.join(self.path, os.path.basename(m.part)))
        self.abort(messages)

    def abort(self, messages: list[Written]) -> None:
        shutil.rmtree(self.temporary, ignore_errors=True)
        with contextlib.suppress(OSError):  # another job may write below
            os.rmdir(os.path.dirname(self.temporary))


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        found = files(self.options["path"])
        if not found:
            raise ValueError(f"no .ply files below {self.options['path']}")
        return ", ".join(["file string", *(f"`{n}` {TYPES[t]}" for t, n in header(found[0]).properties)])

    def reader(self, schema: StructType) -> PlyReader:
        return PlyReader(self.options["path"], schema, int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options["path"], schema, overwrite)
