"""Numpy matrices in files as a Spark source and sink, ``format("npy")``.

Reading gives ``id BIGINT`` and ``row ARRAY<type>``; a file's rows are cut into
partitions and read by ranges of bytes. Ids are a file's start, taken from its
name, plus the row's place in it. Folders are paths or URIs that all executors
reach (local and mounted ones, and what Arrow has a file system for).
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of one input partition.
ROWS = 50_000
#: Bytes of rows that a written file holds at most, and a task keeps.
FILE_BYTES = 64 << 20


def _located(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if re.match(r"\w+:/", folder) else (fs.LocalFileSystem(), folder)


def listed(folder: str, max_files: int | None = None) -> list[PurePosixPath]:
    """Files of a folder by the number before the last in their names, others by name after them."""

    def key(p: PurePosixPath) -> tuple:
        numbers = re.findall(r"\d+", p.stem)
        return (0, int(numbers[-2]), p.name) if len(numbers) > 1 else (1, 0, p.name)

    system, at = _located(folder)
    found = [PurePosixPath(i.path) for i in system.get_file_info(fs.FileSelector(at)) if i.is_file and i.path.endswith(".npy")]
    return sorted(found, key=key)[:max_files]


def checked(folder: str, slices: bool = False) -> list[PurePosixPath]:
    """The folder's files; ValueError unless there are some and their names number them 0, 1, ... with starts.

    Names are ``*_<file>_<first id>.npy``, or ``*_<first id>_<end>.npy`` for slices.
    """
    system, at = _located(folder)
    if system.get_file_info(at).type != fs.FileType.Directory:
        raise ValueError(f"{folder} is no folder")
    files = listed(folder)
    if not files:
        raise ValueError(f"{folder} has no npy file")
    names = [re.fullmatch(r".*_(\d+)_(\d+)", p.stem) for p in files]
    if not all(names):
        raise ValueError("names must end in two numbers")
    if not slices and sorted(int(m[1]) for m in names) != list(range(len(files))):
        raise ValueError("files must be numbered from 0 without gaps")
    return files


def first_id(path: PurePosixPath, slices: bool = False) -> int:
    m = re.fullmatch(r".*_(\d+)_(\d+)", path.stem)
    return int(m[1] if slices else m[2])


def _header(f: pa.NativeFile) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and first byte of a file's data."""
    head = io.BytesIO(f.read_at(min(f.size(), 1 << 16), 0))
    version = np.lib.format.read_magic(head)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_columns, kind = read(head)
    if by_columns and len(shape) > 1 or kind.hasobject:
        raise ValueError("files must hold plain rows, one after another")
    return shape, kind, head.tell()


def _opened(folder: str, path: PurePosixPath | str) -> pa.NativeFile:
    return _located(folder)[0].open_input_file(str(path))


@dataclass
class Rows(InputPartition):
    #: (path, first row, end, id of the file's first row), ROWS rows in all or little more.
    parts: list[tuple[str, int, int, int]]


_KINDS = {"u": "bigint", "i": "bigint", "b": "int", "f": "double"}


class NpyReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.folder, self.schema = options.get("path", ""), schema
        self.slices = options.get("slices", "false").lower() == "true"
        self.max_files = int(options["maxfiles"]) if options.get("maxfiles") else None
        self.max_rows = int(options["maxrowsperfile"]) if options.get("maxrowsperfile") else None
        self.unpack = options.get("unpack", "false").lower() == "true"

    def partitions(self) -> list[Rows]:
        out: list[Rows] = []
        size = 0
        for p in checked(self.folder, self.slices)[: self.max_files]:
            with _opened(self.folder, p) as f:
                n = _header(f)[0][0]
            n = n if self.max_rows is None else min(n, self.max_rows)
            for lo in range(0, n, ROWS):
                if not out or size >= ROWS:
                    out.append(Rows([]))
                    size = 0
                out[-1].parts.append((str(p), lo, min(n, lo + ROWS), first_id(p, self.slices)))
                size += min(n, lo + ROWS) - lo
        return out

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        for p in part.parts:
            yield from self._read(*p)

    def _read(self, path: str, start: int, stop: int, first: int) -> Iterator[pa.RecordBatch]:
        with _opened(self.folder, path) as f:
            shape, data, begin = _header(f)
            kind = pa.float64() if data.kind == "f" else pa.int32() if data.kind == "b" else pa.int64()
            width = shape[1] if len(shape) > 1 else 1
            for lo in range(start, stop, 5000):
                n = min(stop, lo + 5000) - lo
                x = np.frombuffer(f.read_at(n * width * data.itemsize, begin + lo * width * data.itemsize), data).reshape(n, width)
                x = np.unpackbits(x, axis=1) if self.unpack else x
                flat = pa.array(x.ravel().astype(kind.to_pandas_dtype()), kind)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([pa.array(first + lo + np.arange(len(x), dtype=np.int64)), rows], names=["id", "row"])


@dataclass
class Written(WriterCommitMessage):
    #: Temporary and final names.
    files: list[tuple[str, str]]


class NpyWriter(DataSourceArrowWriter):
    """Rows (id, row), ascending by id in each task, to files of consecutive ids named by their first id and end.

    A file ends where ids leave a gap and at FILE_BYTES, which is all that a
    task keeps, so ids with many gaps make many files; files get their names when all tasks are done.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        system, at = _located(self.folder)
        system.create_dir(at)
        if not overwrite and system.get_file_info(fs.FileSelector(at)):
            raise ValueError(f"{self.folder} isn't empty")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, at = _located(self.folder)
        out: list[tuple[str, str]] = []
        held: list[np.ndarray] = []
        first = end = None

        def flush() -> None:
            nonlocal held
            if held:
                name = f"{at}/.{uuid.uuid4().hex}.tmp"
                data = io.BytesIO()
                np.save(data, np.concatenate(held))
                with system.open_output_stream(name) as f:
                    f.write(data.getbuffer())
                out.append((name, f"{at}/rows_{first}_{end}.npy"))
                held = []

        for b in batches:
            if not b.num_rows:
                continue
            if b.column(0).null_count or b.column(1).null_count:
                raise ValueError("ids and rows must not be null")
            ids, rows = b.column(0).to_numpy(), b.column(1)
            widths = np.unique(np.diff(rows.offsets.to_numpy()))
            if len(widths) > 1 or (held and held[-1].shape[1] != widths[0]):
                raise ValueError("rows must be of one length")
            x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), int(widths[0]))
            step = np.diff(ids)
            if (step <= 0).any() or (end is not None and ids[0] < end):
                raise ValueError("ids must ascend in each task and not repeat; see npy.save")
            for part in np.split(np.arange(len(ids)), np.flatnonzero(step > 1) + 1):
                if end != ids[part[0]]:
                    flush()
                    first = int(ids[part[0]])
                for lo in range(0, len(part), max(1, FILE_BYTES // max(1, x.itemsize * x.shape[1]))):
                    some = part[lo : lo + max(1, FILE_BYTES // max(1, x.itemsize * x.shape[1]))]
                    if sum(h.nbytes for h in held) + x[some].nbytes > FILE_BYTES:
                        flush()
                        first = int(ids[some[0]])
                    held.append(x[some])
                    end = int(ids[some[-1]]) + 1
        flush()
        return Written(out)

    def commit(self, messages: list) -> None:
        system, at = _located(self.folder)
        if self.overwrite:
            for i in system.get_file_info(fs.FileSelector(at)):
                if i.path.endswith(".npy"):
                    system.delete_file(i.path)
        targets = [t for m in messages if m for _, t in m.files]
        if len(set(targets)) < len(targets):
            raise ValueError("two tasks wrote the same ids")
        for m in messages:
            for temporary, target in m.files if m else []:
                system.move(temporary, target)

    def abort(self, messages: list) -> None:
        system, _ = _located(self.folder)
        for m in messages:
            for temporary, _ in m.files if m else []:
                if system.get_file_info(temporary).is_file:
                    system.delete_file(temporary)


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        folder = self.options["path"]
        with _opened(folder, checked(folder, self.options.get("slices", "false").lower() == "true")[0]) as f:
            kind = _header(f)[1].kind
        return f"id bigint, row array<{_KINDS.get(kind, 'double')}>"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)


def save(rows: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Rows (id, row) in any order; ids may have gaps but not repeat. Read them back with ``slices``."""
    register(rows.sparkSession)
    ordered = rows.select("id", "row").repartitionByRange("id").sortWithinPartitions("id")
    ordered.write.format("npy").mode("overwrite" if overwrite else "append").option("path", folder).save()
