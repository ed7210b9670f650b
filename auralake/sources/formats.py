"""WAV, NPZ and other files as data sources: ``spark.read.format("wav")``, ``df.write.format("wav")``.

``register(spark)`` makes the formats ``wav``, ``npz`` and ``files`` known to a session. A read lists
the files below its path and deals them out by size, large and small together. What the columns that
are asked for do not need is not read: without samples or numbers that come of them, a few bytes of
each file's head are.

A write puts each task's files into a folder of the job, under names that no other attempt has. When
all tasks are done the driver moves what the successful attempts have told it of to the places that
the rows name, and removes the folder; if one fails, it removes the folder alone. So no file is ever
half written, and what a lost executor has left goes away.

Paths are local ones or URIs of stores that pyarrow reaches.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass
from pathlib import PurePosixPath
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .audio import read_wav, write_wav

#: Bytes of files that a task reads, and what a file counts for at least.
PART_BYTES, FILE_BYTES = 128 << 20, 1 << 20
#: Bytes of rows that a reader gives out at once.
BATCH_BYTES = 4 << 20
#: Bytes that a head is counted for where nothing else is read.
HEAD_BYTES = 64 << 10
#: How often the removal of a job's folder is tried.
ATTEMPTS = 100
#: Threads with which the driver moves files.
MOVERS = 16


def store_of(path: str):
    """The file system and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), os.path.abspath(path)) if "://" not in path else fs.FileSystem.from_uri(path)


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder, by name, or of the one file; hidden ones and those that begin with _ are left out."""
    from pyarrow import fs

    store, place = store_of(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [i for i in store.get_file_info(fs.FileSelector(place, recursive=True)) if i.type == fs.FileType.File]
    below = lambda i: i.path[len(place) :] if i is not info else ""
    return sorted((i.path, i.size) for i in found if i.path.endswith(suffix) and not any(p[:1] in (".", "_") for p in below(i).split("/") if p))


@dataclass
class Part(InputPartition):
    files: list[tuple[str, int]]


def planned(files: list[tuple[str, int]], most: int, least: int, heads: bool) -> list[list[tuple[str, int]]]:
    """Files dealt out from the largest on, so that a part has at most ``most`` bytes, or one file."""
    weight = lambda f: HEAD_BYTES if heads else max(f[1], least)
    parts: list[list[tuple[str, int]]] = []
    now, size = [], 0
    for f in sorted(files, key=lambda f: (-weight(f), f[0])):
        if now and size + weight(f) > most:
            parts.append(now)
            now, size = [], 0
        now.append(f)
        size += weight(f)
    return [*parts, now] if now else parts


def _option(options: dict, name: str, default: int) -> int:
    return int(options.get(name, default))


class _Reader(DataSourceReader):
    """Gives the columns of ``schema`` of each file below a path; a subclass says what a file's rows are and which columns need more than its head."""

    suffix = ""
    of_content: frozenset[str] = frozenset()

    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.fieldNames()
        self.types, self.path, self.strict = to_arrow_schema(schema), options["path"], options.get("mode", "").lower() == "failfast"
        self.heads = not self.of_content & set(self.columns)
        self.most, self.least = _option(options, "partBytes", PART_BYTES), _option(options, "fileBytes", FILE_BYTES)

    def partitions(self) -> list[Part]:
        return [Part(p) for p in planned(listed(self.path, self.suffix), self.most, self.least, self.heads)] or [Part([])]

    def rows(self, store, path: str, size: int) -> Iterator[dict[str, Any]]:
        raise NotImplementedError

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        held, size = [], 0
        for path, length in partition.files:
            try:
                found = list(self.rows(store, path, length))
            except (ValueError, KeyError, TypeError, EOFError, OSError, struct.error, zipfile.BadZipFile) as problem:
                if self.strict:
                    raise ValueError(f"{path}: {problem}") from problem
                found = [{"error": str(problem)[:200]}]
            held += [{"path": path, "length": length, **row} for row in found]
            size += HEAD_BYTES if self.heads else length
            if size >= BATCH_BYTES:
                yield self.batch(held)
                held, size = [], 0
        if held:
            yield self.batch(held)

    def batch(self, rows: list[dict[str, Any]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in self.types], schema=self.types)


def numbers(x: np.ndarray) -> dict[str, Any]:
    """What can be said of all values of an array: whether they are finite, and of finite ones the largest magnitude and the root of their mean square."""
    if not np.issubdtype(x.dtype, np.number) or np.issubdtype(x.dtype, np.complexfloating):
        return {"finite": None, "peak": None, "rms": None}
    x = x.astype(np.float64)
    if not np.isfinite(x).all():
        return {"finite": False, "peak": None, "rms": None}
    return {"finite": True, "peak": float(np.abs(x).max(initial=0)), "rms": float(np.sqrt(np.mean(x * x))) if x.size else 0.0}


def wav_head(file) -> tuple[int, int, int, int, int]:
    """(format, channels, rate, bits, bytes of samples) of an open WAV file; only heads of chunks are read."""
    if (head := file.read(12))[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    form, end = None, file.size()
    while len(chunk := file.read(8)) == 8:
        kind, size = chunk[:4], struct.unpack_from("<I", chunk, 4)[0]
        if kind == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body := file.read(size))
            form = struct.unpack_from("<H", body, 24)[0] if tag == 0xFFFE and size >= 26 else tag, channels, rate, bits
        elif kind == b"data":
            if form is None:
                raise ValueError("data before format")
            if file.tell() + size > end:
                raise ValueError(f"{size} bytes of samples are stated, {end - file.tell()} are there")
            return (*form, size)
        else:
            file.seek(file.tell() + size)
        if size % 2:
            file.seek(file.tell() + 1)
    raise ValueError("no data")


class WavReader(_Reader):
    suffix = ".wav"
    of_content = frozenset(("left", "right", "samples", "finite", "peak", "rms", "sha256", "samples_sha256"))

    def rows(self, store, path: str, size: int) -> Iterator[dict[str, Any]]:
        with store.open_input_file(path) as file:
            tag, channels, rate, bits, data = wav_head(file)
            if not channels or not bits:
                raise ValueError("no channels")
            row: dict[str, Any] = {"sr": rate, "channels": channels, "n": data // (channels * bits // 8), "dtype": {(3, 32): "float32", (3, 64): "float64", (1, 8): "uint8"}.get((tag, bits), f"int{bits}"), "error": None}
            if not self.heads:
                file.seek(0)
                image = file.read()
                x, _ = read_wav(image)
                row |= numbers(x) | {"left": x[:, 0], "right": x[:, -1], "sha256": hashlib.sha256(image).hexdigest(), "samples_sha256": hashlib.sha256(np.ascontiguousarray(x).tobytes()).hexdigest()}
                if "samples" in self.columns:
                    row["samples"] = [x[:, c] for c in range(x.shape[1])]
        yield row


class NpzReader(_Reader):
    """A row for each member; ``data`` has its values in the order of C, little-endian."""

    suffix = ".npz"
    of_content = frozenset(("data", "number", "finite", "peak", "rms", "sha256"))

    def rows(self, store, path: str, size: int) -> Iterator[dict[str, Any]]:
        with store.open_input_file(path) as file:
            whole = None if self.heads else file.read()
            with zipfile.ZipFile(file if whole is None else io.BytesIO(whole)) as members:
                for info in members.infolist():
                    with members.open(info) as member:
                        version = np.lib.format.read_magic(member)
                        shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(member)
                    if kind.hasobject:
                        raise ValueError(f"{info.filename} holds pickled objects")
                    row: dict[str, Any] = {"member": info.filename.removesuffix(".npy"), "dtype": kind.name, "shape": list(shape), "error": None}
                    if whole is not None:
                        with members.open(info) as member:
                            x = np.lib.format.read_array(member, allow_pickle=False)
                        row |= numbers(x) | {"data": np.ascontiguousarray(x).astype(x.dtype.newbyteorder("<")).tobytes(), "number": float(x) if x.ndim == 0 and np.issubdtype(x.dtype, np.number) else None, "sha256": hashlib.sha256(whole).hexdigest()}
                    yield row


class FilesReader(_Reader):
    of_content = frozenset(("content", "sha256"))

    def rows(self, store, path: str, size: int) -> Iterator[dict[str, Any]]:
        if self.heads:
            yield {}
        else:
            with store.open_input_file(path) as file:
                content = file.read()
            yield {"content": content, "sha256": hashlib.sha256(content).hexdigest()}


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where they are and what they shall be named."""

    files: list[tuple[str, str]]


def safe_path(name: str) -> str:
    """``name`` if it is a path below a folder that leads out of it nowhere; ValueError otherwise."""
    parts = PurePosixPath(name or "").parts
    if not parts or name.startswith("/") or ".." in parts or any(ord(c) < 32 or c in ":\\" for c in name) or parts[0].startswith("_"):
        raise ValueError(f"not a path below the folder: {name!r}")
    return str(PurePosixPath(*parts))


class _Writer(DataSourceWriter):
    """Writes files below a folder; a subclass turns rows to (path, content)."""

    def __init__(self, options: dict, over: bool):
        self.path, self.over = options["path"], over
        self.job = f"_temporary-{uuid.uuid4().hex}"
        store, folder = store_of(self.path)
        store.create_dir(f"{folder}/{self.job}")

    def images(self, rows: Iterator) -> Iterator[tuple[str, bytes]]:
        raise NotImplementedError

    def write(self, rows: Iterator) -> Written:
        store, folder = store_of(self.path)
        own = f"{folder}/{self.job}/{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        store.create_dir(own, recursive=False)  # not where the job is over and its folder gone
        files: list[tuple[str, str]] = []
        try:
            for name, content in self.images(rows):
                place = f"{own}/{len(files)}"
                with store.open_output_stream(place) as out:
                    out.write(content)
                files.append((place, safe_path(name)))
        except BaseException:
            with suppress(FileNotFoundError):
                store.delete_dir(own)
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = store_of(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [n for _, n in files]
        try:
            if len(set(names)) < len(names):
                raise ValueError(f"{next(n for n in names if names.count(n) > 1)} is written more than once")
            before = {p for p, _ in listed(self.path, "")}
            there = {f"{folder}/{n}" for n in names}
            if before & there and not self.over:
                raise FileExistsError(f"{min(before & there)} is there already")
            for parent in {str(PurePosixPath(t).parent) for t in there}:
                store.create_dir(parent)
            with ThreadPoolExecutor(MOVERS) as movers:
                list(movers.map(lambda f: store.move(f[0], f"{folder}/{f[1]}"), files))
                if self.over:
                    list(movers.map(store.delete_file, before - there))
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, folder = store_of(self.path)
        for _ in range(ATTEMPTS):  # tasks that do not know yet may write meanwhile
            if store.get_file_info(f"{folder}/{self.job}").type != fs.FileType.Directory:
                return
            with suppress(OSError):
                store.delete_dir(f"{folder}/{self.job}")


class WavWriter(_Writer):
    """Rows (path, sr, samples), one array a channel, or (path, sr, left, right); float32."""

    def images(self, rows: Iterator) -> Iterator[tuple[str, bytes]]:
        for row in rows:
            named = row.asDict()
            channels = named["samples"] if "samples" in named else [named["left"], named["right"]]
            if len({len(c) for c in channels}) != 1:
                raise ValueError(f"{row['path']}: channels of unequal length")
            yield row["path"], write_wav(np.stack([np.array(c, np.float32) for c in channels], 1), int(row["sr"]))


class NpzWriter(_Writer):
    """Rows (path, member, dtype, shape, data); those of a path follow one another in one task."""

    def images(self, rows: Iterator) -> Iterator[tuple[str, bytes]]:
        path, members = None, {}

        def image() -> bytes:
            out = io.BytesIO()
            np.savez(out, **members)
            return out.getvalue()

        for row in rows:
            if row["path"] != path:
                if members:
                    yield path, image()
                path, members = row["path"], {}
            if row["member"] in members:
                raise ValueError(f"{path}: {row['member']} comes twice")
            members[row["member"]] = np.frombuffer(bytes(row["data"]), np.dtype(row["dtype"]).newbyteorder("<")).reshape(row["shape"])
        if members:
            yield path, image()


class FilesWriter(_Writer):
    """Rows (path, content), content being bytes or a text."""

    def images(self, rows: Iterator) -> Iterator[tuple[str, bytes]]:
        for row in rows:
            content = row["content"]
            yield row["path"], content.encode() if isinstance(content, str) else bytes(content)


class _Source(DataSource):
    fields, reading, writing = "", _Reader, _Writer

    def schema(self) -> str:
        return self.fields

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.reading(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return self.writing(dict(self.options), overwrite)


class WavSource(_Source):
    """``samples`` (one array a channel) and ``samples_sha256`` (of float32 frames) come where a schema names them."""

    fields = "path string, length long, sr int, n long, channels int, dtype string, finite boolean, peak double, rms double, sha256 string, left array<float>, right array<float>, error string"
    reading, writing = WavReader, WavWriter

    @classmethod
    def name(cls) -> str:
        return "wav"


class NpzSource(_Source):
    fields = "path string, length long, member string, dtype string, shape array<long>, finite boolean, peak double, rms double, number double, data binary, error string"
    reading, writing = NpzReader, NpzWriter

    @classmethod
    def name(cls) -> str:
        return "npz"


class FilesSource(_Source):
    fields = "path string, length long, content binary, sha256 string, error string"
    reading, writing = FilesReader, FilesWriter

    @classmethod
    def name(cls) -> str:
        return "files"


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session."""
    for source in (WavSource, NpzSource, FilesSource):
        spark.dataSource.register(source)
