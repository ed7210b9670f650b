"""What the operators of this subpackage share: reading, word scanning and lineage cuts.

A *word* is a maximal run of characters other than space and ``\\t \\n \\v \\f \\r``.
Words are found on the UTF-8 bytes of a whole Arrow batch with numpy, and are known by 64-bit
fingerprints (two different words of a corpus of V words share one with probability V*V/2**65).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators.rounds import shared_folder

#: Bytes of text that one vectorised step works on; the arrays of a step are about 40 times that.
PIECE_BYTES = 1 << 20
#: The same for the coders, which sort what they know of words anew after each step.
CODING_BYTES = 4 << 20
#: Rows of an Arrow batch, of texts of a few KB each: tasks hold several batches at once, in the JVM and in Python.
BATCH_ROWS = "1000"

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_RANDOM = np.random.default_rng(20250101).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of ``sf_dir``, through Spark's reader only, so that any store will do."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` rows, where the session has Spark's default of ten times that."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder; later plans start from there."""
    shared_folder(df.sparkSession)
    small_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a table of compressed columns: for loops, whose plans would else gather what Spark knows of earlier rounds."""
    place = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    small_batches(df.sparkSession)
    with freed(df.sparkSession):
        df.write.parquet(place)
    table = df.sparkSession.read.schema(df.schema).parquet(place)
    table.stored_in = place
    return table


def stored_by_steps(parts: Iterable[DataFrame]) -> DataFrame:
    """Like ``stored``, of the rows of all parts, each computed on its own: what one shuffles is deleted before the next begins."""
    table, place = None, ""
    for df in parts:
        if table is None:
            table = stored(df)
            place = table.stored_in
            continue
        with freed(df.sparkSession):
            df.write.mode("append").parquet(place)
    if table is None:
        raise ValueError("no parts")
    table = table.sparkSession.read.schema(table.schema).parquet(place)
    table.stored_in = place
    return table


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what is written or collected within as soon as that is done, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def forget(table: DataFrame) -> None:
    """Deletes what ``stored`` has written, when no plan will read it again."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_in)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of at most ``most`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits each depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some texts: bytes, text bounds in them, word bounds, and the first word of each text."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """The text's index, for each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each text has."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def prints(self) -> np.ndarray:
        """A 64-bit fingerprint of each word."""
        return prints(self.data, self.start, self.end)


def prints(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each stretch of bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    powers, inverse = _powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_RANDOM[data] * powers[: len(data)])])
    return mix((total[end] - total[start]) * inverse[start])


def gathered(store: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``store`` one after another, and their bounds."""
    to = np.concatenate([[0], np.cumsum(size)])
    return store[np.repeat(start - to[:-1], size) + np.arange(to[-1])], to


_CACHE: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_CACHE.get("up", ())) < n:
        room = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            row = np.full(room, base, np.uint64)
            row[0] = 1
            _CACHE[name] = np.cumprod(row)
    return _CACHE["up"], _CACHE["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's bounds in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def scan(column: pa.Array, lower: bool = False, apart: np.ndarray = _SEPARATORS) -> Words:
    """The words of each text of a string column, A-Z lower-cased on demand; ``apart`` tells which bytes are in none."""
    data, bounds = utf8(column)
    if lower:
        data = _LOWER[data]
    inside = ~apart[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(bounds))
    begins[bounds[full]] = inside[bounds[full]]
    ends[bounds[full + 1] - 1] = inside[bounds[full + 1] - 1]
    start = np.flatnonzero(begins)
    return Words(data, bounds, start, np.flatnonzero(ends) + 1, np.searchsorted(start, bounds))


def shingles(words: Words, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the runs of ``n`` words, by first word, and whether a run stays in one text."""
    total = len(prints) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.zeros(total, np.uint64)
    for j in range(n):
        out = out * np.uint64(_BASE) + prints[j : j + total]
    doc = words.doc
    return mix(out), doc[:total] == doc[n - 1 :]


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type) for k, c in columns.items()], schema=schema)
