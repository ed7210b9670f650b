"""Operator 7: documents whose SimHash fingerprints differ in few bits, by segment popcounts.

A fingerprint of 64 bits has 32 segments of two bits; the vector of their bit counts is its
embedding. The Manhattan distance of two embeddings is never more than the number of differing
bits. If it is at most ``MOST_BITS``, and the segments are dealt into ``g`` ranges, at least
``g - MOST_BITS`` ranges have distance zero: so each choice of that many ranges, with their counts,
is a cell of a grid, and two fingerprints within the distance share a cell. Fingerprints that share
a cell are compared exactly. ``g`` grows with the number of fingerprints so that a cell keeps a few
dozen of them by chance; the links do not depend on it.

Only different fingerprints are compared, documents of one fingerprint go together. A task gives
back a spanning forest of the links it has found, not the links, so a large group of near copies
makes as many rows as it has members. A cell of more than ``CELL_ROWS`` fingerprints is dealt out
in pairs of blocks: each pair of blocks is one unit of work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components, forest

SHINGLE, SEED, MOST_BITS = 4, 42, 4
SEGMENTS = 32
#: The share of pairs of random fingerprints that agree in the bit count of one segment.
AGREE = 0.375
#: Fingerprints that may share a cell by chance, on average; and those of a cell that one task compares.
BY_CHANCE, CELL_ROWS = 64, 4096
#: Links that a task holds before it reduces them to a forest.
HELD_LINKS = 1_000_000


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text: 0 for no words; fewer than four words make one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        length = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(length + 1) - 1
        start = end - length
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(start[: len(words) - SHINGLE + 1].tolist(), end[SHINGLE - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, *more: str) -> DataFrame:
    """(doc_id, print): the fingerprint of each row as a signed long; then the columns ``more``."""

    @F.arrow_udf("long")
    def prints(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x.as_py()) for x in column], np.uint64).view(np.int64))

    return documents.select("doc_id", prints(F.col("text")).alias("print"), *more)


def ranges(count: int) -> int:
    """Into how many ranges the segments are dealt, for so many fingerprints."""
    g = MOST_BITS + 1
    while g < SEGMENTS and count * AGREE ** (SEGMENTS * (g - MOST_BITS) / g) > BY_CHANCE:
        g += 1
    return g


def cells(prints: DataFrame, g: int) -> DataFrame:
    """(cell, print): each fingerprint under each choice of ``g - MOST_BITS`` ranges of its embedding."""
    odd = F.lit(0x5555555555555555)
    half = F.shiftrightunsigned("print", 1)
    counts = F.col("print").bitwiseXOR(half).bitwiseAND(odd).bitwiseOR(F.shiftleft(F.col("print").bitwiseAND(half).bitwiseAND(odd), 1))
    bound = [round(i * SEGMENTS / g) for i in range(g + 1)]
    part = [sum(3 << 2 * s for s in range(bound[i], bound[i + 1])) for i in range(g)]
    masks = [sum(part[i] for i in chosen) for chosen in combinations(range(g), g - MOST_BITS)]
    keys = [F.xxhash64(F.lit(i), counts.bitwiseAND(F.lit(m - (m >> 63 << 64)))) for i, m in enumerate(masks)]
    return prints.select(F.explode(F.array(*keys)).alias("cell"), "print")


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _close(cell: np.ndarray, prints: np.ndarray, side: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a cell (cells lie together) that differ in at most MOST_BITS bits; of unlike sides if there are sides."""
    at, step = np.arange(len(cell)), 0
    while len(at):
        step += 1
        at = at[: np.searchsorted(at, len(cell) - step)]
        at = at[cell[at + step] == cell[at]]
        near = np.bitwise_count((prints[at] ^ prints[at + step]).view(np.uint64)) <= MOST_BITS
        if side is not None:
            near &= side[at] != side[at + step]
        yield prints[at[near]], prints[at[near] + step]


def _links(sides: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        rest: list[np.ndarray] | None = None

        def work(columns: list[np.ndarray]) -> None:
            nonlocal held, size
            for a, b in _close(columns[0], columns[1], columns[2] if sides else None):
                held.append((a, b))
                size += len(a)
                if size > HELD_LINKS:
                    held = [forest(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            other = np.flatnonzero(columns[0][:-1] != columns[0][1:])
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                work([c[:last] for c in columns])
            rest = [c[last:] for c in columns]
        if rest is not None:
            work(rest)
        if size:
            a, b = forest(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_LINKS)

    return find


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that join the same fingerprints as all pairs within MOST_BITS bits would.

    ``prints`` (print) has no repeated rows.
    """
    grid = cells(prints, ranges(prints.count()))
    large = common.cut(grid.groupBy("cell").count().where(F.col("count") > CELL_ROWS))
    if large.isEmpty():
        return grid.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(False), "a long, b long")
    usual = grid.join(large, "cell", "left_anti").repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(False), "a long, b long")
    blocks = F.ceil(F.col("count") / (CELL_ROWS // 2)).cast("int")
    block = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    dealt = grid.join(large, "cell").withColumn("blocks", blocks).withColumn("block", block).select("cell", "print", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    work = F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other"))
    halves = dealt.select(work.alias("cell"), "print", "block", "other")
    across = halves.where("block != other").select("cell", "print", "block").repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(True), "a long, b long")
    inside = halves.where("block = other").select("cell", "print").repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(False), "a long, b long")
    return usual.unionByName(across).unionByName(inside)


def _rooted(prints: DataFrame) -> DataFrame:
    """``prints`` (print, ...), without repeated prints, with the ``root`` of each one's group."""
    linked = common.cut(components(links(prints.select("print"))))
    return prints.join(linked.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))


def groups(documents: DataFrame) -> DataFrame:
    """(doc_id, print, component_id) for each row of ``documents``.

    Null and empty texts have the fingerprint zero and link like any other. Repeated rows each get
    a row. An empty table gives an empty result. Other columns are left out, whatever their names.
    """
    own = common.cut(fingerprints(documents.select("doc_id", "text")))
    prints = common.cut(own.groupBy("print").agg(F.min("doc_id").alias("least")))
    rooted = _rooted(prints)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("print", "component_id")
    return own.join(named, "print").select("doc_id", "print", "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each group of ``documents``: that of the least doc_id, null ids last; of rows with that id the first.

    Null and empty texts have the fingerprint zero and are a group like any other. An empty table stays
    empty. Other columns stay, whatever their names. Fingerprinting takes about 100 times a text's bytes.
    """
    rows = common.cut(documents.select(F.struct(*documents.columns).alias("row"), F.monotonically_increasing_id().alias("at")))
    own = fingerprints(rows.select("row.doc_id", "row.text", "at"), "at")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")
    prints = common.cut(own.groupBy("print").agg(F.min(place).alias("first")))
    first = _rooted(prints).groupBy("root").agg(F.min("first").alias("first")).select("first.at")
    return rows.join(first, "at", "left_semi").select(*[F.col("row")[c].alias(c) for c in documents.columns])


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
