"""Operator 11: exact duplicates by an extendible-hash index on shared files.

A text's key is a hash of 64 bits. The directory has a slot for each value of the key's first bits,
and each slot names a bucket; a bucket that would hold more bytes of text than ``capacity`` is split
by one more bit, and if it already has as many bits as the directory, that doubles first. The files
of the index are the directories and the buckets of each insertion, as Parquet in one shared folder:
an insertion writes the buckets that it touches anew and then a directory that points to them, so
what fails in between leaves the index as it was.

The keys of an insertion are dealt by range to owner tasks, which read them in order with what the
touched buckets hold. Texts of one key are compared byte by byte: equal ones become one entry, others
chain behind it. Copies are gathered before they are dealt out, in each batch; those of a key with very
many rows in a second step too, over the square root of as many tasks. So an owner meets few rows of
any key, whatever the number of copies. Later steps read ids and keys, and texts only of chained keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of text of a bucket; more where an index would else have more than 2**MOST_BITS buckets.
CAPACITY, MOST_BITS = 8 << 20, 18
#: Rows of a key from which they are gathered in a second step.
HOT = 1000
#: Rows of a table up to which it is sent to all executors.
SMALL = 100_000
#: Bytes of texts that an owner gives out at once.
HELD_BYTES = 4 << 20

Key = Callable[[Column], Column]


def normalised(text: str = "text") -> Column:
    """The text with each run of white space as one space; null as empty. A single space is left where it is."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


@dataclass
class Directory:
    """Which bucket has the keys that begin with some bits: ``slots`` of ``2**depth``; of each bucket its own bits and their number."""

    depth: int = 0
    slots: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    prefixes: list[int] = field(default_factory=lambda: [0])
    depths: list[int] = field(default_factory=lambda: [0])

    @staticmethod
    def of(prefixes: list[int], depths: list[int]) -> Directory:
        depth = max(depths)
        slots = np.zeros(1 << depth, np.int32)
        for bucket, (p, d) in enumerate(zip(prefixes, depths, strict=True)):
            slots[p << depth - d : p + 1 << depth - d] = bucket
        return Directory(depth, slots, prefixes, depths)

    def split(self, bucket: int) -> None:
        """The upper half of the bucket's keys go to a new bucket, if need be after doubling."""
        if self.depths[bucket] == self.depth:
            self.slots, self.depth = np.repeat(self.slots, 2), self.depth + 1
        self.depths[bucket] += 1
        self.prefixes[bucket] *= 2
        self.depths.append(self.depths[bucket])
        self.prefixes.append(self.prefixes[bucket] + 1)
        free = self.depth - self.depths[-1]
        self.slots[self.prefixes[-1] << free : self.prefixes[-1] + 1 << free] = len(self.depths) - 1

    def grow(self, cells: np.ndarray, capacity: int) -> set[int]:
        """Splits overfull buckets, ``cells`` being the load of each value of a key's first bits; gives the buckets that have changed.

        A bucket of one cell stays whole, however full: its keys chain.
        """
        bits, total = len(cells).bit_length() - 1, np.concatenate([[0], np.cumsum(cells)])
        load = lambda b: total[self.prefixes[b] + 1 << bits - self.depths[b]] - total[self.prefixes[b] << bits - self.depths[b]]
        changed, todo = set(), list(range(len(self.depths)))
        while todo:
            bucket = todo.pop()
            if self.depths[bucket] < bits and load(bucket) > capacity:
                self.split(bucket)
                changed |= {bucket, len(self.depths) - 1}
                todo += [bucket, len(self.depths) - 1]
        return changed

    def buckets(self, keys: np.ndarray) -> np.ndarray:
        """The bucket of each key, a signed long whose bits count as they are."""
        return self.slots[keys.view(np.uint64) >> np.uint64(64 - self.depth)] if self.depth else np.zeros(len(keys), np.int32)


_ENTRY = "key long, chain int, links int, text string, least {id}, n long"
_GIVEN = ("key", "chain", "text", "least", "n")


def _lesser(a, b):
    return b if a is None or (b is not None and b < a) else a


def _added(chain: list[list], old: int, text: bytes, least, n: int) -> None:
    """A row to the chain of its key: [place in the stored chain or -1, text, least id, rows]."""
    for link in chain:
        if link[1] == text:
            link[0], link[2], link[3] = max(link[0], old), _lesser(link[2], least), link[3] + n
            return
    chain.append([old, text, least, n])


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of equal keys."""
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], cut]), np.append(cut, len(keys))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, chain, text, least, n) with the equal texts of a batch in one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        start, end = _groups(keys[order])
        alone = end - start == 1
        yield batch.take(pa.array(np.sort(order[start[alone]])))
        rows = []
        for a, b in zip(start[~alone].tolist(), end[~alone].tolist(), strict=True):
            chain: list[list] = []
            for i in order[a:b].tolist():
                _added(chain, batch.column("chain")[i].as_py(), batch.column("text")[i].as_buffer().to_pybytes(), batch.column("least")[i].as_py(), batch.column("n")[i].as_py())
            rows += [(int(keys[order[a]]), *link) for link in chain]
        if rows:
            yield _batch(batch.schema, [[r[i] for r in rows] for i in range(5)])


def _batch(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    """Columns as written in the schema; texts come as bytes."""
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()).cast(f.type) if f.name == "text" else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (key, chain, links, text, least, n) of rows (key, chain, text, least, n) in the order of keys.

    A row that is alone with its key goes through as it is. Of the rows of other keys the chain is held,
    one of each different text. Stored links keep their places; new ones follow in the order of their texts.
    """
    key, chain, held, size, schema = None, [], [], 0, None

    def closed() -> None:
        nonlocal size
        chain.sort(key=lambda x: (x[0] < 0, x[0], x[1]))
        for place, (_, text, least, n) in enumerate(chain):
            held.append((key, place, len(chain), text, least, n))
            size += len(text) + 100
        chain.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        if schema is None:
            names = ["key", "chain", "links", "text", "least", "n"]
            schema = pa.schema([pa.field("links", pa.int32()) if c == "links" else batch.schema.field(c) for c in names])
        keys = batch.column("key").to_numpy()
        start, end = _groups(keys)
        alone = end - start == 1
        alone[[0, -1]] = False
        own = batch.take(pa.array(start[alone]))
        if own.num_rows:
            zero = np.zeros(own.num_rows, np.int32)
            yield pa.RecordBatch.from_arrays([own.column("key"), pa.array(zero), pa.array(zero + 1), own.column("text"), own.column("least"), own.column("n")], schema=schema)
        for a, b in zip(start[~alone].tolist(), end[~alone].tolist(), strict=True):
            if keys[a] != key:
                closed()
                key = int(keys[a])
            for i in range(a, b):
                _added(chain, batch.column("chain")[i].as_py(), batch.column("text")[i].as_buffer().to_pybytes(), batch.column("least")[i].as_py(), batch.column("n")[i].as_py())
            if size > HELD_BYTES:
                yield _batch(schema, [[r[i] for r in held] for i in range(6)])
                held.clear()
                size = 0
    closed()
    if held:
        yield _batch(schema, [[r[i] for r in held] for i in range(6)])


class HashIndex:
    """An index of different texts in ``folder``, which all executors share; an empty one if there is none yet.

    An entry has a text, the least id and the number of the rows that have had it, and its place among
    those of its key. Ids are of one type, ``id_type``; null ids come last.
    """

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "long", capacity: int = CAPACITY, key: Key = F.xxhash64):
        self.spark, self.folder, self.id_type, self.capacity, self.key = spark, folder, id_type, capacity, key
        self.directory, self.versions = Directory(), [-1]
        self.version = -1
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [int(s.getPath().getParent().getName().rpartition("-")[2]) for s in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/directory-*/_SUCCESS")) or ()]
        if done:
            self.version = max(done)
            rows = sorted(spark.read.parquet(f"{folder}/directory-{self.version}").collect())
            self.directory = Directory.of([r.prefix for r in rows], [r.depth for r in rows])
            self.versions = [r.version for r in rows]

    def entries(self, buckets: set[int] | None = None) -> DataFrame:
        """(bucket, key, chain, links, text, least, n, sha256, size) of all buckets or of some, which are few enough for the driver."""
        shape = f"{_ENTRY.format(id=self.id_type)}, sha256 string, size long, bucket int"
        frames = []
        for version in sorted({v for v in self.versions if v >= 0}):
            here = [(b,) for b, v in enumerate(self.versions) if v == version and (buckets is None or b in buckets)]
            frames.append(self.spark.read.schema(shape).parquet(f"{self.folder}/entries-{version}").join(F.broadcast(self.spark.createDataFrame(here, "bucket int")), "bucket", "left_semi"))
        out = frames[0] if frames else self.spark.createDataFrame([], shape)
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    def insert(self, rows: DataFrame, keys: DataFrame) -> None:
        """Adds ``rows`` (least, text), texts being normalised; ``keys`` (key, size) has the keys of the same rows and their bytes, and is read several times."""
        total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first().size
        stored = self.entries().select("key", "size")
        total += stored.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first().size if self.version >= 0 else 0
        capacity = max(self.capacity, total >> MOST_BITS)
        bits = min(MOST_BITS, max(4, (total // capacity).bit_length() + 4, self.directory.depth))
        cell = F.shiftrightunsigned("key", 64 - bits).alias("cell")
        counts = keys.groupBy("key").agg(F.max("size").alias("size"), F.count("*").alias("rows"))
        hot = common.cut(counts.where(F.col("rows") > HOT).select("key", F.ceil(F.sqrt(F.col("rows") / 64)).cast("int").alias("deals")))
        cells, new = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, bool)
        for r in counts.groupBy(cell).agg(F.sum(F.col("size")).alias("size")).collect():  # at most 2**MOST_BITS rows
            cells[r["cell"]], new[r["cell"]] = r["size"] + 1, True
        if self.version >= 0:
            for r in stored.groupBy(cell).agg(F.sum("size").alias("size")).collect():
                cells[r["cell"]] += r["size"]
        before = len(self.versions)
        changed = self.directory.grow(cells, capacity)
        touched = changed | set(np.unique(self.directory.slots[np.flatnonzero(new) >> bits - self.directory.depth]).tolist())
        version = self.version + 1
        entry = rows.select(self.key(F.col("text")).alias("key"), F.lit(-1).alias("chain"), "text", "least", F.lit(1).cast("long").alias("n"))
        given = f"key long, chain int, text string, least {self.id_type}, n long"
        if hot.isEmpty():
            incoming = entry.mapInArrow(gathered, given)
        else:
            few = F.broadcast(hot) if hot.count() <= SMALL else hot
            usual = entry.join(few, "key", "left_anti").mapInArrow(gathered, given)
            copies = entry.join(few.select("key"), "key", "left_semi").mapInArrow(gathered, given).withColumn("part", F.spark_partition_id())
            dealt = copies.join(few, "key").withColumn("deal", F.pmod(F.xxhash64("part"), F.col("deals")))
            met = dealt.repartition("key", "deal").sortWithinPartitions("key").select(*_GIVEN).mapInArrow(owned, _ENTRY.format(id=self.id_type))
            incoming = usual.unionByName(met.select("key", F.lit(-1).alias("chain"), "text", "least", "n"))
        if self.version >= 0:
            # Of a bucket that is split, one half keeps the number, under which all of it is stored.
            incoming = incoming.unionByName(self.entries({b for b in touched if b < before}).select(*_GIVEN))
        tasks = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        # The key's first 31 bits as a share of the tasks: each owner has a range of keys, in the order of buckets.
        owner = F.shiftright(F.shiftrightunsigned("key", 33) * F.lit(tasks), 31).cast("int")
        ordered = incoming.repartitionById(tasks, owner).sortWithinPartitions(F.shiftrightunsigned("key", 32), "key")
        directory = Directory(self.directory.depth, self.directory.slots, [], [])

        def in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in owned(batches):
                yield batch.append_column("bucket", pa.array(directory.buckets(batch.column("key").to_numpy())))

        entries = ordered.select(*_GIVEN).mapInArrow(in_buckets, f"{_ENTRY.format(id=self.id_type)}, bucket int")
        sized = entries.withColumn("sha256", F.sha2("text", 256)).withColumn("size", F.octet_length("text").cast("long"))
        sized.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.folder}/entries-{version}")
        self.versions = [version if b in touched else v for b, v in enumerate([*self.versions, *[version] * (len(self.directory.depths) - before)])]
        listed = [(b, int(p), d, v) for b, (p, d, v) in enumerate(zip(self.directory.prefixes, self.directory.depths, self.versions, strict=True))]
        self.spark.createDataFrame(listed, "bucket int, prefix long, depth int, version int").coalesce(1).write.parquet(f"{self.folder}/directory-{version}")
        self.version = version

    def found(self, keys: DataFrame, texts: DataFrame) -> DataFrame:
        """(id, least, n, sha256, first) of rows that the index holds: their texts' entries, and whether a row is the first with the least id.

        ``keys`` (key, at, id) has all rows; ``texts`` (key, at, id, text) are the same, of which only those
        are used whose keys chain: they are compared with each text of their key.
        """
        known = self.entries()
        place = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at"))

        def told(rows: DataFrame, entries: DataFrame, by: list[str]) -> DataFrame:
            first = rows.groupBy(*by).agg(place.alias("f")).select(*by, F.col("f.at").alias("first"))
            return rows.join(entries.join(first, by), by).select("id", "least", "n", "sha256", (F.col("at") == F.col("first")).alias("first"))

        out = told(keys.select("key", "at", "id"), known.where("links = 1").select("key", "least", "n", "sha256"), ["key"])
        chained = common.cut(known.where("links > 1").select("key").distinct())
        if chained.isEmpty():
            return out
        few = F.broadcast(chained) if chained.count() <= SMALL else chained
        links = known.join(few, "key", "left_semi").select("key", "chain", "text", "least", "n", "sha256")
        compared = texts.join(few, "key", "left_semi").join(links.select("key", "chain", F.col("text").alias("own")), "key").where(F.col("text") == F.col("own"))
        return out.unionByName(told(common.cut(compared.select("key", "chain", "at", "id")), links, ["key", "chain"]))

    def look_up(self, documents: DataFrame) -> DataFrame:
        """(doc_id, least, n) for each row of ``documents`` (doc_id, text): the id and number of rows of its text in the index, null if it has none."""
        rows = documents.select("doc_id", normalised().alias("text")).withColumn("key", self.key(F.col("text")))
        known = self.entries().select("key", F.col("text").alias("own"), "least", "n")
        return rows.join(known, (rows["key"] == known["key"]) & (rows["text"] == known["own"]), "left").select("doc_id", "least", "n")


def duplicates(documents: DataFrame, folder: str | None = None, capacity: int = CAPACITY, key: Key = F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of ``documents`` (doc_id, text).

    Texts are equal if they are so after each run of white space has become a space; null counts as
    empty. Of equal texts that of the least doc_id stays, null ids last, and of rows with that id the
    first. An empty table gives an empty result; other columns are left out, whatever their names.
    The index of these rows is left in ``folder``, one of its own in the shared folder if none is named.
    A task holds a batch's texts, and of an owner's key the different ones.
    """
    spark = documents.sparkSession
    id_type = documents.schema["doc_id"].dataType.simpleString()
    text = normalised()
    rows = documents.select("doc_id", text.alias("text"))
    keyed = rows.select("doc_id", key(F.col("text")).alias("key"), F.octet_length("text").cast("long").alias("size"))
    own = common.stored(keyed.withColumn("at", F.monotonically_increasing_id()).withColumnRenamed("doc_id", "id"))
    index = HashIndex(spark, folder or f"{common.shared_folder(spark)}/hash-index-{uuid.uuid4().hex}", id_type, capacity, key)
    index.insert(rows.withColumnRenamed("doc_id", "least"), own.select("key", "size"))
    texts = rows.select(F.col("doc_id").alias("id"), "text", key(F.col("text")).alias("key"), F.monotonically_increasing_id().alias("at"))
    found = index.found(own, texts)
    return found.select(F.col("id").alias("doc_id"), F.col("least").alias("keep_id"), F.col("n").alias("group_size"), F.col("first").alias("kept"), F.col("sha256").alias("text_sha256"))


def op11_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(common.read(spark, sf_dir, "documents"))


SQL = r"""
WITH given AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
equal AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM given GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM given JOIN equal USING (t)
"""
