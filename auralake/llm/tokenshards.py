"""Operator 10: token ids in compressed shards that answer access, rank, count and select.

A shard holds the ids of consecutive documents in ascending doc_id order as a wavelet matrix: the
ids that occur are numbered by value, and one bit-plane for each bit of that number, from the
highest, holds the bits of all tokens, those with a zero bit moved before those with a one bit for
the next plane. With counts of one bits at every ``BLOCK`` bits, which the file holds too, a token, the
number of occurrences of an id before a position and the place of its k-th occurrence are found in one
step a plane, from one count and one block of bits: an open file is looked into, not read. It takes as
many bits a token as there are planes, and the counts a hundredth more.

Shards are rows of a Parquet table, one file image each, written by Spark's own committing writer
into the shared folder: any store will do, and a lost executor's shard is written again. Documents
are dealt by ranges of doc_id; a task closes a shard after ``SHARD_BYTES`` of ids.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .bpe import tokenizer_path

#: Bytes of ids, at four each, after which a task closes a shard.
SHARD_BYTES = 12 << 20
MAGIC = b"WAVM0002"
#: Bits between two stored counts of one bits, and how many blocks are looked into at once.
BLOCK, BLOCKS_AT_ONCE = 4096, 1024
#: Words that a worker keeps the ids of, after which it starts anew.
CACHED = 400_000
END_ID = 2


class WaveletMatrix:
    """Ids in succinct bit-planes. ``planes`` are packed bits, highest plane first, in little bit order; ``ones`` the one bits before each block of a plane, and in all."""

    def __init__(self, length: int, alphabet: np.ndarray, planes: list[np.ndarray], ones: list[np.ndarray] | None = None):
        self.length, self.alphabet, self.planes = length, alphabet, planes
        self.ones = [self._counted(p) for p in planes] if ones is None else ones
        self.zeros = [length - int(o[-1]) for o in self.ones]

    @staticmethod
    def _counted(plane: np.ndarray) -> np.ndarray:
        counts = np.bitwise_count(plane)
        whole = np.add.reduceat(counts, np.arange(0, len(counts), BLOCK // 8), dtype=np.int64) if len(counts) else counts.astype(np.int64)
        return np.concatenate([[0], np.cumsum(whole)]).astype("<u4")

    @staticmethod
    def build(ids: np.ndarray) -> WaveletMatrix:
        seen = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        alphabet = np.flatnonzero(seen).astype(np.uint32)
        number = np.zeros(len(seen), np.uint32)
        number[alphabet] = np.arange(len(alphabet))
        x = number[ids].astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        planes = []
        for b in reversed(range(max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0)):
            bit = (x >> b) & 1 == 1
            planes.append(np.packbits(bit, bitorder="little"))
            x = np.concatenate([x[~bit], x[bit]])
        return WaveletMatrix(len(ids), alphabet, planes)

    def _rank(self, plane: int, at: np.ndarray) -> np.ndarray:
        """One bits before each position: those before its block, and in one step for all those of the block."""
        at = np.asarray(at, np.int64)
        data, out = self.planes[plane], self.ones[plane][at // BLOCK].astype(np.int64)
        if not len(data):
            return out
        for i in range(0, len(at), BLOCKS_AT_ONCE):
            some = at[i : i + BLOCKS_AT_ONCE, None]
            byte = some // BLOCK * (BLOCK // 8) + np.arange(BLOCK // 8)
            bits = data[np.minimum(byte, len(data) - 1)]
            mask = np.clip(some - 8 * byte, 0, 8)
            out[i : i + BLOCKS_AT_ONCE] += np.bitwise_count(bits & ((1 << mask) - 1).astype(np.uint8)).sum(1, dtype=np.int64)
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the positions."""
        at = np.asarray(at, np.int64)
        number = np.zeros(len(at), np.int64)
        for p, plane in enumerate(self.planes):
            bit = (plane[at // 8] >> (at % 8).astype(np.uint8)) & 1
            ones = self._rank(p, at)
            number = number << 1 | bit
            at = np.where(bit == 1, self.zeros[p] + ones, at - ones)
        return self.alphabet[number]

    def _number(self, token: int) -> int:
        place = int(np.searchsorted(self.alphabet, token))
        return place if place < len(self.alphabet) and self.alphabet[place] == token else -1

    def rank(self, token: int, at: int) -> int:
        """Occurrences of ``token`` before position ``at``."""
        number, low, high = self._number(token), 0, at
        if number < 0:
            return 0
        for p in range(len(self.planes)):
            a, b = self._rank(p, np.array([low, high])).tolist()
            one = number >> (len(self.planes) - 1 - p) & 1
            low, high = (self.zeros[p] + a, self.zeros[p] + b) if one else (low - a, high - b)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.length)

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence of ``token``, from 0; -1 if there are not so many."""
        number = self._number(token)
        if number < 0 or k < 0 or k >= self.count(token):
            return -1
        low = 0
        for p in range(len(self.planes)):
            a = int(self._rank(p, np.array([low]))[0])
            low = self.zeros[p] + a if number >> (len(self.planes) - 1 - p) & 1 else low - a
        at = low + k
        for p in reversed(range(len(self.planes))):
            one = number >> (len(self.planes) - 1 - p) & 1
            at = self._select_bit(p, at - self.zeros[p] if one else at, one)
        return at

    def _select_bit(self, plane: int, k: int, one: int) -> int:
        ones = self.ones[plane].astype(np.int64)
        bounds = ones if one else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(bounds, k, "right")) - 1
        bits = np.unpackbits(self.planes[plane][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(bounds[block])])

    def ids(self) -> np.ndarray:
        """All ids in order: the planes are undone from the lowest."""
        x = np.zeros(self.length, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for p in reversed(range(len(self.planes))):
            bit = np.unpackbits(self.planes[p], count=self.length, bitorder="little").view(bool)
            up = np.empty_like(x)
            up[~bit] = x[: self.zeros[p]]
            up[bit] = x[self.zeros[p] :]
            x = up | bit.astype(x.dtype) << (len(self.planes) - 1 - p)
        return self.alphabet[x] if len(self.alphabet) else x.astype(np.uint32)


def to_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, unnamed: int = 0) -> bytes:
    """A shard's file: magic, five little-endian counts, doc_ids, token counts, alphabet, of each plane the counts of its blocks, planes, CRC-32. The first ``unnamed`` documents have no id."""
    matrix = WaveletMatrix.build(ids)
    head = MAGIC + struct.pack("<5Q", len(doc_ids), len(ids), len(matrix.alphabet), len(matrix.planes), unnamed)
    body = [doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), matrix.alphabet.astype("<u4").tobytes(), *[o.tobytes() for o in matrix.ones], *[p.tobytes() for p in matrix.planes]]
    data = b"".join([head, *body])
    return data + struct.pack("<I", zlib.crc32(data))


def from_file(data: bytes, whole: bool = True) -> tuple[np.ndarray, np.ndarray, WaveletMatrix, int]:
    """doc_ids, token counts and the matrix of a shard's file, as views of it, and how many documents have no id; ValueError if it is damaged.

    ``whole``: the file is read through to test it; without that, no more of it is read than is asked for.
    """
    if data[:8] != MAGIC or (whole and zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]):
        raise ValueError("not a whole token shard")
    docs, length, letters, planes, unnamed = struct.unpack_from("<5Q", data, 8)
    at = 48
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    lengths = np.frombuffer(data, "<u4", docs, at + 8 * docs)
    alphabet = np.frombuffer(data, "<u4", letters, at + 12 * docs)
    at += 12 * docs + 4 * letters
    size, blocks = (length + 7) // 8, -(-length // BLOCK) + 1
    ones = [np.frombuffer(data, "<u4", blocks, at + 4 * p * blocks) for p in range(planes)]
    at += 4 * planes * blocks
    return doc_ids, lengths, WaveletMatrix(length, alphabet, [np.frombuffer(data, np.uint8, size, at + p * size) for p in range(planes)], ones), unnamed


#: ASCII punctuation that ends a word and can be part of no contraction and no special token.
_TAIL = b"!\"#$%&()*+,-./:;=?@[]^_`{}~"
_SIMPLE = re.compile(rb"[A-Za-z\x80-\xff]+")


class Encoder:
    """Ids of whole texts through the tokenizers library, which sees each different word once.

    Words are known by their 64-bit fingerprints, and the ids of a batch are gathered at once.

    The vocabulary's normaliser and pattern join nothing across ASCII white space, so a text's ids
    are those of its words in turn. Nor do they join a letter and the punctuation after it: a word
    is looked up as its letters, in lower case, and its tail. Words of letters alone are one
    pre-token each, whose last token is marked as a word's end, and go to the library many at a time.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.end_id = end_id
        self.parts: dict[bytes, bytes] = {b"": b""}
        self._forget()

    def _forget(self) -> None:
        """Known words: sorted fingerprints, and where the ids of each lie in the store. The last entry is no word's."""
        self.keys, self.start, self.size = np.array([2**64 - 1], np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.store = np.array([self.end_id], "<u4")

    def _learn(self, parts: set[bytes]) -> None:
        """Ids of whole words and of parts of words."""
        text = {p: p.decode() for p in parts if p not in self.parts}
        plain = [p for p, t in text.items() if _SIMPLE.fullmatch(p) and t.lower().isalpha()]
        for at in range(0, len(plain), 50_000):
            some = plain[at : at + 50_000]
            ids = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([" ".join([text[p] for p in some[i : i + 500]]) for i in range(0, len(some), 500)], add_special_tokens=False)]
            flat = np.concatenate(ids)
            end = np.flatnonzero(self.closes[flat]) + 1
            if len(end) == len(some):
                data, bounds = flat.tobytes(), (4 * np.concatenate([[0], end])).tolist()
                self.parts.update((p, data[a:b]) for p, a, b in zip(some, bounds, bounds[1:], strict=False))
        rest = [p for p in text if p not in self.parts]
        for p, e in zip(rest, self.tokenizer.encode_batch_fast([text[p] for p in rest], add_special_tokens=False), strict=True):
            self.parts[p] = np.array(e.ids, "<u4").tobytes()

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words."""
        pairs = []
        for w in words:
            head = w.rstrip(_TAIL)
            simple = _SIMPLE.fullmatch(head) and (head.isascii() or head.decode().lower().isalpha())
            pairs.append((head.lower(), w[len(head) :]) if simple else (w, b""))
        if len(self.parts) > CACHED:
            self.parts = {b"": b""}
        self._learn({p for pair in pairs for p in pair})
        parts = self.parts
        return [parts[a] + parts[b] for a, b in pairs]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, each closed by the end id, and how many each text has."""
        words = common.scan(texts)
        prints, first, back = np.unique(words.prints(), return_index=True, return_inverse=True)
        if len(self.keys) > CACHED:
            self._forget()
        at = np.searchsorted(self.keys, prints)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != prints)
        if len(new):
            data = words.data.tobytes()
            found = self._ids_of([data[a:b] for a, b in zip(words.start[first[new]].tolist(), words.end[first[new]].tolist(), strict=True)])
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            keys = np.concatenate([self.keys, prints[new]])
            order = np.argsort(keys, kind="stable")
            self.start = np.concatenate([self.start, len(self.store) + np.cumsum(size) - size])[order]
            self.size = np.concatenate([self.size, size])[order]
            self.store = np.concatenate([self.store, np.frombuffer(b"".join(found), "<u4")])
            self.keys = keys[order]
            at = np.searchsorted(self.keys, prints)
        bounds = words.first + np.arange(len(words.first))
        start, size = np.zeros(bounds[-1], np.int64), np.ones(bounds[-1], np.int64)  # the end id is the store's first
        inside = np.ones(len(start), bool)
        inside[bounds[1:] - 1] = False
        start[inside], size[inside] = self.start[at][back], self.size[at][back]
        to = np.concatenate([[0], np.cumsum(size)])
        ids = self.store[np.repeat(start - to[:-1], size) + np.arange(to[-1])]
        return ids, to[bounds[1:]] - to[bounds[:-1]]


@lru_cache(1)
def encoder(path: str, end_id: int) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, end_id)


_SHARDS = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("n_tokens", pa.int64()), ("file", pa.binary())])


def write_shards(documents: DataFrame, path: str, folder: str, end_id: int = END_ID) -> None:
    """Writes ``documents`` (doc_id, text) as shards to ``folder``, each document closed by ``end_id``, those without an id first."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(path, end_id), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = number = unnamed = 0

        def closed() -> pa.RecordBatch:
            docs, ids, lengths = map(np.concatenate, zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([to_file(docs, lengths, ids, unnamed)], pa.binary())], schema=_SHARDS)

        for piece in common.pieces(batches, most=common.CODING_BYTES):
            ids, lengths = own.encode(piece.column("text"))
            held.append((pc.fill_null(piece.column("doc_id").cast(pa.int64()), 0).to_numpy(), ids, lengths))
            unnamed += piece.column("doc_id").null_count
            size += 4 * len(ids)
            if size >= SHARD_BYTES:
                yield closed()
                held.clear()
                size, number, unnamed = 0, number + 1, 0
        if held:
            yield closed()

    rows = documents.select("doc_id", "text")
    partitions = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(shards, "part int, number int, n_tokens long, file binary").write.option("parquet.block.size", 32 << 20).option("compression", "zstd").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the shards' files alone."""
    shards = spark.read.schema("part int, number int, n_tokens long, file binary").parquet(folder)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, lengths, matrix, unnamed = from_file(batch.column("file")[i].as_py())
                data = memoryview(np.ascontiguousarray(matrix.ids(), "<u4").view(np.uint8))
                bounds = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column("part")[i].as_py(), np.int32)), pa.array(np.full(n, batch.column("number")[i].as_py(), np.int32)), pa.array(doc_ids, mask=np.arange(n) < unnamed), pa.array(bounds[:-1]), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["part", "number", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    # One row a shard: sums of each range first, so that only one row a range is put in order at once.
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    sizes = shards.select("part", "number", "n_tokens")
    ranges = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("range_start"))
    starts = sizes.join(ranges, "part").select("part", "number", (F.col("range_start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("shard_start"))
    rows = shards.mapInArrow(documents, "part int, number int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "number"]).select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_shards(documents: DataFrame, path: str) -> DataFrame:
    """Writes the shards of ``documents`` into the shared folder and reads each document's ids back.

    Null and empty texts are the end id alone. Rows without a doc_id come before all others; repeated rows,
    and those, each get a row, in the order in which they come. An empty table gives an empty result. Other
    columns are left out, whatever their names. A text is encoded whole, which takes about 60 times its bytes;
    a task holds a shard's ids besides.
    """
    folder = f"{common.shared_folder(documents.sparkSession)}/token-shards-{uuid.uuid4().hex}"
    write_shards(documents, path, folder)
    return read_shards(documents.sparkSession, folder)


def op10_token_shards(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return token_shards(common.read(spark, sf_dir, "documents"), path or tokenizer_path("word_bpe_49k.json"))
