"""Operator 13: documents drawn by importance for a target distribution, by hashed n-grams.

A task numbers the words of a piece of its partition, and sorts the suffixes of the word ids as far
as the longest n-gram: a suffix array, cut off at each document's end. The length of the longest
common prefix of neighbours tells where runs begin: suffixes that agree in ``n`` words or more lie
together, so each run of them is one n-gram with all its occurrences. An n-gram is hashed once a run,
from the CRCs of its words, and its bucket goes back to the positions of the run: counts take a
bucket and the length of its run, scores add up the gains at the positions of a document.

Counts of ``buckets`` buckets leave a task; the gains, one number a bucket, go out with the scoring.
Draws are ranks of noisy scores: rows are put in order by range, so no task ranks all of them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import numbered
from . import common

BUCKETS, NGRAM, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42

#: Bytes that are in no word: ASCII but for digits and lower-case letters, to which A-Z are turned first.
_APART = np.zeros(256, bool)
_APART[:0x80] = True
_APART[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = False


class Shifts:
    """CRC-32 of joined texts from those of their parts: the first one's CRC is moved on by the length of the second.

    Moving on is linear, so it is four look-ups by byte; there are tables for the lengths below 64 and for powers of two above.
    """

    def __init__(self):
        byte = np.arange(256, dtype=np.uint32)
        step = byte.copy()
        for _ in range(8):
            step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
        now = np.stack([byte << np.uint32(8 * p) for p in range(4)])
        short = [now]
        for _ in range(64):
            now = step[now & 0xFF] ^ (now >> np.uint32(8))
            short.append(now)
        self.short = np.concatenate(short[:64]).ravel()
        self.long = [short[64]]
        while len(self.long) < 26:
            self.long.append(self._by(self.long[-1].ravel(), self.long[-1], 0))

    @staticmethod
    def _by(table: np.ndarray, crc: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        return table[at + (crc & 0xFF)] ^ table[at + 256 + (crc >> np.uint32(8) & 0xFF)] ^ table[at + 512 + (crc >> np.uint32(16) & 0xFF)] ^ table[at + 768 + (crc >> np.uint32(24))]

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = self._by(self.short, crc, (length & 63) << 10)
        for k in range(int(length.max(initial=0) >> 6).bit_length()):
            some = np.flatnonzero(length >> (6 + k) & 1)
            out[some] = self._by(self.long[k].ravel(), out[some], 0)
        return out


SHIFTS = Shifts()


@dataclass
class Runs:
    """The n-grams of some texts. For each n from 1: the runs' buckets and lengths, and each position's bucket or -1."""

    words: np.ndarray
    first: np.ndarray
    buckets: list[np.ndarray]
    lengths: list[np.ndarray]
    at: list[np.ndarray]


def suffixes(ids: np.ndarray, left: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of the next ``n`` ids, which end after ``left`` of them, and the longest common prefix of each with the one before, up to ``n``.

    ``ids`` begin with 1. As many ids as fit go into one key of 64 bits; if there are more, keys are numbered in between.
    """
    following = [ids, *[np.where(left > k, np.concatenate([ids[k:], np.zeros(min(k, len(ids)), ids.dtype)]), 0) for k in range(1, n)]]
    bits = max(1, int(ids.max(initial=0)).bit_length())
    key, width = ids.astype(np.uint64), bits
    for more in following[1:]:
        if width + bits > 64:
            distinct, key = np.unique(key, return_inverse=True)
            key, width = key.astype(np.uint64), max(1, len(distinct).bit_length())
        key, width = key << np.uint64(bits) | more.astype(np.uint64), width + bits
    order = np.argsort(key, kind="stable")
    common_prefix = np.zeros(len(ids), np.int64)
    same = np.ones(max(0, len(ids) - 1), bool)
    for own in following:
        sorted_ids = own[order]
        same = same & (sorted_ids[1:] == sorted_ids[:-1]) & (sorted_ids[1:] > 0)
        common_prefix[1:] += same
    return order, common_prefix


def runs(column: pa.Array, n: int = NGRAM, buckets: int = BUCKETS) -> Runs:
    """The runs of 1 to ``n`` words of the texts."""
    words = common.scan(column, lower=True, apart=_APART)
    counts = words.counts
    distinct, sample, ids = np.unique(words.prints(), return_index=True, return_inverse=True)
    raw = words.data.tobytes()
    texts = [raw[a:b] for a, b in zip(words.start[sample].tolist(), words.end[sample].tolist(), strict=True)]
    alone = np.array([zlib.crc32(t) for t in texts], np.uint32)
    after = np.array([zlib.crc32(b" " + t) for t in texts], np.uint32)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    left = np.repeat(words.first[1:], counts) - np.arange(len(ids))
    order, common_prefix = suffixes(ids + 1, left, n)
    out = Runs(counts, words.first, [], [], [])
    crc = np.zeros(len(ids), np.uint32)
    for k in range(1, n + 1):
        begin = np.flatnonzero(common_prefix < k)
        head = order[begin]
        whole = left[head] >= k
        now = head[whole]
        last = ids[now + k - 1]
        crc[now] = alone[last] if k == 1 else SHIFTS(crc[now], size[last]) ^ after[last]
        bucket = np.full(len(begin), -1, np.int64)
        bucket[whole] = crc[now] % np.uint32(buckets)
        length = np.diff(np.append(begin, len(ids)))
        at = np.empty(len(ids), np.int64)
        at[order] = np.repeat(bucket, length)
        if k < n:  # a longer n-gram's run begins where one of these does or inside it
            crc[order] = np.repeat(crc[head], length)
        out.buckets.append(bucket[whole])
        out.lengths.append(length[whole])
        out.at.append(at)
    return out


def bucket_counts(texts: DataFrame, n: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): occurrences of 1 to ``n`` words in the column ``text`` by bucket; a task adds up its own first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for piece in common.pieces(batches):
            found = runs(piece.column("text"), n, buckets)
            for own, length in zip(found.buckets, found.lengths, strict=True):
                total += np.bincount(own, length, buckets).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target to that in the corpus.

    Both count tables have at most ``buckets`` rows, which come to the driver.
    """
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, table in ((s, corpus), (t, target)):
        for row in table.collect():
            counts[row["bucket"]] = row["n"]
    all_s, all_t = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighted(documents: DataFrame, gain: np.ndarray, n: int = NGRAM) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of the gains of all features of each row's text."""

    @F.arrow_udf("struct<n_words: long, n_features: long, weight: long>")
    def add(column: pa.Array) -> pa.Array:
        rows = []
        for piece in common.pieces([pa.RecordBatch.from_arrays([column.cast(pa.string())], names=["text"])]):
            found = runs(piece.column(0), n, len(gain))
            total = np.zeros(len(found.at[0]) + 1, np.int64)
            total[1:] = np.cumsum(sum(np.where(at >= 0, gain[at], 0) for at in found.at))
            features = sum(np.maximum(0, found.words - k) for k in range(n))
            rows.append((found.words, features, total[found.first[1:]] - total[found.first[:-1]]))
        columns = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 3
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n_words", "n_features", "weight"])

    return documents.select("doc_id", add(F.col("text")).alias("_sum")).select("doc_id", "_sum.*")


def resampled(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, n: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for each row of ``documents`` (doc_id, text), drawn to be like the texts of ``target`` (text).

    ``score`` is the weight with Gumbel noise that the row's id and the seed tell, so the highest
    scores are a draw without replacement in proportion to the exponential of the weights. Of N rows
    with ``least_words`` or more, ``percent`` of a hundred have a rank: ties go to the smaller doc_id,
    a null one last, then in any order. Null and empty texts have no features. A null id has the
    noise of an empty one; repeated rows each get a row; an empty table gives an empty result, and an
    empty target gives gains all the same; other columns are left out, whatever their names. Texts
    are worked on whole, which takes about 80 times their bytes.
    """
    gain = gains(bucket_counts(documents, n, buckets), bucket_counts(target, n, buckets), buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    noise = F.floor(-1000 * F.log(-F.log(uniform)))
    rows = weighted(documents, gain, n).withColumn("score", F.col("weight") + noise).withColumn("able", F.col("n_words") >= least_words)
    scored = common.cut(rows.withColumn("none", F.col("doc_id").isNull()).withColumn("low", -F.col("score")).withColumn("at", F.monotonically_increasing_id()))
    drawn = scored.where("able").count() * percent // 100
    placed = numbered(scored, ["able"], ["low", "none", "doc_id", "at"], "place")
    rank = F.when(F.col("able") & (F.col("place") < drawn), (F.col("place") + 1).cast("long"))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def op13_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampled(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")
