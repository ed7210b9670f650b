"""Operator 4: documents packed into training sequences of several permitted lengths, best fit.

A document costs its words plus one end token; one that is longer than the largest length is cut
into pieces of that length and a rest. Pieces are dealt by hash into shards of about ``SHARD_PIECES``
pieces, and each shard is packed on its own, longest piece first: a piece goes into the open bin with
the least room that still holds it. If none does, a bin is opened. Each permitted length that holds
the piece is costed by what it would come to hold: the piece and, again and again, the longest piece
still to be packed that fits. The length whose price is least for each of these tokens is opened. A
price has a part that grows with the square of the length, as attention does, so a short bin is the
cheaper one where the pieces that are left fill it, and a long one where they don't. At the end each
bin shrinks to the cheapest permitted length that holds its contents.

The lengths are chosen jointly for a shard: it is packed under each selection of permitted lengths
that has the largest, and the cheapest packing counts, so it is never dearer than with one length
alone. What a shard loses against one packing of everything is at most its last bins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITIES = (512, 1024, 2048, 4096)
SHARD_PIECES = 50_000
#: Tokens that starting a sequence costs besides its length, and the length at which attention costs as much as all else.
OPENING, ATTENTION = 16, 6144


_PIECE = "doc_id long, piece long, start_word long, n_tokens long, bin_id long, bin_offset long, bin_capacity long"


def cost(capacity: int) -> float:
    """The cost of a bin in tokens: its length with padding, attention over it, and a fixed share for a sequence."""
    return OPENING + capacity + capacity * capacity / ATTENTION


def _packed(lengths: np.ndarray, order: list[int], sizes: list[int], price: Callable[[int], float]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """For each length its bin and offset, and how full each bin is, with bins of ``sizes``."""
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    to_come = np.bincount(lengths, minlength=sizes[-1] + 1).tolist()
    present = sum(1 << n for n, k in enumerate(to_come) if k and n)  # bit n is set if a piece of n tokens is still to be packed
    fill: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
    rooms = 0  # bit r is set if a bin has room r

    def held(capacity: int, n: int) -> int:
        """What a bin that is opened for n tokens would come to hold."""
        room, left = capacity - n, present
        while room and (fits := left & ((2 << room) - 1)):
            longest = fits.bit_length() - 1
            room -= longest * min(to_come[longest], room // longest)
            left ^= 1 << longest
        return capacity - room

    for i in order:
        n = int(lengths[i])
        to_come[n] -= 1
        if not to_come[n]:
            present ^= 1 << n
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room = min((c for c in sizes if c >= n), key=lambda c: (price(c) / held(c, n), c))
            b = len(fill)
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += n
        with_room[room - n].append(b)
        rooms |= 1 << room - n
    return bin_of, offset, fill


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, price: Callable[[int], float] = cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length its bin and offset, and the capacity of each bin. Lengths are positive, none is over the largest capacity.

    Equal lengths are taken in the given order and equal costs in the order of the selections, so the
    same input gives the same bins.
    """
    lengths = np.asarray(lengths, np.int64)
    sizes = sorted(set(capacities))
    order = np.argsort(-lengths, kind="stable").tolist()
    best = None
    for count in range(len(sizes)):
        for some in combinations(sizes[:-1], count):
            bin_of, offset, fill = _packed(lengths, order, [*some, sizes[-1]], price)
            shrunk = [min((c for c in sizes if f <= c), key=lambda c: (price(c), c)) for f in fill]
            total = sum(map(price, shrunk))
            if best is None or total < best[0]:
                best = (total, bin_of, offset, np.array(shrunk, np.int64))
    return best[1:]


def pieces(documents: DataFrame, largest: int = CAPACITIES[-1], *more: str) -> DataFrame:
    """(doc_id, piece, start_word, n_tokens), then the columns ``more``; the end token lies in a document's last piece."""
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1
    counted = documents.select("doc_id", tokens.cast("long").alias("tokens"), *more)
    each = counted.select("doc_id", *more, "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("tokens") / largest) - 1)).alias("piece"))
    return each.select("doc_id", "piece", (F.col("piece") * largest).alias("start_word"), F.least(F.lit(largest), F.col("tokens") - F.col("piece") * largest).alias("n_tokens"), *more)


def best_fit(documents: DataFrame, capacities: Sequence[int] = CAPACITIES) -> DataFrame:
    """(doc_id, piece, start_word, n_tokens, bin_id, bin_offset, bin_capacity) for each piece of each row.

    Null and empty texts are one end token. Rows with the same doc_id, or with none, are packed each on
    its own, and dealt out like any other. An empty table gives an empty result. Other columns are left
    out, whatever their names. Words are counted in the row, without a copy of its text; a task packs a shard's lengths.
    """
    rows = common.cut(pieces(documents.select("doc_id", "text", F.monotonically_increasing_id().alias("_at")), max(capacities), "_at"))
    shards = max(1, -(-rows.count() // SHARD_PIECES))

    def shard(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "n_tokens", "_at"], kind="stable").reset_index(drop=True)
        bins, offset, size = pack(frame["n_tokens"].to_numpy(), capacities)
        return frame.assign(bin_id=frame["shard"].astype("int64") * (1 << 32) + bins, bin_offset=offset, bin_capacity=size[bins]).drop(columns=["shard", "_at"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("_at", "piece"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(shard, _PIECE)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text in its pieces, found in one scan of it."""
    schema = pa.schema([*[(c.split()[0], pa.int64()) for c in _PIECE.split(", ")], ("text", pa.string())])
    for piece in common.pieces(batches):
        words = common.scan(piece.column("text"))
        lists = piece.column("pieces")
        owner = np.repeat(np.arange(piece.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        rows = lists.flatten()
        start, tokens = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("start_word", "n_tokens"))
        data, first, last = words.data.tobytes(), words.first[owner], words.first[owner + 1]
        at = np.append(words.start, len(data))
        begin = np.where(start == 0, words.bounds[owner], np.where(first + start < last, at[np.minimum(first + start, len(at) - 1)], words.bounds[owner + 1]))
        end = np.where(first + start + tokens < last, at[np.minimum(first + start + tokens, len(at) - 1)], words.bounds[owner + 1])
        texts = pa.array([data[a:b].decode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.string())
        doc = piece.column("doc_id").take(pa.array(owner))
        yield pa.RecordBatch.from_arrays([doc, *[rows.field(c) for c in schema.names[1:-1]], texts], schema=schema)


def packed_texts(documents: DataFrame, capacities: Sequence[int] = CAPACITIES) -> DataFrame:
    """``best_fit`` with the ``text`` of each piece, from its first word up to the next piece's first word.

    Rows are told apart by a key of their own, so doc_id may be null or repeated. Null and empty texts
    are one end token and an empty text. An empty table gives an empty result. Other columns are left
    out, whatever their names. A document's pieces lie in one row as its text does; cutting takes about
    40 times its bytes.
    """
    texts = common.cut(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_row")))
    placed = best_fit(texts.select(F.col("_row").alias("doc_id"), "text"), capacities)
    inner = [c.split()[0] for c in _PIECE.split(", ")][1:]
    each = placed.groupBy(F.col("doc_id").alias("_row")).agg(F.collect_list(F.struct(*inner)).alias("pieces"))
    return texts.join(each, "_row").select("doc_id", "text", "pieces").mapInArrow(_cut, f"{_PIECE}, text string")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(common.read(spark, sf_dir, "documents"))
