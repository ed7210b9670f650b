"""Operator 5: a probabilistic suffix tree over words, and the score of each document under it.

The symbols are lower-cased words and an end symbol for each document. A state of the tree is a
context: the last symbols of a history. The tree grows level by level. A context of one symbol is
tried if it occurs ``CONTEXT`` times; a longer one if it does too and both the context without its
last symbol and the one without its first are in the tree. What follows the tried contexts
is counted over all training text, and a context stays if its next-symbol counts diverge from those
of its suffix: twice its count times the Kullback-Leibler divergence is held against what chance
gives. No length is set in advance: growth ends where nothing more diverges (what depends on a
symbol only beyond a context that does not diverge is not seen).

A state lists the symbols that follow it ``LISTED`` times or more, discounted; what that leaves of
its probability goes to the distribution of its suffix. At the root, the discount goes to symbols
never seen, in equal shares for as many of them as Chao's estimate expects. A document is scored by
the longest state that ends its history, symbol by symbol.

As every suffix of a state is a state, and lists what the state lists, the logarithm of a symbol's
probability is a sum over all runs of symbols that end at it or before it: a run has a weight if it
is a state (what goes to the suffix) or a listed symbol after its state (what listing it adds). So
the model is a table of runs with weights, of any size, and a document's score is a join with it.
Weights of runs that make up at least a share of ``FREQUENT`` of the training symbols, at most
``1 / FREQUENT`` of each length, go to all executors; the others are joined. Bit maps of a fixed size
keep runs that are surely not in the model out of the shuffles; what they let through by chance
meets no weight. Words are known by 64-bit fingerprints, runs by Spark's hash of head and tail.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Occurrences that make a context worth trying; those that make a next symbol listed, and what each listed count gives up.
CONTEXT, LISTED, DISCOUNT = 50, 3, 0.75
#: Standard deviations that the test statistic must lie above its mean under chance.
SIGMAS = 4.0
FREQUENT = 3e-7
END = np.uint64(0x656E64)
#: Different symbols or pairs that a task counts before it hands them on.
HELD = 3_000_000
MAP_BITS = 26


class Index:
    """From 64-bit keys to their places, for whole arrays at once; -1 for keys that are not there."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length() + 1)
        self.mask, self.keys = np.uint64((1 << bits) - 1), keys.astype(np.uint64)
        self.table = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = common.mix(self.keys) & self.mask
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + np.uint64(1)) & self.mask

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        wanted = wanted.astype(np.uint64)
        slot = common.mix(wanted) & self.mask
        found = self.table[slot]
        if not len(self.keys):
            return found
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != wanted))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask
            found[open_] = self.table[slot[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[found[open_]] != wanted[open_])]
        return found


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of some texts, each closed by END, and the bounds of each text in them."""
    words = common.scan(column, lower=True)
    bounds = words.first + np.arange(len(words.first))
    out = np.full(bounds[-1], END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[bounds[1:] - 1] = False
    out[keep] = words.prints()
    return out, bounds


def run_of(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The hash of a run from those of the run without its last and without its first symbol: Spark's ``xxhash64`` of the two."""
    # The primes of XXH64.
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, by: x << np.uint64(by) | x >> np.uint64(64 - by)
    out = np.full(len(head), 42, np.uint64)
    for part in (head, tail):
        out = (out + p5 + np.uint64(8)) ^ turned(part * p2, 31) * p1
        out = turned(out, 27) * p1 + p4
        out = (out ^ out >> np.uint64(33)) * p2
        out = (out ^ out >> np.uint64(29)) * p3
        out ^= out >> np.uint64(32)
    return out


def longer(runs: np.ndarray) -> np.ndarray:
    """Runs of one more symbol, by their last place; the first place has none (its value means nothing)."""
    out = runs.copy()
    out[1:] = run_of(runs[:-1], runs[1:])
    return out


class BitMap:
    """Which of ``2**MAP_BITS`` residues the runs of a table have: a run that is not ``in`` it is not in the table."""

    def __init__(self, runs: DataFrame, column: str):
        low = F.col(column).bitwiseAND(F.lit((1 << MAP_BITS) - 1))
        with common.freed(runs.sparkSession):
            words = runs.select(F.shiftright(low, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # 2**(MAP_BITS - 6) rows at most
        self.words = np.zeros(1 << MAP_BITS - 6, np.uint64)
        self.words[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)

    def has(self, runs: np.ndarray) -> np.ndarray:
        low = runs & np.uint64((1 << MAP_BITS) - 1)
        return (self.words[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


_COUNTED = pa.schema([("key", pa.int64()), ("n", pa.int64())])


def counts(texts: DataFrame, keys: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """(key, n): how often each 64-bit key occurs among those that ``keys`` gives for the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def joined() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return key, np.bincount(at, np.concatenate([h[1] for h in held]), len(key)).astype(np.int64)

        def rows(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000])], schema=_COUNTED)

        for piece in common.pieces(batches):
            held.append(np.unique(keys(piece.column("text")), return_counts=True))
            if sum(len(h[0]) for h in held) > HELD:
                held = [joined()]
                if len(held[0][0]) > HELD // 2:
                    yield from rows(*held.pop())
        if held:
            yield from rows(*joined())

    return texts.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


_DEALT = pa.schema([("bucket", pa.int64()), ("heads", pa.list_(pa.int64())), ("tails", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])
_FOLLOWED = pa.schema([("head", pa.int64()), ("tail", pa.int64()), ("n", pa.int64())])
#: Runs that a bucket counts at once, on average, and that a row carries to it at most.
BUCKET_RUNS, ROW_RUNS = 2_000_000, 2_000
#: Lengths of contexts that one reading of the text counts, beyond the first, and the runs that it deals at most, of the training symbols (unless one length has more).
LENGTHS, DEALT = 3, 2
#: Runs whose weights are joined in one step of scoring, of the training symbols, and the least that make a second step worth it.
STEP, STEP_RUNS = 0.4, 5_000_000
#: The first step scores one in so many documents; those after it go by what it has met, by hashes of so many values.
FIRST, _HASHES = 8, 1 << 20


def _summed(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal runs (heads, tails and, unless each counts once, counts in ``parts``, which is emptied) as one with its count, in order of head and tail by their upper halves (unlike ones that agree in these may stay apart)."""
    high = np.uint64(0xFFFFFFFF00000000)
    full = parts[0] & high
    full |= parts[1] >> np.uint64(32)
    order = np.argsort(full)
    del full
    for i in range(len(parts)):
        parts[i] = parts[i][order]
    del order
    head, tail = parts[:2]
    n = parts[2] if len(parts) > 2 else None
    parts.clear()
    edge = np.ones(len(head), bool)
    edge[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
    first = np.flatnonzero(edge)
    head, tail = head[edge], tail[edge]
    if n is None:
        return head, tail, np.diff(first, append=len(edge))
    return head, tail, np.add.reduceat(n, first) if len(first) else n


def _dealt(held: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """The runs (heads and tails) in ``held``, which is emptied, as rows for their buckets; what is not needed any more is let go, as a task's memory peaks here."""
    parts = [np.concatenate([h[i] for h in held]) for i in range(2)]
    held.clear()
    head, tail, n = _summed(parts)
    n = n.astype(np.int32)
    bucket = (run_of(head, tail) % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    starts = np.concatenate([np.arange(a, b, ROW_RUNS) for a, b in zip(edge, [*edge[1:], len(bucket)], strict=True)])
    offsets = pa.array(np.append(starts, len(bucket)).astype(np.int32))
    head = head.view(np.int64)[order]
    tail = tail.view(np.int64)[order]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (head, tail, n[order])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int64)), *lists], schema=_DEALT)


def _followers(training: DataFrame, first: int, last: int, tried: DataFrame, tokens: int) -> DataFrame:
    """(head, tail, n): what follows contexts of the lengths ``first`` to ``last``, n being ``LISTED`` or more.

    Of the first length, those of ``tried`` (context); of a greater one, those whose parts of the first
    length are all tried; and a few others by chance of the map. Runs go to buckets, many in a row in
    order of their heads, and each bucket is counted on its own.
    """
    shared = training.sparkSession.sparkContext.broadcast(BitMap(tried, "context"))
    buckets = max(1, -(-tokens // BUCKET_RUNS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        for piece in common.pieces(batches):
            runs, bounds = symbols(piece.column("text"))
            place = np.arange(len(runs)) - np.repeat(bounds[:-1], np.diff(bounds))
            for _ in range(1, first):
                runs = longer(runs)
            fit = shared.value.has(runs) & (place >= first - 1)
            for length in range(first, last + 1):
                at = np.flatnonzero(fit[:-1] & (place[1:] >= length))
                held.append((runs[at], runs[at + 1]))
                if length < last:
                    runs = longer(runs)
                    fit[1:] &= fit[:-1] & (place[1:] >= length)
            if sum(len(h[0]) for h in held) > HELD:
                yield _dealt(held, buckets)
        if sum(len(h[0]) for h in held):
            yield _dealt(held, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def rows() -> pa.RecordBatch:
            flat = lambda c: np.concatenate([b.column(c).flatten().to_numpy(zero_copy_only=False) for b in held])
            head, tail, n = _summed([flat("heads").view(np.uint64), flat("tails").view(np.uint64), flat("counts").astype(np.int64)])
            often = n >= LISTED
            return pa.RecordBatch.from_arrays([pa.array(head[often].view(np.int64)), pa.array(tail[often].view(np.int64)), pa.array(n[often])], schema=_FOLLOWED)

        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    if held and held[-1].column("bucket")[0].as_py() != bucket[a]:
                        yield rows()
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield rows()

    dealt = training.select("text").mapInArrow(deal, "bucket long, heads array<long>, tails array<long>, counts array<int>").repartition("bucket").sortWithinPartitions("bucket")
    try:
        return common.stored(dealt.mapInArrow(count, "head long, tail long, n long"))
    finally:
        shared.unpersist()


class Model:
    """The runs that have weights. ``higher``: (run, n, score) of runs of two symbols or more that are listed, and of all states."""

    def __init__(self, words: DataFrame, context: int = CONTEXT):
        numbers = words.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("n") == 1, 1)), F.sum(F.when(F.col("n") == 2, 1))).first()
        self.total, self.different, once, twice = (int(x or 0) for x in numbers)
        self.discount = min(0.9, max(0.1, once / max(1, once + 2 * twice)))  # inside (0, 1), so that no symbol loses all
        expected = max(1.0, once * (once - 1) / (2 * (twice + 1)))
        self.unseen = self.discount * self.different / self.total / expected if self.total else 1.0
        self.words, self.context, self.depth = words, context, 0
        self.higher, self.listed = None, None

    def root(self, n: Column) -> Column:
        return (n - F.lit(self.discount)) / F.lit(max(1, self.total))

    def learn(self, training: DataFrame) -> Model:
        """Grows the tree over ``training`` (text)."""
        tried = self.words.where((F.col("n") >= self.context) & (F.col("key") != int(END))).select(F.col("key").alias("context"), F.col("n").alias("size"))
        known = self.words.select(F.col("key").alias("run"), self.root(F.col("n")).alias("lower"), (F.col("n") / F.lit(max(1, self.total))).alias("lower_share"))
        parts, read, followed = [], 0, None
        while not tried.isEmpty():
            if self.depth + 1 > read:
                if followed is not None:
                    common.forget(followed)
                occurrences = tried.agg(F.sum("size")).first()[0]
                first, read = self.depth + 1, self.depth + max(1, min(LENGTHS, DEALT * self.total // occurrences)) if self.depth else 1
                followed = _followers(training, first, read, tried, self.total)
            entries = followed.join(tried, F.col("head") == F.col("context")).join(known, F.col("run") == F.col("tail")).select("head", "tail", "n", "size", "lower", "lower_share")
            entries = common.stored(entries)
            share = F.col("n") / F.col("size")
            some = entries.groupBy("head").agg(
                F.count("*").alias("k"), F.first("size").alias("size"), F.sum(share).alias("shares"), F.sum("lower_share").alias("lowers"), F.sum(share * F.log(share / F.col("lower_share"))).alias("gain"), F.sum((F.col("n") - DISCOUNT) / F.col("size")).alias("given")
            )
            rest = lambda c: F.greatest(1 - F.col(c), F.lit(1e-12))
            divergence = F.col("gain") + rest("shares") * F.log(rest("shares") / rest("lowers"))
            diverges = 2 * F.col("size") * divergence > F.col("k") + SIGMAS * F.sqrt(2 * F.col("k"))
            kept = common.stored(some.where(diverges).select(F.col("head").alias("state"), F.col("size").alias("state_n"), rest("given").alias("passed")))
            if kept.isEmpty():
                common.forget(entries)
                break
            self.depth += 1
            p = (F.col("n") - DISCOUNT) / F.col("size") + F.col("passed") * F.col("lower")
            listed = entries.join(kept, F.col("head") == F.col("state")).select(F.xxhash64("head", "tail").alias("run"), "tail", "n", p.alias("lower"), share.alias("lower_share"), (F.log10(p / F.col("lower")) - F.log10("passed")).alias("score"))
            listed = common.stored(listed)
            common.forget(entries)
            parts += [listed.select("run", "n", "score"), kept.select(F.col("state").alias("run"), F.col("state_n").alias("n"), F.log10("passed").alias("score"))]
            # A listed run ends in END only as the last of its document, and then its tail is no state.
            tried = common.stored(listed.where(F.col("n") >= self.context).join(kept.select("state"), F.col("tail") == F.col("state"), "left_semi").select(F.col("run").alias("context"), F.col("n").alias("size")))
            known = listed.select("run", "lower", "lower_share")
            self.listed = listed.select("run") if self.listed is None else self.listed.unionByName(listed.select("run"))
        if followed is not None:
            common.forget(followed)
        for part in parts:
            self.higher = part if self.higher is None else self.higher.unionByName(part)
        return self

    def weights(self) -> DataFrame:
        """(run, n, score, base, known); a run may have several rows, which add up. Words are over what an unseen word has."""
        words = self.words.select(F.col("key").alias("run"), "n", (F.log10(self.root(F.col("n"))) - float(np.log10(self.unseen))).alias("score"), F.log10(F.col("n") + 1).alias("base"), F.lit(1).alias("known"))
        return words if self.higher is None else words.unionByName(self.higher.select("run", "n", "score", F.lit(0.0).alias("base"), F.lit(0).alias("known")))


_PARTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64()))])


def scores(documents: DataFrame, held_out: Column, context: int = CONTEXT, frequent: float = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``documents``.

    ``held_out`` is a boolean column over doc_id; the tree learns from the other rows. ``score`` gives
    a word never seen the share of one such word. Null and empty texts are one end symbol. Repeated
    rows each get a row and each count in training. With no training rows every symbol is unseen, and
    the scores are 0. An empty table gives an empty result. Other columns are left out, whatever their
    names. A text is worked on whole: a task needs about 60 times its bytes.
    """
    held_out = F.coalesce(held_out, F.lit(False))
    texts = documents.select("doc_id", "text")
    training = texts.where(~held_out)
    words = common.stored(counts(training, lambda column: symbols(column)[0].view(np.int64)))
    model = Model(words, context).learn(training)
    weights = model.weights()
    listed = weights.where(F.col("n") >= max(1.0, frequent * model.total)).groupBy("run").agg(F.sum("score").alias("score"), F.sum("base").alias("base"), F.sum("known").alias("known")).toArrow()  # 1 / frequent rows of each length at most
    usual = {c: listed.column(c).to_numpy() for c in ("run", "score", "base", "known")}
    depth = model.depth
    shared = documents.sparkSession.sparkContext.broadcast((usual, BitMap(model.listed, "run") if depth else None))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual, listed = shared.value
        index = Index(usual["run"].view(np.uint64))
        for piece in common.pieces(batches):
            runs, bounds = symbols(piece.column("text"))
            size = np.diff(bounds)
            doc = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(runs)) - np.repeat(bounds[:-1], size)
            sums = {c: np.zeros(len(size)) for c in ("score", "base", "known")}
            rare, at = [], np.arange(len(runs))
            for length in range(1, depth + 2):
                if length > 1:
                    runs = longer(runs)
                    at = at[(place[at] >= length - 1)]
                    at = at[listed.has(runs[at])]
                found = index(runs[at])
                hit = found >= 0
                for c in sums:
                    sums[c] += np.bincount(doc[at[hit]], usual[c][found[hit]], len(size)) if len(usual[c]) else 0
                rare.append((doc[at[~hit]], runs[at[~hit]]))
            owner, run = map(np.concatenate, zip(*rare, strict=True))
            run = run[np.argsort(owner, kind="stable")]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(sums["known"].astype(np.int64)), pa.array(sums["base"]), pa.array(sums["score"]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(run.view(np.int64)))],
                schema=_PARTS,
            )

    def scored(part: DataFrame) -> DataFrame:
        rare = part.select("row", F.explode("rare").alias("run"))
        rest = rare.join(weights.select("run", "score", "base", "known"), "run").groupBy("row").agg(F.sum("score").alias("more_score"), F.sum("base").alias("more_base"), F.sum("known").alias("more_known"))
        plus = lambda c, zero: F.col(c) + F.coalesce(f"more_{c}", F.lit(zero))
        both = part.drop("rare").withColumnRenamed("n_known", "known").join(rest, "row", "left")
        return both.select(
            "doc_id", held_out.alias("held_out"), "n_tokens", plus("known", 0).cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
            (plus("base", 0.0) - F.col("n_tokens") * float(np.log10(model.total + model.different + 1))).alias("base_score"), (plus("score", 0.0) + F.col("n_tokens") * float(np.log10(model.unseen))).alias("score"),
        )

    room = max(STEP * model.total, STEP_RUNS)

    def all_scored() -> Iterator[DataFrame]:
        low, high = 0, _HASHES if model.total <= STEP_RUNS else _HASHES // FIRST
        while low < _HASHES:
            some = texts if high - low == _HASHES else texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(_HASHES)).between(low, high - 1))
            part, runs = common.stored(some.mapInArrow(parts, "doc_id long, n_tokens long, n_known long, base double, score double, rare array<long>").withColumn("row", F.monotonically_increasing_id())), 0
            if high < _HASHES:
                runs = part.agg(F.sum(F.size("rare"))).first()[0] or 0
            yield scored(part)
            common.forget(part)
            low, high = high, min(_HASHES, high + max(1, int(room * (high - low) / max(1, runs))))

    found = common.stored_by_steps(all_scored())
    shared.unpersist()
    return found


def op5_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return scores(common.read(spark, sf_dir, "documents"), held_out)
