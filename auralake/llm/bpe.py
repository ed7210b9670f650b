"""Operator 9: byte-level BPE by speculation and verification, and decoding.

A text is cut into pre-tokens as the vocabulary's pattern does. For all new pre-tokens of a batch at
once, greedy longest match proposes tokens: the longest token at each byte is found for all bytes
together, and then the tokens follow one another. BPE gives a token sequence just if it gives every
adjacent pair of it for that pair's text; so the proposal is tested pair by pair: undoing the merges
of both tokens from the latest to the earliest, no merge across their border may have come first.
Pre-tokens of which all pairs pass are done; the others are merged exactly, long ones only about the
pairs that fail, as far as the test asks for. Tokens that BPE never gives for their own bytes are not proposed.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .suffixtree import Index

#: Entries of a worker's cache of text pieces, after which it starts anew.
CACHED = 500_000
#: Bytes from which a pre-token is merged with a heap.
LONG = 100
#: Pre-tokens that are followed together; fewer are followed one by one.
FEW = 64
_SPACE = r"\t-\r \x85\xa0  -     　"
#: The pattern of byte-level pre-tokens.
PATTERN = regex.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Where a text may not be cut before a space: white space on both sides of it, or the end after two.
_ENTANGLED = regex.compile(rf"[{_SPACE}] (?:[{_SPACE}]|\Z)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is seen, else one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """A byte-level BPE vocabulary. Tokens have inner ids: bytes as they are, then merges by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            written = json.load(file)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        ids = {as_bytes(t): i for t, i in written["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in written["added_tokens"]}
        inner = {bytes([b]): b for b in range(256)}
        self.texts = [bytes([b]) for b in range(256)]
        left, right = list(range(256)), list(range(256))
        self.ranks: dict[tuple[int, int], int] = {}
        for merge in written["model"]["merges"]:
            a, b = map(as_bytes, merge.split(" ") if isinstance(merge, str) else merge)
            pair = inner[a], inner[b]
            self.ranks.setdefault(pair, len(self.texts))
            inner.setdefault(a + b, len(self.texts))
            left.append(pair[0])
            right.append(pair[1])
            self.texts.append(a + b)
        self.left, self.right = np.array(left), np.array(right)
        self.out = [ids[t] for t in self.texts]
        self.decimal = [f"{i}," for i in self.out]
        codes = np.array([a << 32 | b for a, b in self.ranks], np.uint64)
        self.merged = np.array(list(self.ranks.values()), np.int64)
        self.pairs = Index(codes)
        whole = np.ones(len(self.texts), bool)
        made = np.arange(256, len(self.texts))
        whole[made] = self.compatible(self.left[made], self.right[made], made)
        good = [i for i in np.flatnonzero(whole).tolist() if inner[self.texts[i]] == i]
        #: For each length: the beginnings of tokens that are so long, and the token that each of them is, or -1.
        self.beginnings: list[tuple[Index, np.ndarray]] = []
        self.size = np.array([len(t) for t in self.texts], np.int64)
        token, at = np.array(good, np.int64), np.cumsum(self.size[good]) - self.size[good]
        data = np.frombuffer(b"".join(self.texts[i] for i in good), np.uint8)
        prints = np.zeros(len(good), np.uint64)
        while len(token):
            n = len(self.beginnings)
            prints = _further(prints, data[at + n])
            distinct, place = np.unique(prints, return_inverse=True)
            whole = np.full(len(distinct), -1, np.int64)
            ends = self.size[token] == n + 1
            whole[place[ends]] = token[ends]
            self.beginnings.append((Index(distinct), whole))
            token, at, prints = token[~ends], at[~ends], prints[~ends]

    def compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether BPE keeps each token of ``a`` apart from the one of ``b`` that follows it.

        ``below``: only merges of lesser ids count, as they do inside the token of that id.
        """
        fine = np.ones(len(a), bool)
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 1 << 40) if below is None else below.astype(np.int64)
        at = np.arange(len(a))
        while len(at):
            found = self.pairs((x << 32 | y).astype(np.uint64))
            crossed = (found >= 0) & (self.merged[np.maximum(found, 0)] < limit)
            fine[at[crossed]] = False
            go = ~crossed & (np.maximum(x, y) >= 256)
            at, x, y, limit = at[go], x[go], y[go], limit[go]
            undo_left = x > y
            limit = np.minimum(limit, np.where(undo_left, x, y + 1))
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return fine

    def merge(self, text: bytes) -> list[int]:
        """Exact BPE of a pre-token, in inner ids."""
        get, none = self.ranks.get, 1 << 40
        ids = list(text)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]  # noqa: B905
        if len(ids) > LONG:
            return self._merge_long(ids, ranks)
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i] = best
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], best), none)
            if i < len(ranks):
                ranks[i] = get((best, ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int], ranks: list[int]) -> list[int]:
        """The same with a heap of merges and a linked list, for pre-tokens of any length."""
        none = 1 << 40
        heap = [(r, i) for i, r in enumerate(ranks) if r < none]
        heapify(heap)
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        while heap:
            best, i = heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or self.ranks.get((ids[i], ids[j])) != best:
                continue
            ids[i], ids[j], after[i] = best, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (rank := self.ranks.get((ids[a], ids[after[a]]))) is not None:
                    heappush(heap, (rank, a))
        return [i for i in ids if i >= 0]

    def longest(self, data: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The longest token at each byte that has no more than ``room`` bytes.

        Bytes are added to all positions at once, as long as what is there begins a token.
        """
        best = np.full(len(data), -1, np.int64)
        at, prints = np.arange(len(data)), np.zeros(len(data), np.uint64)
        for n, (index, whole) in enumerate(self.beginnings):
            far = room[at] > n
            at = at[far]
            if not len(at):
                break
            prints = _further(prints[far], data[at + n])
            found = index(prints)
            some = found >= 0
            at, prints, token = at[some], prints[some], whole[found[some]]
            best[at[token >= 0]] = token[token >= 0]
        return best

    def propose(self, texts: list[bytes]) -> list[np.ndarray]:
        """Greedy longest match for each pre-token, in inner ids."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts])
        end = np.cumsum(size)
        best = self.longest(data, np.repeat(end, size) - np.arange(len(data)))
        after = np.arange(len(data)) + self.size[best]
        at, word = end - size, np.arange(len(texts))
        words, tokens = [], []
        while len(at) > FEW:
            words.append(word)
            tokens.append(best[at])
            at = after[at]
            go = at < end[word]
            at, word = at[go], word[go]
        for w, begin in zip(word.tolist(), at.tolist(), strict=True):  # long ones, which are left
            steps, i, own = (after[begin : end[w]] - begin).tolist(), 0, []
            while i < len(steps):
                own.append(i)
                i = steps[i]
            words.append(np.full(len(own), w))
            tokens.append(best[begin + np.array(own)])
        word, token = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(word, kind="stable")
        return np.split(token[order], np.cumsum(np.bincount(word, minlength=len(texts)))[:-1])

    def repaired(self, tokens: np.ndarray) -> list[int]:
        """Exact BPE from a proposal: what lies about pairs that fail is merged exactly and tested at its borders, ever wider until all pairs pass."""
        width = 4
        while len(bad := np.flatnonzero(~self.compatible(tokens[:-1], tokens[1:]))):
            low, high = np.maximum(bad + 1 - width, 0), np.minimum(bad + 1 + width, len(tokens))
            first = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
            parts, at = [], 0
            for a, b in zip(low[first].tolist(), high[np.append(first[1:], len(bad)) - 1].tolist(), strict=True):
                parts += [tokens[at:a], self.merge(b"".join([self.texts[i] for i in tokens[a:b].tolist()]))]
                at = b
            tokens = np.concatenate([*parts, tokens[at:]]).astype(np.int64)
            width *= 2
        return tokens.tolist()

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        """The tokens of each pre-token, in inner ids."""
        if not texts:
            return []
        proposed = self.propose(texts)
        flat = np.concatenate(proposed)
        word = np.repeat(np.arange(len(texts)), [len(p) for p in proposed])
        pair = np.flatnonzero(word[1:] == word[:-1])
        wrong = np.zeros(len(texts), bool)
        different, back = np.unique(flat[pair] << 32 | flat[pair + 1], return_inverse=True)
        wrong[word[pair[~self.compatible(different >> 32, different & 0xFFFFFFFF)[back]]]] = True
        return [p.tolist() if not bad else self.merge(t) if len(t) <= LONG else self.repaired(p) for t, p, bad in zip(texts, proposed, wrong.tolist(), strict=True)]


def _further(prints: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of runs of bytes, from those of the runs without their last byte."""
    out = (prints ^ (byte.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ out >> np.uint64(29)


@lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Coder:
    """Encodes and decodes whole texts, with a cache of text pieces.

    A text is cut before each space, where no pre-token can lie across unless white space surrounds
    it; texts with such spaces, or with a special token, are coded whole. A piece is known by its
    64-bit fingerprint; its entry has the number of its tokens, their ids in decimal, and the bytes
    that these ids stand for, and what a text consists of is gathered from the entries at once.
    """

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        """No pieces: sorted fingerprints, of which the last is no piece's, and for each its entry (tokens, place and size in both stores)."""
        self.keys, self.entries = np.array([2**64 - 1], np.uint64), np.zeros((1, 5), np.int64)
        self.decimals, self.raws = np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        self.tokens: dict[str, list[int]] = {}

    def _inner(self, texts: list[str]) -> list[list[int]]:
        """The tokens of pieces, or of whole texts without special tokens."""
        parts = [PATTERN.findall(t) for t in texts]
        known = self.tokens
        new = list({t for p in parts for t in p if t not in known})
        known.update(zip(new, self.vocabulary.encode([t.encode() for t in new]), strict=True))
        return [known[p[0]] if len(p) == 1 else [i for t in p for i in known[t]] for p in parts]

    def _learn(self, prints: np.ndarray, pieces: list[str]) -> None:
        decimal, texts = self.vocabulary.decimal, self.vocabulary.texts
        inner = self._inner(pieces)
        written = ["".join([decimal[i] for i in own]).encode() for own in inner]
        stood = [b"".join([texts[i] for i in own]) for own in inner]
        rows = np.zeros((len(pieces), 5), np.int64)
        rows[:, 0] = [len(own) for own in inner]
        for at, store, parts in ((1, self.decimals, written), (3, self.raws, stood)):
            rows[:, at + 1] = [len(p) for p in parts]
            rows[:, at] = len(store) + np.cumsum(rows[:, at + 1]) - rows[:, at + 1]
        self.decimals = np.concatenate([self.decimals, np.frombuffer(b"".join(written), np.uint8)])
        self.raws = np.concatenate([self.raws, np.frombuffer(b"".join(stood), np.uint8)])
        keys = np.concatenate([self.keys, prints])
        order = np.argsort(keys, kind="stable")
        self.keys, self.entries = keys[order], np.concatenate([self.entries, rows])[order]

    def whole(self, text: str) -> tuple[int, bytes, bytes]:
        """Number of tokens, ids in decimal each followed by a comma, and decoded bytes of any text."""
        special = self.vocabulary.special
        runs = [text]
        for mark in special:
            runs = [x for r in runs for x in ([r] if r in special or mark not in r else regex.split(f"({regex.escape(mark)})", r))]
        ids: list[str] = []
        raw: list[bytes] = []
        for run in runs:
            if run in special:
                ids.append(f"{special[run]},")
                raw.append(run.encode())
            else:
                inner = self._inner([run])[0]
                ids += [self.vocabulary.decimal[i] for i in inner]
                raw += [self.vocabulary.texts[i] for i in inner]
        return len(ids), "".join(ids).encode(), b"".join(raw)

    def code(self, column: pa.Array) -> list[tuple[int, str, str]]:
        """(number of tokens, SHA-256 of the decimal ids, SHA-256 of the decoded text) of each text."""
        data, bounds = common.utf8(column)
        if len(self.keys) > CACHED or len(self.tokens) > CACHED:
            self._forget()
        cut = data == 0x20
        cut[bounds[:-1][np.diff(bounds) > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        prints, first, back = np.unique(common.prints(data, start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, prints)
        new = first[self.keys[np.minimum(at, len(self.keys) - 1)] != prints]
        raw = data.tobytes()
        if len(new):
            self._learn(prints[back[new]], [raw[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            at = np.searchsorted(self.keys, prints)
        entry = self.entries[at][back]
        decimals, decimal_to = common.gathered(self.decimals, entry[:, 1], entry[:, 2])
        stood, stood_to = common.gathered(self.raws, entry[:, 3], entry[:, 4])
        piece = np.searchsorted(start, bounds)
        count = np.concatenate([[0], np.cumsum(entry[:, 0])])[piece].tolist()
        decimal_at, stood_at = decimal_to[piece].tolist(), stood_to[piece].tolist()
        ids, text = memoryview(decimals), memoryview(stood)
        odd = self._odd(data, bounds, raw)
        rows = []
        for i in range(len(bounds) - 1):
            if i in odd:
                n, written, own = self.whole(raw[bounds[i] : bounds[i + 1]].decode())
            else:
                n, written, own = count[i + 1] - count[i], ids[decimal_at[i] : decimal_at[i + 1]], text[stood_at[i] : stood_at[i + 1]]
            decoded = str(own, "utf-8", "replace")
            rows.append((n, hashlib.sha256(written[:-1]).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return rows

    def _odd(self, data: np.ndarray, bounds: np.ndarray, raw: bytes) -> set[int]:
        """Texts that may not be cut before each space, or that hold a special token."""
        blank = (data == 0x20) | ((data >= 9) & (data <= 13))
        hint = np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3))  # lead bytes of other white space
        hint[1:] |= blank[1:] & blank[:-1] & ((data[1:] == 0x20) | (data[:-1] == 0x20))
        hint[1:] |= (data[1:] == 0x7C) & (data[:-1] == 0x3C)
        some = np.unique(np.searchsorted(bounds, np.flatnonzero(hint), "right") - 1)
        marks = self.vocabulary.special
        return {i for i in some.tolist() if _ENTANGLED.search(t := raw[bounds[i] : bounds[i + 1]].decode()) or any(m in t for m in marks)}

    def ids(self, text: str) -> list[int]:
        """The token ids of a text."""
        return [int(i) for i in self.whole(text)[1].decode().split(",")[:-1]]

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for; bytes that are no UTF-8 become U+FFFD."""
        back = {int(o): t for o, t in zip(self.vocabulary.out, self.vocabulary.texts, strict=True)} | {i: t.encode() for t, i in self.vocabulary.special.items()}
        return b"".join(back[i] for i in ids).decode("utf-8", "replace")


@lru_cache(1)
def coder(path: str) -> Coder:
    return Coder(path)


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of ``documents``.

    ``path`` is the vocabulary's file on every executor. Null and empty texts have no tokens.
    Repeated rows each get a row. An empty table gives an empty result. Other columns are left out,
    whatever their names. A text is coded whole, in time in proportion to its length, which takes about 150 times
    the bytes of its longest stretch without a space, and 30 times its own.
    """

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def code(column: pa.Array) -> pa.Array:
        own = coder(path)
        whole = pa.RecordBatch.from_arrays([column.cast(pa.string())], names=["text"])
        rows = []
        for piece in common.pieces([whole], most=common.CODING_BYTES):
            rows += own.code(piece.column(0))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", code(F.col("text")).alias("_coded")).select("doc_id", "_coded.*")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return encoded(common.read(spark, sf_dir, "documents"), path or tokenizer_path("byte_bpe_50k.json"))
