"""Operator 12: fill-in-middle by one automaton over bytes, which knows units, code points and sentinels.

A table gives for each state and class of byte the next state and what the step counts: the begin
of a code point (a byte that does not continue one), the begin of a unit (a code point, a word with
the blanks after it, or a line) and the end of a sentinel. The first byte of a text has classes of
its own, which lead on from the start state whatever came before, so all texts of a batch are one
tape and one scan. The tape is read in lanes, a column of bytes a step; a lane is followed from every
state until all of them have met, which takes no more bytes than the longest sentinel, or the longest
code point, has; from there it is one state, and that in which the lane before ends tells the rest.

The counts along the tape tell how many units and sentinels a text has. The second pass looks up the
counts at which a text's two cuts lie.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Marks of the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("char", "word", "line")
SEED, TRANSFORMED, SUFFIX_FIRST = 1, 90, 20
#: What a step may count.
UNIT, SENTINEL, POINT = 1, 2, 4
#: Bytes of a lane, where there are enough for several.
LANE = 512
_BLANKS = frozenset(b" \t\n\v\f\r")


class Automaton:
    """The table for a kind of unit and some sentinels, and the scan that it drives.

    A state is what of a sentinel the last bytes have spelled, with one bit: whether a unit may begin.
    """

    def __init__(self, unit: str, sentinels: Sequence[str]):
        if unit not in UNITS:
            raise ValueError(f"a unit is one of {', '.join(UNITS)}, not {unit}")
        marks = [s.encode() for s in sentinels]
        if not all(marks):
            raise ValueError("a sentinel is not empty")
        spelled = sorted({m[:i] for m in marks for i in range(len(m))} | {b""}, key=lambda p: (len(p), p))
        number = {p: i for i, p in enumerate(spelled)}
        self.states = 2 * len(spelled)
        table = np.zeros((self.states, 256), np.int64)
        for prefix in spelled:
            for ready in (0, 1):
                for byte in range(256):
                    seen = prefix + bytes([byte])
                    counted = SENTINEL if any(seen.endswith(m) for m in marks) else 0
                    rest = next(seen[i:] for i in range(len(seen) + 1) if seen[i:] in number)
                    after = ready
                    if byte & 0xC0 != 0x80:
                        counted |= POINT
                        blank = byte in _BLANKS
                        if unit == "char" or (ready and not (unit == "word" and blank)):
                            counted |= UNIT
                        after = {"char": 0, "word": int(blank), "line": int(byte == 0x0A)}[unit]
                    table[number[prefix] * 2 + ready, byte] = (number[rest] * 2 + after) << 3 | counted
        first = table[1].copy()  # nothing spelled, a unit may begin
        if unit == "word":  # blanks before the first word are a unit
            first[list(_BLANKS)] |= UNIT
        columns, self.classes = np.unique(np.vstack([table, first]), axis=1, return_inverse=True)
        self.classes = self.classes.ravel().astype(np.uint8 if 2 * columns.shape[1] < 256 else np.uint16)
        self.width = columns.shape[1]
        again = np.repeat(columns[-1:], self.states, axis=0)
        self.table = np.hstack([columns[:-1], again]).astype(np.int32)

    def scan(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """What each byte counts, for texts that lie in ``data`` between ``bounds``."""
        tape = self.classes[data]
        tape[bounds[:-1][np.diff(bounds) > 0]] += self.width
        lanes = max(1, len(tape) // LANE)
        length = -(-len(tape) // lanes)
        grid = np.zeros(lanes * length, tape.dtype)
        grid[: len(tape)] = tape
        grid = np.ascontiguousarray(grid.reshape(lanes, length).T)
        flat, wide = self.table.ravel(), 2 * self.width
        state = np.repeat(np.arange(self.states)[:, None], lanes, axis=1)
        unsure, step = [], 0
        while step < length and (state != state[0]).any():
            found = self.table[state, grid[step]]
            unsure.append(found & 7)
            state = found >> 3
            step += 1
        out = np.empty((length, lanes), np.uint8)
        if step == length and (state != state[0]).any():  # short lanes, in which states have not met
            begin = np.ones(lanes, np.int64)
            for i in range(1, lanes):
                begin[i] = state[begin[i - 1], i - 1]
        else:
            now = state[0].astype(np.int32)
            for j in range(step, length):
                found = flat.take(now * wide + grid[j])
                out[j] = found & 7
                now = found >> 3
            begin = np.concatenate([[1], now[:-1]])
        for j, counted in enumerate(unsure):
            out[j] = counted[begin, np.arange(lanes)]
        return np.ascontiguousarray(out.T).ravel()[: len(tape)]


@lru_cache(8)
def automaton(unit: str, sentinels: tuple[str, ...]) -> Automaton:
    return Automaton(unit, sentinels)


def _until(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The count before each position of a running count."""
    return np.where(at > 0, counts[np.maximum(at, 1) - 1] if len(counts) else 0, 0)


def transformed(column: pa.Array, draws: Sequence[np.ndarray], unit: str, sentinels: tuple[str, ...], rate: int, spm: int) -> list[tuple[int, str, int | None, int | None, bytes]]:
    """(units, form, code points of the prefix and of the middle, output) of each text."""
    data, bounds = common.utf8(column)
    counted = automaton(unit, sentinels).scan(data, bounds)
    units = np.cumsum(counted & UNIT, dtype=np.int64)
    points = np.cumsum((counted & POINT) >> 2, dtype=np.int64)
    marks = np.cumsum((counted & SENTINEL) >> 1, dtype=np.int64)
    before = _until(units, bounds)
    n, held = np.diff(before), np.diff(_until(marks, bounds))
    one, two, three, four = draws
    plain = (np.diff(bounds) == 0) | (held > 0) | (three % 100 >= rate)
    cuts = np.sort(np.stack([one % (n + 1), two % (n + 1)]), axis=0)
    begin, end = bounds[:-1], bounds[1:]
    # The k-th unit of a text begins where the running count first exceeds those before it by k + 1.
    place = [np.where(c >= n, end, np.where(c == 0, begin, np.searchsorted(units, before[:-1] + c + 1))) for c in cuts]
    size = [_until(points, b) - _until(points, a) for a, b in ((begin, place[0]), (place[0], place[1]))]
    p, s, m = (x.encode() for x in sentinels)
    raw, rows = data.tobytes(), []
    for a, x, y, b, same, first, k, chars, middle in zip(begin.tolist(), place[0].tolist(), place[1].tolist(), end.tolist(), plain.tolist(), (four % 100 < spm).tolist(), n.tolist(), size[0].tolist(), size[1].tolist(), strict=True):
        if same:
            rows.append((k, "plain", None, None, raw[a:b]))
        elif first:
            rows.append((k, "spm", chars, middle, b"".join([s, raw[y:b], p, raw[a:x], m, raw[x:y]])))
        else:
            rows.append((k, "psm", chars, middle, b"".join([p, raw[a:x], s, raw[y:b], m, raw[x:y]])))
    return rows


def rebuilt(output: str, form: str, sentinels: tuple[str, ...] = SENTINELS) -> str:
    """The text of which ``output`` was made. A text that is cut holds no sentinel, and none can arise at a cut, as each begins with a character that ends none."""
    p, s, m = sentinels
    if form == "plain":
        return output
    first, second = (s, p) if form == "spm" else (p, s)
    if not output.startswith(first):
        raise ValueError(f"not of the form {form}")
    one, found, rest = output[len(first) :].partition(second)
    two, again, middle = rest.partition(m)
    if not found or not again:
        raise ValueError(f"not of the form {form}")
    return two + middle + one if form == "spm" else one + middle + two


def draws(doc_id: str, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits of each row's id, which is empty for a null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(documents: DataFrame, unit: str = "char", sentinels: tuple[str, str, str] = SENTINELS, seed: int = SEED, rate: int = TRANSFORMED, spm: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of ``documents`` (doc_id, text).

    ``n`` counts units; prefix and middle end after numbers of units that the row's id tells. ``rate``
    of a hundred texts are cut, ``spm`` of a hundred of those have the suffix first. Null and empty
    texts, and those that hold a sentinel, stay as they are (form ``plain``). A null id draws as an
    empty one; repeated rows each get a row; an empty table gives an empty result; other columns are
    left out, whatever their names. Texts are worked on whole, which takes about 40 times their bytes.
    """
    if len(sentinels) != 3 or any({c for x in sentinels for c in x[1:]} & {y[0]} for y in sentinels):
        raise ValueError("three sentinels are needed, and the first character of one may not come later in any")

    @F.arrow_udf("struct<n: long, form: string, prefix_chars: long, middle_chars: long, output: string>")
    def cut(text: pa.Array, one: pa.Array, two: pa.Array, three: pa.Array, four: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([text.cast(pa.string()), one, two, three, four], names=["text", "one", "two", "three", "four"])
        rows = []
        for piece in common.pieces([whole]):
            rows += transformed(piece.column(0), [c.to_numpy() for c in piece.columns[1:]], unit, tuple(sentinels), rate, spm)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["n", "form", "prefix_chars", "middle_chars", "output"])

    return documents.select("doc_id", cut(F.col("text"), *draws("doc_id", seed)).alias("_cut")).select("doc_id", "_cut.*")


def restored(rows: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``rows`` of ``fill_in_middle`` with the column ``restored``: each text, rebuilt from output and form alone."""

    @F.arrow_udf("string")
    def back(output: pa.Array, form: pa.Array) -> pa.Array:
        return pa.array([rebuilt(o.as_py(), f.as_py(), sentinels) for o, f in zip(output, form, strict=True)], pa.string())

    return rows.withColumn("restored", back(F.col("output"), F.col("form")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restored(fill_in_middle(common.read(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = """
WITH given AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
drawn AS (SELECT doc_id, t, length(t) AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
                 ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM given),
cut AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
               CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT doc_id, t, n, a, b, form, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
