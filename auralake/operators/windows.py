"""Ordered operators over trajectories: rows of a key in the order of a step."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .rounds import kept


def order(keys: list[str], step: list[str]):
    return Window.partitionBy(*keys).orderBy(*step)


def before(keys: list[str], step: list[str]):
    """All rows of the key before the current one."""
    return order(keys, step).rowsBetween(Window.unboundedPreceding, -1)


def upto(keys: list[str], step: list[str]):
    return order(keys, step).rowsBetween(Window.unboundedPreceding, 0)


def episodes(rows: DataFrame, keys: list[str], step: list[str], done: Column) -> DataFrame:
    """``episode`` numbers the stretches of a key that end with a row for which ``done`` holds."""
    return rows.withColumn("episode", F.coalesce(F.sum(done.cast("int")).over(before(keys, step)), F.lit(0)))


#: Rows of a run up to which states are reckoned one after another, for all runs at once; longer runs are scanned by doubling.
STEPS = 512


def _scanned(gain: np.ndarray, term: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each row of one run makes of the state before the run: ``a * state + b``, or ``c`` if there is none (NaN: none yet)."""
    a, b, c, d = gain.copy(), term.copy(), first.copy(), 1
    while d < len(a):
        c[d:] = np.where(np.isnan(c[:-d]), c[d:], a[d:] * c[:-d] + b[d:])
        b[d:] = a[d:] * b[:-d] + b[d:]
        a[d:] = a[d:] * a[:-d]
        d *= 2
    return a, b, c


def states(bounds: np.ndarray, gain: np.ndarray, term: np.ndarray, first: np.ndarray, before: float) -> np.ndarray:
    """The state after each row of runs that lie between ``bounds``, NaN for none; ``before`` is that before the first run."""
    out = np.empty(len(gain))
    start, size = bounds[:-1], np.diff(bounds)
    for i in np.flatnonzero(size > STEPS).tolist():
        a, b, c = _scanned(*(x[bounds[i] : bounds[i + 1]] for x in (gain, term, first)))
        out[bounds[i] : bounds[i + 1]] = a * before + b if i == 0 and not np.isnan(before) else c
    short = np.flatnonzero(size <= STEPS)
    short = short[np.argsort(-size[short], kind="stable")]
    state = np.full(len(short), np.nan)
    state[short == 0] = before
    for j in range(int(size[short[0]]) if len(short) else 0):
        n = int(np.searchsorted(-size[short], -j, "left"))  # runs that have more than j rows
        at = start[short[:n]] + j
        state[:n] = np.where(np.isnan(state[:n]), first[at], gain[at] * state[:n] + term[at])
        out[at] = state[:n]
    return out


def linear(rows: DataFrame, keys: list[str], step: list[str], gain: Column, term: Column, first: Column, name: str, back: bool = False) -> DataFrame:
    """``rows`` with a state in the column ``name``: ``gain * state + term`` of the state of the row before, or ``first`` where there is none.

    Rows are taken in the order of ``step`` within their keys (against it if ``back``); while ``first`` is null there is
    no state. Rows are dealt by range of (keys, step), so a key of any length is spread over tasks: each task
    tells what its last key's rows make of a state that comes in, one row a task, from which the driver reckons
    what comes in where; then all tasks give their states. Steps of a key have no ties. Columns may not begin with ``_``.
    """
    order_by = [*map(F.col, keys), *[F.col(c).desc() if back else F.col(c) for c in step]]
    number = lambda c: F.coalesce(c.cast("double"), F.lit(float("nan")))
    given = rows.withColumns({"_key": F.xxhash64(*keys), "_gain": number(gain), "_term": number(term), "_first": number(first)})
    dealt = kept(given.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("_part", F.spark_partition_id()))
    fields, own_columns = ("_key", "_gain", "_term", "_first"), rows.columns

    def runs(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        key, *numbers = (batch.column(c).to_numpy(zero_copy_only=False) for c in fields)
        return key, np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]), *numbers

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = head = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, bounds, *numbers = runs(batch)
            if part is None:
                part, head = batch.column("_part")[0].as_py(), int(key[0])
                a, b, c, whole = 1.0, 0.0, np.nan, True
            if len(bounds) > 2 or (last is not None and last != key[0]):
                whole = False
            if whole or (len(bounds) == 2 and last == key[0]):  # the run goes on
                own = (0, len(key))
            else:
                own, (a, b, c) = (int(bounds[-2]), len(key)), (1.0, 0.0, np.nan)
            part_of = [x[own[0] : own[1]] for x in numbers]
            one = np.array([0, own[1] - own[0]])
            c, b, a = float(states(one, *part_of, c)[-1]), float(states(one, part_of[0], part_of[1], np.zeros(one[1]), b)[-1]), a * float(np.prod(part_of[0]))
            last = int(key[-1])
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "head": [head], "last": [last], "a": [a], "b": [b], "c": [c], "whole": [whole]})

    coming: dict[int, float] = {}
    key, state = None, math.nan
    for end in sorted(dealt.select("_part", *fields).mapInArrow(ends, "part long, head long, last long, a double, b double, c double, whole boolean").collect()):
        coming[end.part] = state if key == end.head else math.nan
        going = coming[end.part] if end.whole else math.nan
        key, state = end.last, end.c if math.isnan(going) else end.a * going + end.b

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, math.nan
        for batch in batches:
            if not batch.num_rows:
                continue
            key, bounds, *numbers = runs(batch)
            if last is None:
                state = coming.get(batch.column("_part")[0].as_py(), math.nan)
            elif last != key[0]:
                state = math.nan
            found = states(bounds, *numbers, state)
            last, state = key[-1], float(found[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own_columns), pa.array(found, mask=np.isnan(found))], names=[*own_columns, name])

    return dealt.mapInArrow(scan, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


def running_total(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows up to each one in the order of ``by`` (which has no ties), in the column ``name``.

    Rows are dealt by range; a sum is that within the task plus those of the tasks before, one row a task.
    """
    dealt = kept(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier")
    return dealt.join(sums.select("_part", earlier), "_part").withColumn(name, F.sum(value).over(upto(["_part"], by)) + F.col("_earlier")).drop("_part", "_earlier")


def numbered(rows: DataFrame, keys: list[str], by: list[str], name: str) -> DataFrame:
    """``rows`` with their place from 0 among those of their key in the order of ``by`` (which has no ties), in the column ``name``.

    Rows are dealt by range, so a key with most of the rows is spread over many tasks: a place is that
    within the task plus what earlier tasks hold of the key, which one count a task and key tells.
    """
    dealt = kept(rows.repartitionByRange(*keys, *by).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(before(keys, ["_part"])), F.lit(0)).alias("_earlier")
    offsets = counts.select(*keys, "_part", earlier)
    here = F.row_number().over(order([*keys, "_part"], by)) - 1
    return dealt.withColumn("_here", here).join(offsets, [*keys, "_part"]).withColumn(name, F.col("_here") + F.col("_earlier")).drop("_here", "_earlier", "_part")


def sliding_delta(value: Column, keys: list[str], step: list[str], width: int) -> Column:
    """A cumulative counter's growth over the last ``width`` rows; the value itself on the first row."""
    frame = order(keys, step).rowsBetween(-(width - 1), 0)
    return F.when(F.row_number().over(order(keys, step)) == 1, value).otherwise(value - F.first(value).over(frame))
