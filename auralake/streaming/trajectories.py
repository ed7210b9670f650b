"""Streaming variants of the ordered operators: windows, sessions, duplicates and keyed state."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rounds import shared_folder


def source(spark: SparkSession, folder: str, name: str, closed: bool = False, late: str = "10 minutes", files: int | None = None) -> DataFrame:
    """A table as a stream, with ``ts`` as an event time and a watermark of ``late``; the table is one file or a folder of part files.

    ``closed``: a row far in the future follows, so that the watermark passes all that is there and
    windows are given out and forgotten; its own window never closes. ``files``: how many files a
    micro-batch takes at most; without it, all that are there.
    """
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        rows = reader.parquet(path)
    else:  # a stream watches a folder, of which one file is meant
        rows = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    if closed:
        place = f"{shared_folder(spark)}/closing-{uuid.uuid4().hex}"
        spark.range(1).select(*[(F.timestamp_seconds(F.lit(1 << 33)) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(place)
        rows = rows.unionByName(spark.readStream.schema(schema).parquet(place))
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has given when all input that is there has been read; kept in the checkpoint folder."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    last = mode == "complete"  # such a batch holds everything; of the others each is kept

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{place}/out" if last else f"{place}/out/batch={batch}")

    running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(keep).start()
    running.awaitTermination()
    return spark.read.parquet(f"{place}/out").select(*stream.columns)


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, episodes, n, total): each user's finished episodes, and steps and reward so far."""

    def add(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # a user who has been away for a month begins anew
            state.remove()
            return
        episodes, n, total = state.get if state.exists else (0, 0, 0.0)
        last = 0
        for frame in frames:
            last = max(last, int(frame["ts"].max().timestamp() * 1000))
            episodes += int((frame["event_type"] == "purchase").sum())
            n += len(frame)
            total += float(frame["value"].sum())
        state.update((episodes, n, total))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), last) + 30 * 24 * 3600 * 1000)
        yield pd.DataFrame({"user_id": [key[0]], "episodes": [episodes], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(add, "user_id long, episodes long, n long, total double", "episodes long, n long, total double", "update", GroupStateTimeout.EventTimeTimeout)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State on the executors' disks while queries are started; the session's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


class OrderedSteps(StatefulProcessor):
    """Steps of a key in the order of their time, whatever the order and the batch in which they come.

    Steps wait in a list until the watermark has passed them, which a timer tells if nothing else of the
    key comes. Then they go on in order: ``episode`` counts the finishing steps before one, ``step`` the steps
    of its episode, ``belief`` is the running mean of old and new values of the episode, and ``of_kind`` counts the
    steps of its kind in the key so far, kept in a map. Calls do all their work before they return, while the state is that of their key.
    """

    OUT = "user_id long, event_id long, episode long, step long, belief double, of_kind long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, event_id long, kind string, value double, user_id long")
        self.now = handle.getValueState("now", "episode long, step long, belief double")
        self.kinds = handle.getMapState("kinds", "kind string", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if not key[0]:  # no user
            return iter(())
        came = [(int(t.value // 1_000_000), int(e), k, float(v), int(key[0])) for f in rows for t, e, k, v in zip(f["ts"], f["event_id"], f["event_type"], f["value"], strict=True)]
        self.waiting.appendList(came)
        self.handle.registerTimer(max(r[0] for r in came))
        return iter(self.passed(timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter(self.passed(max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())))

    def passed(self, until: int) -> list[pd.DataFrame]:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted(r for r in held if r[0] <= until)
        if not due:
            return []
        rest = [r for r in held if r[0] > until]
        self.waiting.put(rest) if rest else self.waiting.clear()
        episode, step, belief = self.now.get() if self.now.exists() else (0, 0, math.nan)  # state holds no nulls
        out = []
        counts = {k: self.kinds.getValue((k,))[0] if self.kinds.containsKey((k,)) else 0 for k in sorted({r[2] for r in due})}  # each kind is read and written once a call
        for _, event, kind, value, user in due:
            if kind != "error" and not math.isnan(value):
                belief = value if math.isnan(belief) else 0.5 * belief + 0.5 * value
            counts[kind] += 1
            out.append((user, event, episode, step, belief, counts[kind]))
            step += 1
            if kind == "purchase":
                episode, step, belief = episode + 1, 0, math.nan
        for kind, n in counts.items():
            self.kinds.updateValue((kind,), (n,))
        self.now.update((episode, step, belief))
        frame = pd.DataFrame({c: pd.Series([r[i] for r in out], dtype="float64" if c == "belief" else "int64") for i, c in enumerate(("user_id", "event_id", "episode", "step", "belief", "of_kind"))})
        return [frame]

    def close(self) -> None:
        pass


def _keyed(events: DataFrame) -> DataFrame:
    """Events by a text of their user, empty for none, and without nulls in whole numbers: beside one null, pandas would make all whole numbers of a batch, keys too, to floating ones."""
    return events.select(F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("key"), "ts", F.coalesce("event_id", F.lit(-1)).alias("event_id"), F.coalesce("event_type", F.lit("")).alias("event_type"), "value")


def ordered_steps(events: DataFrame) -> DataFrame:
    """What ``OrderedSteps`` gives for ``events`` (user_id, ts, event_id, event_type, value), which have a watermark on ``ts``; rows without a user are left out."""
    return _keyed(events).groupBy("key").transformWithStateInPandas(OrderedSteps(), OrderedSteps.OUT, "append", "EventTime")
