"""What an agent hears step by step, and signals at other rates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signal
from ..registry import query
from ..sources.tables import table


def _made(rows: DataFrame, make: Callable[..., np.ndarray], names: list[str]) -> DataFrame:
    """(vec_id, names): the columns of what ``make`` gives for a row's other fields, rounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            found = [np.round(make(*row), 6) + 0.0 for row in zip(*fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[:, i] for x in found], pa.list_(pa.float64())) for i in range(len(names))]], names=["vec_id", *names])

    return rows.mapInArrow(run, ", ".join(["vec_id long", *[f"{n} array<double>" for n in names]]))


_WHOLE = "s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings)"


@query(
    "M7",
    f"""WITH {_WHOLE}, q AS (SELECT vec_id, s, vec_id % 4 * 16 AS b, CASE WHEN vec_id % 5 = 0 OR vec_id % 6 > 4 THEN [] ELSE s[3:8] END AS h FROM s)
SELECT vec_id, list_transform(range(b, b + 16), lambda t: round(coalesce(list_sum(list_transform(range(0, len(h)), lambda k: CASE WHEN t - k >= 0 THEN h[k + 1] * s[t - k + 1] ELSE 0 END)), 0), 6) + 0.0) AS l,
  list_transform(range(b, b + 16), lambda t: round(coalesce(list_sum(list_transform(range(0, len(h)), lambda k: CASE WHEN t - k >= 0 THEN h[len(h) - k] * s[t - k + 1] ELSE 0 END)), 0), 6) + 0.0) AS r FROM q""",
)
def step_sound(spark, d):
    """A second of each vector, at 16 samples, in both ears: silent without a response and when the sound's duration is over."""

    def sound(source, index, rir, over):
        room = np.stack([rir, rir[::-1]], 1) if len(rir) and not over else np.zeros((0, 2))
        return signal.heard(source, room, int(index) * 16, 16)

    vec = F.col("vec_id")
    e = signal.doubles(F.col("embedding"))
    rows = table(spark, d, "embeddings").select("vec_id", e.alias("s"), F.pmod(vec, F.lit(4)).alias("index"), F.when(F.pmod(vec, F.lit(5)) != 0, F.slice(e, 3, 6)).otherwise(F.array().cast("array<double>")).alias("rir"), (F.pmod(vec, F.lit(6)) > 4).alias("over"))
    return _made(rows, sound, ["l", "r"])


_FLOW = "round(CASE WHEN i >= 10 THEN 0 WHEN faded AND i <= 2 THEN (2 - i) / 2.0::DOUBLE * {old} + i / 2.0::DOUBLE * {new} ELSE {new} END, 6) + 0.0"


def _through(first: int) -> str:
    return f"list_sum(list_transform(range(0, 5), lambda k: CASE WHEN b + i - k >= 0 THEN s[{first} + k] * s[(b + i - k) % 64 + 1] ELSE 0 END))"


@query(
    "M8 W13",
    f"""WITH {_WHOLE}, q AS (SELECT vec_id, s, vec_id * 10 % 64 AS b, vec_id % 3 <> 0 AS faded FROM s) SELECT vec_id, b AS cursor, list_transform(range(0, 40), lambda i: {_FLOW.format(old=_through(9), new=_through(1))}) AS heard FROM q""",
)
def continuous_sound(spark, d):
    """A quarter second of a source that begins again at its end, padded to a second of 40 samples, blended out of the last response."""

    def sound(source, cursor, faded):
        pad = lambda x: np.pad(x, [(0, 30), (0, 0)])
        now = pad(signal.heard(source, source[:5, None], int(cursor), 10, wrap=True))
        return signal.crossfade(pad(signal.heard(source, source[8:13, None], int(cursor), 10, wrap=True)), now, 40) if faded else now

    cursor = F.pmod(F.col("vec_id") * 10, F.lit(64))
    rows = table(spark, d, "embeddings").select("vec_id", signal.doubles(F.col("embedding")).alias("s"), cursor.alias("cursor"), (F.pmod("vec_id", F.lit(3)) != 0).alias("faded"))
    return _made(rows, sound, ["heard"]).select("vec_id", F.pmod(F.col("vec_id") * 10, F.lit(64)).alias("cursor"), "heard")


@query(
    "M11",
    f"""WITH {_WHOLE}, t AS (SELECT j, CASE WHEN j = 30 THEN 1 ELSE sin(pi() * (j - 30) / 3) / (pi() * (j - 30) / 3) END * list_sum(list_transform(range(0, 30), lambda m: power(power(2.5::DOUBLE * sqrt(greatest(0, 1 - power((j - 30) / 30.0::DOUBLE, 2))), m) / gamma(m + 1), 2))) AS v FROM (SELECT unnest(range(0, 61)) AS j)),
h AS (SELECT list(v * 2 / (SELECT sum(v) FROM t) ORDER BY j) AS h FROM t)
SELECT vec_id, list_transform(range(0, 43), lambda m: round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN m * 3 + 32 - i * 2 BETWEEN 0 AND 60 THEN s[i] * h[m * 3 + 33 - i * 2] ELSE 0 END)), 6) + 0.0) AS x FROM s, h""",
)
def resampled_signals(spark, d):
    """Vectors as signals, from three samples to two."""
    rows = table(spark, d, "embeddings").select("vec_id", signal.doubles(F.col("embedding")).alias("s"))
    return _made(rows, lambda s: signal.resampled(s, 3, 2)[:, None], ["x"])
