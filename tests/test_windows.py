"""Linear states and running totals against plain loops, with keys that span tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.operators import windows


def _loop(rows):
    out, state, now = {}, None, None
    for key, step, gain, term, first in rows:
        if key != now:
            now, state = key, None
        state = first if state is None else gain * state + term
        out[key, step] = state
    return out


@pytest.mark.parametrize("back", [False, True])
def test_states_of_keys_of_all_lengths(spark, back):
    rng = np.random.default_rng(4)
    rows = []
    for key, n in enumerate([1, 3, 700, 0, 5000, 2, 513, 40]):
        for step in range(n):
            first = None if rng.random() < 0.3 else float(rng.normal())
            rows.append((key, step, float(rng.choice([0.0, 0.5, 0.99, 1.0])), float(rng.normal()), first))
    frame = spark.createDataFrame(rows, "key long, step long, gain double, term double, first double").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found = windows.linear(frame, ["key"], ["step"], F.col("gain"), F.col("term"), F.col("first"), "state", back)
            got = {(r.key, r.step): r.state for r in found.collect()}
            want = _loop(sorted(rows, key=lambda r: (r[0], -r[1] if back else r[1])))
            assert set(got) == set(want)
            for k, v in want.items():
                assert (got[k] is None and v is None) or got[k] == pytest.approx(v, rel=1e-9, abs=1e-9), k
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_long_key_uses_many_tasks(spark):
    n = 300_000
    frame = spark.range(n, numPartitions=4).select(F.lit(1).alias("key"), F.col("id").alias("step"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("x"))
    found = windows.linear(frame, ["key"], ["step"], F.lit(0.999), F.col("x"), F.col("x"), "state")
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 2 and max(r["count"] for r in tasks) < n
    rows = found.orderBy("step").toPandas()
    state, want = None, np.empty(n)
    for i, x in enumerate(rows["x"].tolist()):
        state = x if state is None else 0.999 * state + x
        want[i] = state
    assert np.allclose(rows["state"].to_numpy(), want, rtol=1e-9)


def test_running_totals(spark):
    rng = np.random.default_rng(9)
    values = rng.integers(-5, 6, 1000).tolist()
    frame = spark.createDataFrame(list(enumerate(values)), "t long, v long").repartition(6)
    found = {r.t: r.n for r in windows.running_total(frame, ["t"], "v", "n").collect()}
    assert found == dict(enumerate(np.cumsum(values).tolist()))


def test_percentiles_of_large_and_small_groups(spark, monkeypatch):
    from auralake.operators import summary

    monkeypatch.setattr(summary, "LEAST_ACCURACY", 400)
    rng = np.random.default_rng(3)
    groups = {"normal": rng.normal(size=3000), "few": rng.normal(size=7), "one": np.array([2.5]), "same": np.full(2500, 4.0), "ties": rng.integers(0, 3, 1999).astype(float), "skew": rng.lognormal(sigma=3, size=1201)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("none", None), ("none", float("nan")), ("normal", float("inf"))]
    frame = spark.createDataFrame(rows, "g string, x double").repartition(5)
    found = {r.g: r for r in summary.summarize(frame, "x", ["g"]).collect()}
    assert found["none"]["count"] == 0 and found["none"].median is None
    for g, xs in groups.items():
        assert (found[g]["count"], found[g].min, found[g].max) == (len(xs), xs.min(), xs.max())
        for name, share in summary.SHARES.items():
            assert found[g][name] == pytest.approx(np.quantile(xs, share), rel=1e-12, abs=1e-12), (g, name)
