"""Streams over tables of one file and of several, in one and in several micro-batches."""

import shutil

import pytest
from pyspark.sql import functions as F

from auralake.plans import streams
from auralake.streaming import trajectories

FOLDER = "/root/testdata/sf0.001"
QUERIES = ["stream_tumbling", "stream_sessions", "stream_distinct", "stream_state", "stream_ordered_steps"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events as a folder of three part files, each an interval of time, with some rows late by minutes."""
    place = str(tmp_path_factory.mktemp("tables"))
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    late = F.col("ts") - F.make_interval(mins=F.pmod("event_id", F.lit(9)).cast("int"))
    cut = [r.t for r in events.select(F.expr("percentile_approx(unix_micros(cast(ts as timestamp)), array(0.33, 0.66)) as t")).collect()][0]
    micros = F.unix_micros(late.cast("timestamp"))
    part = F.when(micros < cut[0], 0).when(micros < cut[1], 1).otherwise(2)
    for i in range(3):
        events.where(part == i).coalesce(1).write.mode("append").parquet(f"{place}/events.parquet")
    return place


def _rows(frame):
    return sorted(str(tuple(r[c] for c in sorted(frame.columns))) for r in frame.collect())


@pytest.mark.parametrize("name", QUERIES)
def test_a_folder_gives_what_a_file_gives(spark, folder, name):
    run = getattr(streams, name)
    whole = _rows(run(spark, FOLDER))
    assert whole and _rows(run(spark, folder)) == whole


def test_steps_of_several_batches_are_put_in_order(spark, folder, tmp_path):
    """A file a batch; in one run a last file far in the future follows, so that nothing waits any more."""
    place = str(tmp_path / "tables")
    shutil.copytree(folder, place)
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    far = [(F.timestamp_seconds(F.lit(1 << 33)) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1).select(*far).write.mode("append").parquet(f"{place}/events.parquet")
    with trajectories.rocksdb(spark):
        found, some = (trajectories.finished(trajectories.ordered_steps(trajectories.source(spark, d, "events", late="1 hour", files=1)), "append") for d in (place, folder))
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")
        assert _rows(found.withColumn("belief", F.floor(F.col("belief") * 1000000 + 0.5) / 1000000)) == _rows(streams.stream_ordered_steps(spark, FOLDER))
        assert 0 < some.count() < found.count()  # what the watermark has not passed waits
