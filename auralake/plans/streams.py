"""Streaming queries, run over what is there and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..streaming.trajectories import finished, ordered_steps, rocksdb, running_totals, source


@query("ST1", """SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_tumbling(spark, d):
    counts = source(spark, d, "events", closed=True).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return finished(counts, "append").select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "ST2",
    """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, session""",
)
def stream_sessions(spark, d):
    sessions = source(spark, d, "events", closed=True).groupBy(F.session_window("ts", "2 hours"), "user_id").agg(F.count("*").alias("n"))
    return finished(sessions, "append").select("user_id", F.unix_timestamp("session_window.start").alias("start"), "n")


@query("ST3", """SELECT DISTINCT user_id, event_type FROM events""")
def stream_distinct(spark, d):
    keys = source(spark, d, "events").dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")
    return finished(keys, "append")


@query("ST4", """SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS episodes, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def stream_state(spark, d):
    totals = finished(running_totals(source(spark, d, "events")), "update")
    last = totals.groupBy("user_id").agg(F.max(F.struct("n", "episodes", "total")).alias("b"))
    return last.select("user_id", "b.episodes", "b.n", F.round("b.total", 4).alias("total"))


@query(
    "ST4 W3 W9 W7",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS of_kind FROM events),
f AS (SELECT user_id, i, episode, x AS b FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.episode, CASE WHEN e.episode <> f.episode OR f.b IS NULL THEN e.x WHEN e.x IS NULL THEN f.b ELSE 0.5 * f.b + 0.5 * e.x END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT e.user_id, event_id, CAST(e.episode AS BIGINT) AS episode, row_number() OVER (PARTITION BY e.user_id, e.episode ORDER BY e.i) - 1 AS step, floor(b * 1000000 + 0.5) / 1000000 AS belief, of_kind FROM e JOIN f ON f.user_id = e.user_id AND f.i = e.i""",
)
def stream_ordered_steps(spark, d):
    """Episodes and beliefs of a stream, its steps put in order by the watermark."""
    with rocksdb(spark):
        rows = finished(ordered_steps(source(spark, d, "events", closed=True)), "append")
    return rows.withColumn("belief", F.floor(F.col("belief") * 1000000 + 0.5) / 1000000)
