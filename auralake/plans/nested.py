"""Nested records, noise, merged maps and table functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import nested, noise, signal
from ..operators import grids
from ..operators.windows import order, upto
from ..registry import query
from ..sources.tables import table
from .measures import KEY, STEP

_INFO = """i AS (SELECT o_orderkey, o_custkey % 7 AS reached, o_totalprice / 1000 AS travelled, o_orderstatus = 'F' AS won, o_orderkey % 5 AS hits, o_orderkey % 3 = 0 AS hit, o_custkey % 11 AS far, o_orderpriority AS said FROM orders)"""


@query(
    "PF10 PF11 SC8",
    f"""WITH {_INFO} SELECT o_orderkey, u.name, round(u.value, 6) AS value FROM i, LATERAL (VALUES ('reached', CAST(reached AS DOUBLE)), ('travelled', travelled), ('won', CAST(won AS DOUBLE)), ('collisions.count', CAST(hits AS DOUBLE)), ('collisions.where.far', CAST(far AS DOUBLE))) AS u(name, value)""",
)
def nested_scalars(spark, d):
    """The numbers of an episode's open record, three levels deep, by dotted name; maps and the flag of the last collision are left out."""
    o = table(spark, d, "orders")
    deep = F.struct(F.pmod("o_custkey", F.lit(11)).alias("far"), F.col("o_orderpriority").alias("said"), F.array(F.lit(1)).alias("list"))
    hits = F.struct(F.pmod("o_orderkey", F.lit(5)).alias("count"), (F.pmod("o_orderkey", F.lit(3)) == 0).alias("is_collision"), deep.alias("where"))
    info = F.struct(F.pmod("o_custkey", F.lit(7)).alias("reached"), (F.col("o_totalprice") / 1000).alias("travelled"), (F.col("o_orderstatus") == "F").alias("won"), hits.alias("collisions"), F.struct(F.lit(1).alias("map")).alias("top_down_map"))
    rows = o.select("o_orderkey", F.parse_json(F.to_json(info)).alias("info"))
    return nested.scalars(rows, ["o_orderkey"], "info", ["top_down_map", "is_collision"]).select("o_orderkey", "name", F.round("value", 6).alias("value"))


@query(
    "PF1 SK8",
    """WITH e AS (SELECT vec_id, list_transform(range(1, 65), lambda i: struct_pack(x := CASE WHEN (vec_id + i) % 9 = 0 THEN NULL ELSE CAST(embedding[i] AS DOUBLE) END, far := CASE WHEN (vec_id * i) % 7 = 0 THEN NULL ELSE i END)) AS s FROM embeddings)
SELECT vec_id, len(list_filter(s, lambda v: v.x IS NULL)) AS lost, round(list_sum(list_transform(s, lambda v: coalesce(v.x, 0))), 5) AS total, len(list_filter(s, lambda v: v.far IS NULL)) AS endless, vec_id % 9 = 8 AS first_lost FROM e""",
)
def finite_rows(spark, d):
    """Vectors as lists of records, and as a map of lists, with NaN and infinite numbers as null at every level."""
    e = signal.doubles(F.col("embedding"))
    nan, endless = F.lit(float("nan")), F.lit(float("inf"))
    item = lambda x, i: F.struct(F.when(F.pmod(F.col("vec_id") + i + 1, F.lit(9)) == 0, nan).otherwise(x).alias("x"), F.when(F.pmod(F.col("vec_id") * (i + 1), F.lit(7)) == 0, -endless).otherwise((i + 1).cast("double")).alias("far"))
    items = F.transform(e, item)
    rows = table(spark, d, "embeddings").select("vec_id", items.alias("s"), F.create_map(F.lit("all"), F.struct(F.transform(items, lambda v: v["x"]).alias("list"))).alias("m"))
    clean = nested.finite(rows)
    count = lambda f: F.size(F.filter("s", lambda v: v[f].isNull()))
    total = F.aggregate(F.transform("s", lambda v: F.coalesce(v["x"], F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    return clean.select("vec_id", count("x").alias("lost"), F.round(total, 5).alias("total"), count("far").alias("endless"), F.col("m")["all"]["list"][0].isNull().alias("first_lost"))


@query(
    "M21",
    """WITH c AS (SELECT vec_id, i - 1 AS place, least(abs(CAST(embedding[i] AS DOUBLE)) * 4, 1) AS x FROM embeddings, (SELECT unnest(range(1, 9)) AS i)),
u AS (SELECT *, (CAST(('0x' || substr(sha256('42:' || vec_id || ':' || place || ':r'), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS r, (CAST(('0x' || substr(sha256('42:' || vec_id || ':' || place || ':a'), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS a FROM c)
SELECT vec_id, CAST(place AS INTEGER) AS place, round(CASE WHEN place % 2 = 1 THEN greatest(0, least(1, x + 0.1::DOUBLE * (sqrt(-2 * ln(r)) * cos(2 * pi() * a)))) ELSE x END, 6) AS coefficient FROM u""",
)
def jittered_coefficients(spark, d):
    """A material's coefficients with seeded noise on each second one, alike under any partitioning."""
    c = F.transform(F.slice(signal.doubles(F.col("embedding")), 1, 8), lambda x: F.least(F.abs(x) * 4, F.lit(1.0)))
    rows = table(spark, d, "embeddings").select("vec_id", c.alias("c"))
    return rows.select("vec_id", F.posexplode(noise.jittered(F.col("c"), 0.1, 42, F.col("vec_id"))).alias("place", "x")).select("vec_id", "place", F.round("x", 6).alias("coefficient"))


@query(
    "M19 M17",
    """WITH h AS (SELECT event_id, user_id, ts, event_type, ((sum(CASE event_type WHEN 'view' THEN 90 WHEN 'signup' THEN -90 ELSE 0 END) OVER w) % 360 + 360) % 360 AS heading, row_number() OVER w - 1 AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT user_id, event_id, t, heading, sum(CASE WHEN event_type <> 'click' THEN 0 WHEN heading = 0 THEN 1 WHEN heading = 180 THEN -1 ELSE 0 END) OVER w AS x, sum(CASE WHEN event_type <> 'click' THEN 0 WHEN heading = 90 THEN 1 WHEN heading = 270 THEN -1 ELSE 0 END) OVER w AS y FROM h WINDOW w AS (PARTITION BY user_id ORDER BY t)),
v AS (SELECT user_id, t, x + CASE heading WHEN 0 THEN a WHEN 90 THEN -s WHEN 180 THEN -a ELSE s END AS gx, y + CASE heading WHEN 0 THEN s WHEN 90 THEN a WHEN 180 THEN -s ELSE -a END AS gy, (event_id * 31 + a * 7 + s * 3) % 11 = 0 AS obstacle FROM m, (SELECT unnest(range(1, 4)) AS a), (SELECT unnest(range(-1, 2)) AS s))
SELECT user_id, CAST(gx AS BIGINT) AS x, CAST(gy AS BIGINT) AS y, min(t) AS seen, min(CASE WHEN obstacle THEN t END) AS blocked FROM v GROUP BY 1, 2, 3""",
)
def merged_maps(spark, d):
    """What agents see ahead of them at each step, turned and moved into one map of each environment: since which step a cell is known, and since which as an obstacle."""
    turn = F.when(F.col("event_type") == "view", 90).when(F.col("event_type") == "signup", -90).otherwise(0)
    rows = table(spark, d, "events").select(*KEY, *STEP, "event_type", F.pmod(F.sum(turn).over(upto(KEY, STEP)), F.lit(360)).alias("heading"), (F.row_number().over(order(KEY, STEP)) - 1).alias("step"))
    moved = F.col("event_type") == "click"
    along = lambda plus, minus: F.when(moved & (F.col("heading") == plus), 1).when(moved & (F.col("heading") == minus), -1).otherwise(0)
    poses = rows.select(*KEY, "event_id", "step", "heading", F.sum(along(0, 180)).over(upto(KEY, STEP)).alias("ax"), F.sum(along(90, 270)).over(upto(KEY, STEP)).alias("ay"))
    ahead = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(s).alias("s")) for a in (1, 2, 3) for s in (-1, 0, 1)])
    seen = poses.select("*", F.inline(ahead))
    dx, dy = grids.to_ego(F.col("a"), F.col("s"), F.col("heading"))
    cells = seen.select("user_id", (F.col("ax") + dx).alias("x"), (F.col("ay") + dy).alias("y"), "step", ((F.col("event_id") * 31 + F.col("a") * 7 + F.col("s") * 3) % 11 == 0).alias("obstacle"))
    return grids.merged(cells, ["user_id"])


@udtf(returnType="user_id bigint, episode bigint, steps bigint, reward double, first_event bigint, last_event bigint, finished boolean")
class EpisodeRows:
    """An episode a row, of a table's rows that come by user in the order of time; the last one may be unfinished."""

    def __init__(self):
        self.user, self.episode, self.steps, self.reward, self.first, self.last = None, 0, 0, 0.0, None, None

    def eval(self, row):
        self.user, self.last = row["user_id"], row["event_id"]
        self.first = row["event_id"] if self.first is None else self.first
        self.steps, self.reward = self.steps + 1, self.reward + row["value"]
        if row["event_type"] == "purchase":
            yield self.user, self.episode, self.steps, self.reward, self.first, self.last, True
            self.episode, self.steps, self.reward, self.first = self.episode + 1, 0, 0.0, None

    def terminate(self):
        if self.steps:
            yield self.user, self.episode, self.steps, self.reward, self.first, self.last, False


@query(
    "U4 E1 W3",
    """WITH s AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM events)
SELECT user_id, CAST(episode AS BIGINT) AS episode, count(*) AS steps, round(sum(value), 4) AS reward, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event, bool_or(event_type = 'purchase') AS finished FROM s GROUP BY 1, 2""",
)
def episode_rows(spark, d):
    """Episodes by a table function over the partitioned and ordered table."""
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return EpisodeRows(events.asTable().partitionBy("user_id").orderBy("ts", "event_id")).withColumn("reward", F.round("reward", 4))
