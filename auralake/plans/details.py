"""Outcomes of episodes, poses in one another's frames, rollout rows, nested goals and lookups with defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pose, signal
from ..operators.joins import near_in_space
from ..operators.windows import episodes, order
from ..registry import query
from ..sources.tables import table
from .measures import KEY, STEP, micro
from .space import _BOX, _POINTS, _points, points_in_boxes


@query("J24", f"""WITH {_POINTS} SELECT a.id AS receiver, b.id AS source FROM p a JOIN p b ON a.scene = b.scene AND a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) < 0.49 AND abs(a.y - b.y) < 0.9""")
def near_sources(spark, d):
    """Sources that lie near a receiver on the ground, whatever their height within a bound of its own."""
    points = _points(spark, d)
    found = near_in_space(points, points, 0.49, ["scene"], ("x", "z")).where((F.col("l.id") != F.col("r.id")) & (F.abs(F.col("l.y") - F.col("r.y")) < 0.9))
    return found.select(F.col("l.id").alias("receiver"), F.col("r.id").alias("source"))


@query(
    "J16",
    f"""WITH {_POINTS}, b AS (SELECT p_partkey AS box, {_BOX} FROM part) SELECT scene, count(*) AS objects, count_if(hit) AS holding FROM (SELECT b.*, EXISTS (SELECT 1 FROM p WHERE p.scene = b.scene
AND abs((p.x - cx) * cos(turn) + (p.z - cz) * sin(turn)) <= wide + 0.1 AND abs((p.z - cz) * cos(turn) - (p.x - cx) * sin(turn)) <= deep + 0.1) AS hit FROM b) GROUP BY scene""",
)
def objects_per_scene(spark, d):
    """How many objects of each scene have a point in their turned box."""
    objects = table(spark, d, "part").select(F.col("p_partkey").alias("box"), F.pmod("p_partkey", F.lit(5)).cast("int").alias("scene"))
    hit = points_in_boxes(spark, d).select("box", F.lit(True).alias("hit"))
    return objects.join(hit.hint("merge"), "box", "left").groupBy("scene").agg(F.count("*").alias("objects"), F.count_if(F.coalesce("hit", F.lit(False))).alias("holding"))


@query(
    "E5 W15",
    """WITH s AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM events),
m AS (SELECT *, CASE WHEN event_type IN ('click', 'view') AND event_id % 4 <> 0 THEN 1 ELSE 0 END AS moved, coalesce(lag(event_type) OVER w, 'none') AS previous FROM s WINDOW w AS (PARTITION BY user_id, episode ORDER BY ts, event_id)),
e AS (SELECT user_id, CAST(episode AS BIGINT) AS episode, bool_or(event_type = 'purchase') AS success, sum(moved) * 0.25::DOUBLE AS path, arg_min(value, (ts, event_id)) / 20 AS start, arg_max(value, (ts, event_id)) / 20 AS final, CAST(sum(CASE WHEN event_type IN ('click', 'view') AND moved = 0 THEN 1 ELSE 0 END) AS BIGINT) AS collisions, CAST(sum(CASE WHEN previous = event_type THEN 1 ELSE 0 END) AS BIGINT) AS repeats FROM m GROUP BY 1, 2)
SELECT user_id, episode, success, collisions, repeats, round(final, 6) AS distance, floor(CASE WHEN success THEN start / greatest(start, path) ELSE 0 END * 1000000 + 0.5) / 1000000 AS spl, floor(greatest(0, 1 - final / start) * (start / greatest(start, path)) * 1000000 + 0.5) / 1000000 AS soft_spl FROM e WHERE start > 0""",
)
def episode_outcomes(spark, d):
    """Success, path-weighted success, hard and soft, distance left, and steps ahead that a collision has kept in place."""
    rows = episodes(table(spark, d, "events"), KEY, STEP, F.col("event_type") == "purchase")
    ahead = F.col("event_type").isin("click", "view")
    moved = (ahead & (F.pmod("event_id", F.lit(4)) != 0)).cast("int")
    steps = rows.select("*", moved.alias("moved"), F.lag("event_type").over(order([*KEY, "episode"], STEP)).eqNullSafe(F.col("event_type")).alias("again"))
    at = F.struct("ts", "event_id")
    e = steps.groupBy("user_id", "episode").agg(
        F.bool_or(F.col("event_type") == "purchase").alias("success"), (F.sum("moved") * 0.25).alias("path"), (F.min_by("value", at) / 20).alias("start"), (F.max_by("value", at) / 20).alias("final"), F.count_if(ahead & (F.col("moved") == 0)).alias("collisions"), F.count_if("again").alias("repeats")
    ).where("start > 0")
    share = F.col("start") / F.greatest("start", "path")
    return e.select("user_id", "episode", "success", "collisions", "repeats", F.round("final", 6).alias("distance"), micro(F.when(F.col("success"), share).otherwise(0.0)).alias("spl"), micro(F.greatest(F.lit(0.0), 1 - F.col("final") / F.col("start")) * share).alias("soft_spl"))


@query(
    "G3 G7 G10 G11 G14",
    """WITH t AS (SELECT s_suppkey, s_acctbal / 1000 AS ax, s_nationkey - 12.0::DOUBLE AS ay, radians(CAST(s_suppkey * 37 % 360 AS DOUBLE)) AS ah, s_acctbal / 700 - 1 AS bx, s_nationkey / 2.0::DOUBLE + 1 AS by_, radians(CAST(s_suppkey * 53 % 360 AS DOUBLE)) AS bh, s_suppkey % 50 AS age FROM supplier),
r AS (SELECT *, (bx - ax) * cos(ah) + (by_ - ay) * sin(ah) AS x, (by_ - ay) * cos(ah) - (bx - ax) * sin(ah) AS y FROM t)
SELECT s_suppkey, round(x, 5) AS x, round(y, 5) AS y, round(cos(bh - ah), 5) AS c, round(sin(bh - ah), 5) AS s, round(exp(-age / 10.0), 6) AS fade, round(sqrt(x * x + y * y), 5) AS far, round(degrees(atan2(y, x)), 3) AS polar, round(ax + x * cos(ah) - y * sin(ah), 5) AS back_x, round(ay + x * sin(ah) + y * cos(ah), 5) AS back_y, round(((degrees(ah) - 45 + 180) % 360 + 360) % 360 - 180, 5) AS right_yaw FROM r""",
)
def relative_poses(spark, d):
    """A second pose in the frame of a first one, as a tuple that fades with its age and in polar form, and from there back into the world."""
    turn = lambda k: F.radians(F.pmod(F.col("s_suppkey") * k, F.lit(360)).cast("double"))
    t = table(spark, d, "supplier").select(
        "s_suppkey", (F.col("s_acctbal") / 1000).alias("ax"), (F.col("s_nationkey") - 12.0).alias("ay"), turn(37).alias("ah"), (F.col("s_acctbal") / 700 - 1).alias("bx"), (F.col("s_nationkey") / 2.0 + 1).alias("by"), turn(53).alias("bh"), F.pmod("s_suppkey", F.lit(50)).alias("age")
    )
    x, y = pose.into_frame(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("ah"))
    r = t.select("*", x.alias("x"), y.alias("y"))
    back_x, back_y = pose.out_of_frame(F.col("x"), F.col("y"), F.col("ah"))
    off = F.col("bh") - F.col("ah")
    return r.select(
        "s_suppkey", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.round(F.cos(off), 5).alias("c"), F.round(F.sin(off), 5).alias("s"), F.round(F.exp(-F.col("age") / 10.0), 6).alias("fade"), F.round(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), 5).alias("far"),
        F.round(F.degrees(F.atan2("y", "x")), 3).alias("polar"), F.round(F.col("ax") + back_x, 5).alias("back_x"), F.round(F.col("ay") + back_y, 5).alias("back_y"), F.round(pose.normalize_yaw(F.degrees("ah") - 45), 5).alias("right_yaw"),
    )


@query(
    "X8",
    """WITH s AS (SELECT event_id, user_id, row_number() OVER w - 1 AS t, coalesce(lag(event_type) OVER w, 'none') AS action, CASE WHEN lag(event_type) OVER w = 'purchase' THEN 0 ELSE 1 END AS mask FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, t // 16 AS rollout, t % 16 + 1 AS place, event_id, action, mask FROM s UNION ALL SELECT user_id, t // 16 + 1, 0, event_id, action, mask FROM s WHERE t % 16 = 15)
SELECT user_id, rollout, CAST(place AS INTEGER) AS place, event_id, action AS previous_action, mask FROM r""",
)
def rollout_rows(spark, d):
    """Steps in rollouts of sixteen: the action and the mask that a step follows, and the last row of a rollout as row 0 of the next."""
    w = order(KEY, STEP)
    steps = table(spark, d, "events").select("event_id", "user_id", (F.row_number().over(w) - 1).alias("t"), F.coalesce(F.lag("event_type").over(w), F.lit("none")).alias("previous_action"), F.when(F.lag("event_type").over(w) == "purchase", 0).otherwise(1).alias("mask"))
    own = F.struct(F.floor(F.col("t") / 16).alias("rollout"), (F.pmod("t", F.lit(16)) + 1).cast("int").alias("place"))
    carried = F.when(F.pmod("t", F.lit(16)) == 15, F.struct((F.floor(F.col("t") / 16) + 1).alias("rollout"), F.lit(0).alias("place")))
    return steps.select("user_id", F.inline(F.array_compact(F.array(own, carried))), "event_id", "previous_action", "mask")


@query(
    "X18 A19",
    """WITH old AS (SELECT DISTINCT user_id, event_id % 40 AS view FROM events WHERE event_type = 'view'), fresh AS (SELECT user_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_id % 40 END AS view FROM events WHERE event_type = 'signup'),
n AS (SELECT user_id, view, count(*) AS n FROM fresh GROUP BY 1, 2) SELECT user_id, view, n, CASE WHEN view IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'there already' END AS problem FROM n WHERE view IS NULL OR n > 1 OR EXISTS (SELECT 1 FROM old WHERE old.user_id = n.user_id AND old.view = n.view)""",
)
def viewpoint_guard(spark, d):
    """Keys of new viewpoints that are incomplete, come twice, or are there already."""
    events = table(spark, d, "events")
    view = F.pmod("event_id", F.lit(40))
    old = events.where("event_type = 'view'").select("user_id", view.alias("view")).distinct().withColumn("there", F.lit(True))
    new = events.where("event_type = 'signup'").select("user_id", F.when(F.pmod("event_id", F.lit(97)) != 0, view).alias("view")).groupBy("user_id", "view").agg(F.count("*").alias("n"))
    problem = F.when(F.col("view").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.col("there"), "there already")
    return new.join(old, ["user_id", "view"], "left").select("user_id", "view", "n", problem.alias("problem")).where("problem is not null")


@query(
    "X23 X24",
    """WITH g AS (SELECT vec_id, unnest(range(0, 3)) AS goal, embedding AS e FROM embeddings), p AS (SELECT vec_id, goal, unnest(range(0, 2)) AS point, e FROM g)
SELECT vec_id, CAST(goal AS INTEGER) AS goal, CAST(point AS INTEGER) AS point, round(CAST(e[goal * 8 + point * 3 + 2] AS DOUBLE) + CASE WHEN goal = 0 THEN 0.1 ELSE 0 END, 6) AS y, 0.0::DOUBLE AS iou, round(CAST(e[goal * 8 + 8] AS DOUBLE) + CASE WHEN goal = 0 THEN 0.1 ELSE 0 END, 6) AS goal_y FROM p""",
)
def nested_goals(spark, d):
    """Goals with view points two levels down: the first goal is raised, its points with it, and every point's overlap is zero."""
    e = signal.doubles(F.col("embedding"))
    point = lambda g, p: F.struct(F.slice("e", g * 8 + p * 3 + 1, F.lit(3)).alias("position"), F.get("e", g * 8 + p).alias("iou"))
    goal = lambda g: F.struct(F.array(F.get("e", g * 8 + 6), F.get("e", g * 8 + 7)).alias("position"), F.transform(F.sequence(F.lit(0), F.lit(1)), lambda p: point(g, p)).alias("view_points"))
    rows = table(spark, d, "embeddings").select("vec_id", e.alias("e")).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(2)), goal).alias("goals"))
    up = lambda position, i: F.transform(position, lambda x, k: x + F.when((k == 1) & (i == 0), 0.1).otherwise(0.0))
    raised = F.transform("goals", lambda g, i: F.struct(up(g["position"], i).alias("position"), F.transform(g["view_points"], lambda v: F.struct(up(v["position"], i).alias("position"), F.lit(0.0).alias("iou"))).alias("view_points")))
    flat = rows.select("vec_id", F.posexplode(raised).alias("goal", "g")).select("vec_id", "goal", "g", F.posexplode("g.view_points").alias("point", "v"))
    return flat.select("vec_id", "goal", "point", signal.rounded(F.col("v.position")[1], 6).alias("y"), F.col("v.iou").alias("iou"), signal.rounded(F.col("g.position")[1], 6).alias("goal_y"))


@query(
    "J11",
    """WITH i AS (SELECT o_orderkey, CASE WHEN o_custkey % 40 < 30 THEN o_custkey % 40 ELSE 0 END AS instance FROM orders) SELECT o_orderkey, instance, coalesce(CASE WHEN n_regionkey < 4 THEN CAST(n_regionkey AS INTEGER) * 5 END, 21) AS task FROM i LEFT JOIN nation ON n_nationkey = instance""",
)
def instance_tasks(spark, d):
    """What is seen to what it is to the task's number: an instance out of range is the first one, a kind without a task has number 21."""
    key = F.pmod("o_custkey", F.lit(40))
    seen = table(spark, d, "orders").select("o_orderkey", F.when(key < 30, key).otherwise(0).alias("instance"))
    kinds = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("instance"), F.col("n_regionkey").alias("kind"))
    tasks = table(spark, d, "region").where("r_regionkey < 4").select(F.col("r_regionkey").alias("kind"), (F.col("r_regionkey") * 5).alias("task"))
    return seen.join(kinds, "instance", "left").join(tasks, "kind", "left").select("o_orderkey", "instance", F.coalesce("task", F.lit(21)).alias("task"))


@query(
    "M9",
    """WITH p AS (SELECT c_custkey, c_acctbal / 1000 AS x, c_custkey % 97 / 10.0::DOUBLE - 2 AS z FROM customer), q AS (SELECT c_custkey, CAST(floor((z + 1.5) / 0.25) AS BIGINT) AS row_, CAST(floor((x + 0.5) / 0.25) AS BIGINT) AS col FROM p)
SELECT c_custkey, CASE WHEN row_ BETWEEN 0 AND 29 AND col BETWEEN 0 AND 19 THEN row_ END AS row_, CASE WHEN row_ BETWEEN 0 AND 29 AND col BETWEEN 0 AND 19 THEN col END AS col FROM q""",
)
def map_pixels(spark, d):
    """Where on a map of 30 x 20 cells a place lies; null outside of it."""
    x, z = F.col("c_acctbal") / 1000, F.pmod("c_custkey", F.lit(97)) / 10.0 - 2
    q = table(spark, d, "customer").select("c_custkey", F.floor((z + 1.5) / 0.25).alias("row_"), F.floor((x + 0.5) / 0.25).alias("col"))
    inside = F.col("row_").between(0, 29) & F.col("col").between(0, 19)
    return q.select("c_custkey", F.when(inside, F.col("row_")).alias("row_"), F.when(inside, F.col("col")).alias("col"))
