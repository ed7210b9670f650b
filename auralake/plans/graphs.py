"""Graphs whose nodes grow with the tables: paths in many scenes, goals that agents predict, and long chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, distances, paths
from ..operators.joins import nearest
from ..registry import query
from ..sources.tables import table

#: Parts as the free places of scenes of 6 x 6 cells; large ones are obstacles.
_SCENES = """n AS (SELECT p_partkey AS node, p_partkey // 36 AS scene, p_partkey % 6 AS x, p_partkey % 36 // 6 AS y FROM part WHERE p_size <= 40),
e AS (SELECT a.scene, a.node AS src, b.node AS dst FROM n a JOIN n b ON b.scene = a.scene AND abs(a.x - b.x) + abs(a.y - b.y) = 1)"""


def _scenes(spark, d) -> tuple[DataFrame, DataFrame]:
    """Nodes (scene, node, x, y), and edges (scene, src, dst) between places side by side."""
    key = F.col("p_partkey")
    nodes = table(spark, d, "part").where("p_size <= 40").select(F.floor(key / 36).alias("scene"), key.alias("node"), F.pmod(key, F.lit(6)).alias("x"), F.floor(F.pmod(key, F.lit(36)) / 6).alias("y"))
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (0, 1), (-1, 0), (0, -1))])
    near = nodes.select("scene", F.col("node").alias("src"), "x", "y", F.inline(steps)).select("scene", "src", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    return nodes, near.join(nodes.withColumnRenamed("node", "dst").hint("merge"), ["scene", "x", "y"]).select("scene", "src", "dst")


@query(
    "GR1 GR2",
    f"""WITH RECURSIVE {_SCENES}, s AS (SELECT scene, min(node) AS node FROM n GROUP BY scene),
b(scene, node, hops) AS (SELECT scene, node, 0 FROM s UNION SELECT e.scene, e.dst, hops + 1 FROM b JOIN e ON e.src = b.node WHERE hops < 35), h AS (SELECT scene, node, min(hops) AS hops FROM b GROUP BY 1, 2),
t AS (SELECT h.node, min(g.node) AS parent FROM h JOIN e ON e.dst = h.node JOIN h g ON g.node = e.src AND g.hops = h.hops - 1 GROUP BY h.node),
p(scene, goal, place, node) AS (SELECT scene, node, hops, node FROM h UNION ALL SELECT p.scene, goal, place - 1, parent FROM p JOIN t ON t.node = p.node WHERE place > 0)
SELECT p.scene, goal, CAST(place AS INTEGER) AS place, p.node, x, y FROM p JOIN n ON n.node = p.node""",
)
def shortest_path_points(spark, d):
    """The places that lie on the shortest way from the first place of each scene to each other one, in order."""
    nodes, edges = _scenes(spark, d)
    start = nodes.groupBy("scene").agg(F.min("node").alias("node"))
    tree = distances(edges, start, ["scene"])
    found = paths(tree, tree.select("scene", "node"), ["scene"])
    return found.join(nodes.hint("merge"), ["scene", "node"]).select("scene", F.col("end").alias("goal"), "place", "node", "x", "y")


@query(
    "X6",
    f"""WITH RECURSIVE {_SCENES},
a AS (SELECT c_custkey, c_custkey // 24 AS scene, c_custkey // 24 * 36 + c_custkey % 24 AS start, c_custkey % 6 AS x, c_custkey % 24 // 6 AS y, round_even(c_acctbal / 2500, 0) AS ahead, round_even(c_custkey * 7 % 11 / 2.0 - 2.5, 0) AS aside, radians(CAST(c_nationkey * 30 AS DOUBLE)) AS r FROM customer),
g AS (SELECT c_custkey, scene, start, floor((x + aside * cos(r) - ahead * sin(r)) * 1000 + 0.5) / 1000 AS gx, floor((y - aside * sin(r) - ahead * cos(r)) * 1000 + 0.5) / 1000 AS gy FROM a),
k AS (SELECT c_custkey, arg_min(node, ((gx - n.x) * (gx - n.x) + (gy - n.y) * (gy - n.y), node)) AS goal FROM g JOIN n USING (scene) GROUP BY c_custkey),
b(start, node, hops) AS (SELECT DISTINCT node, node, 0 FROM n JOIN g ON g.start = n.node AND g.scene = n.scene UNION SELECT b.start, e.dst, hops + 1 FROM b JOIN e ON e.src = b.node WHERE hops < 35), h AS (SELECT start, node, min(hops) AS hops FROM b GROUP BY 1, 2)
SELECT g.c_custkey, k.goal, coalesce(h.hops, -1) AS hops FROM g LEFT JOIN k USING (c_custkey) LEFT JOIN h ON h.start = g.start AND h.node = k.goal""",
)
def predicted_goals(spark, d):
    """How far agents are from where they take their goal to be: two numbers, rounded, ahead and aside, turned with the agent and put on the nearest place of its scene; -1 if no way leads there."""
    nodes, edges = _scenes(spark, d)
    key, r = F.col("c_custkey"), F.radians((F.col("c_nationkey") * 30).cast("double"))
    scene = F.floor(key / 24)
    agents = table(spark, d, "customer").select(
        "c_custkey", scene.alias("scene"), (scene * 36 + F.pmod(key, F.lit(24))).alias("start"), F.pmod(key, F.lit(6)).alias("ax"), F.floor(F.pmod(key, F.lit(24)) / 6).alias("ay"),
        F.bround(F.col("c_acctbal") / 2500, 0).alias("ahead"), F.bround(F.pmod(key * 7, F.lit(11)) / 2.0 - 2.5, 0).alias("aside"), r.alias("r"),
    )
    whole = lambda v: F.floor(v * 1000 + 0.5) / 1000
    x = whole(F.col("ax") + F.col("aside") * F.cos("r") - F.col("ahead") * F.sin("r"))
    y = whole(F.col("ay") - F.col("aside") * F.sin("r") - F.col("ahead") * F.cos("r"))
    places = agents.select("c_custkey", "scene", "start", x.alias("x"), y.alias("y"))
    goals = nearest(places.drop("start"), nodes.select("scene", "node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), ["scene"], "c_custkey", "node").select("c_custkey", F.col("node").alias("goal"))
    starts = places.select("scene", "start").distinct().join(nodes.select("scene", F.col("node").alias("start")).hint("merge"), ["scene", "start"]).withColumn("node", F.col("start"))
    hops = distances(edges, starts, ["scene"], ["start"]).select("scene", "start", F.col("node").alias("goal"), "hops")
    return places.select("c_custkey", "scene", "start").join(goals.hint("merge"), "c_custkey", "left").join(hops.hint("merge"), ["scene", "start", "goal"], "left").select("c_custkey", "goal", F.coalesce("hops", F.lit(-1)).alias("hops"))


@query(
    "GR4 GR7 A27",
    """WITH l AS (SELECT o_orderkey, CASE WHEN lag(o_orderkey) OVER w = o_orderkey - 1 AND (o_orderkey - 1) * 7919 % 100 < 97 THEN 0 ELSE 1 END AS fresh FROM orders WINDOW w AS (ORDER BY o_orderkey)),
g AS (SELECT o_orderkey, sum(fresh) OVER (ORDER BY o_orderkey) AS island FROM l) SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY island) AS component, count(*) OVER (PARTITION BY island) AS size FROM g""",
)
def order_islands(spark, d):
    """Orders as nodes of long chains: most are linked with the next key."""
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"))
    links = keys.where((F.col("node") * 7919) % 100 < 97).select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst")).join(keys.withColumnRenamed("node", "dst"), "dst", "left_semi")
    found = components(keys, links)
    return found.join(found.groupBy("component").agg(F.count("*").alias("size")), "component").select(F.col("node").alias("o_orderkey"), "component", "size")


@query(
    "X33 GR3",
    f"""WITH RECURSIVE {_SCENES}, s AS (SELECT scene, min(node) AS node FROM n GROUP BY scene),
b(scene, node, hops) AS (SELECT scene, node, 0 FROM s UNION SELECT e.scene, e.dst, hops + 1 FROM b JOIN e ON e.src = b.node WHERE hops < 35), h AS (SELECT node, min(hops) AS hops FROM b GROUP BY 1),
t AS (SELECT h.node, min(g.node) AS parent FROM h JOIN e ON e.dst = h.node JOIN h g ON g.node = e.src AND g.hops = h.hops - 1 GROUP BY h.node)
SELECT n.node, CASE WHEN m.node IS NULL THEN 'STOP' ELSE CASE ((CASE WHEN m.x > n.x THEN 0 WHEN m.y > n.y THEN 90 WHEN m.x < n.x THEN 180 ELSE 270 END) - n.node % 4 * 90 + 360) % 360 WHEN 0 THEN 'FORWARD' WHEN 90 THEN 'LEFT' WHEN 180 THEN 'LEFT' ELSE 'RIGHT' END END AS action FROM n LEFT JOIN t ON t.node = n.node LEFT JOIN n m ON m.node = t.parent""",
)
def greedy_actions(spark, d):
    """What an agent at each place does next on its way to the first place of its scene; it stops there, and where no way leads."""
    nodes, edges = _scenes(spark, d)
    tree = distances(edges, nodes.groupBy("scene").agg(F.min("node").alias("node")), ["scene"])
    there = tree.where("parent is not null").select("node", "parent").join(nodes.select(F.col("node").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py")).hint("merge"), "parent")
    heading = F.when(F.col("px") > F.col("x"), 0).when(F.col("py") > F.col("y"), 90).when(F.col("px") < F.col("x"), 180).otherwise(270)
    turn = F.pmod(heading - F.pmod("node", F.lit(4)) * 90, F.lit(360))
    action = F.when(F.col("parent").isNull(), "STOP").when(turn == 0, "FORWARD").when(turn <= 180, "LEFT").otherwise("RIGHT")
    return nodes.join(there.hint("merge"), "node", "left").select("node", action.alias("action"))
