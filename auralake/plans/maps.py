"""Maps from depth, lattices among obstacles, turned maps and patched graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal
from ..operators import grids
from ..operators.graph import components, patched
from ..operators.rounds import dealt, kept
from ..operators.windows import linear
from ..registry import query
from ..sources.tables import table
from .measures import STEP, micro
from .spatial import _EDGES, _edges


@query(
    "M15 PF13",
    """WITH px AS (SELECT vec_id, i - 1 AS k, abs(CAST(embedding[i] AS DOUBLE)) * 20 AS depth FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
v AS (SELECT vec_id, (k % 8) * 0.25::DOUBLE - 0.875::DOUBLE AS px, 0.875::DOUBLE - (k // 8) * 0.25::DOUBLE AS py, depth FROM px WHERE depth <> 0 AND depth <= 8),
g AS (SELECT vec_id, px * depth / 0.5::DOUBLE + 8 AS gx, 16 - depth / 0.5::DOUBLE AS gy, py * depth + 1.25::DOUBLE AS h FROM v),
c AS (SELECT vec_id, CAST(floor(gx) AS BIGINT) AS x, CAST(floor(gy) AS BIGINT) AS y, h FROM g WHERE gx BETWEEN 0 AND 15 AND gy BETWEEN 0 AND 15 AND h < 1.5::DOUBLE),
m AS (SELECT vec_id, 'obstacle' AS layer, x, y FROM c WHERE h > 0.2::DOUBLE UNION SELECT vec_id, 'explored', x, y FROM c),
n AS (SELECT a AS dx, b AS dy FROM (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS b)),
w AS (SELECT DISTINCT vec_id, layer, x + dx AS x, y + dy AS y FROM m, n WHERE x + dx BETWEEN 0 AND 15 AND y + dy BETWEEN 0 AND 15),
s AS (SELECT vec_id, layer, x + dx AS x, y + dy AS y, count(*) AS n FROM w, n WHERE x + dx BETWEEN 0 AND 15 AND y + dy BETWEEN 0 AND 15 GROUP BY 1, 2, 3, 4)
SELECT vec_id, x, y, max(CASE WHEN layer = 'obstacle' THEN 1 ELSE 0 END) AS obstacle, 1 AS explored FROM s WHERE n = (CASE WHEN x IN (0, 15) THEN 2 ELSE 3 END) * (CASE WHEN y IN (0, 15) THEN 2 ELSE 3 END) GROUP BY 1, 2, 3""",
)
def depth_map(spark, d):
    """Each embedding as an image of 8 x 8 depths: its points on a ground map of 16 x 16 cells, closed."""
    # Dealt by vec_id, so that all cells of an image stay in one task, of a bounded number of images.
    pixels = dealt(table(spark, d, "embeddings"), 2000, "vec_id").select("vec_id", F.posexplode(signal.doubles(F.col("embedding"))).alias("k", "e")).select("vec_id", "k", (F.abs("e") * 20).alias("depth")).where("depth <> 0 and depth <= 8")
    x = F.pmod("k", F.lit(8)) * 0.25 - 0.875
    y = 0.875 - F.floor(F.col("k") / 8) * 0.25
    points = pixels.select("vec_id", (x * F.col("depth") / 0.5 + 8).alias("gx"), (16 - F.col("depth") / 0.5).alias("gy"), (y * F.col("depth") + 1.25).alias("h")).where("gx between 0 and 15 and gy between 0 and 15 and h < 1.5D")
    layers = F.when(F.col("h") > 0.2, F.array(F.lit("explored"), F.lit("obstacle"))).otherwise(F.array(F.lit("explored")))
    cells = points.select("vec_id", F.explode(layers).alias("layer"), F.floor("gx").alias("x"), F.floor("gy").alias("y")).distinct()
    found = grids.closed(cells, ["vec_id", "layer"], 16, 16)
    return found.groupBy("vec_id", "x", "y").agg(F.max((F.col("layer") == "obstacle").cast("int")).alias("obstacle")).withColumn("explored", F.lit(1))


@query(
    "M19 GR5 GR4 T8",
    """WITH RECURSIVE b AS (SELECT DISTINCT c_nationkey % 5 AS scene, c_custkey % 41 AS x, c_custkey * 7 % 37 AS y FROM customer WHERE c_acctbal < -500),
l AS (SELECT s AS scene, i * 4 AS x, j * 4 AS y, dx, dy FROM (SELECT DISTINCT c_nationkey % 5 AS s FROM customer), (SELECT unnest(range(11)) AS i), (SELECT unnest(range(10)) AS j), (VALUES (4, 0), (0, 4)) AS d(dx, dy) WHERE i * 4 + dx <= 40 AND j * 4 + dy <= 36),
f AS (SELECT scene, scene * 10000 + y * 100 + x AS src, scene * 10000 + (y + dy) * 100 + x + dx AS dst, EXISTS (SELECT 1 FROM b WHERE b.scene = l.scene AND b.x BETWEEN l.x AND l.x + dx AND b.y BETWEEN l.y AND l.y + dy) AS blocked FROM l),
e AS (SELECT src, dst FROM f WHERE NOT blocked UNION SELECT dst, src FROM f WHERE NOT blocked),
r(node, root) AS (SELECT src, src FROM e UNION SELECT e.dst, r.root FROM r JOIN e ON r.node = e.src WHERE e.dst > r.root), c AS (SELECT node, min(root) AS component FROM r GROUP BY node),
z AS (SELECT component // 10000 AS scene, arg_min(component, (-n, component)) AS best FROM (SELECT component, count(*) AS n FROM c GROUP BY 1) GROUP BY 1)
SELECT f.scene, src, dst, blocked, coalesce(component = best, false) AS kept FROM f LEFT JOIN c ON NOT blocked AND c.node = src LEFT JOIN z ON z.scene = f.scene""",
)
def lattice_graph(spark, d):
    """Steps of a lattice that no obstacle blocks, and which of them belong to the largest part of their scene."""
    people = table(spark, d, "customer").select(F.pmod("c_nationkey", F.lit(5)).alias("scene"), "c_custkey", "c_acctbal")
    obstacles = people.where("c_acctbal < -500").select("scene", F.pmod("c_custkey", F.lit(41)).alias("x"), F.pmod(F.col("c_custkey") * 7, F.lit(37)).alias("y")).distinct()
    steps = grids.blocked(grids.lattice(people, ["scene"], 41, 37, 4), obstacles, ["scene"], 4)
    node = lambda x, y: (F.col("scene") * 10000 + y * 100 + x).cast("long")
    steps = kept(steps.select("scene", node(F.col("x"), F.col("y")).alias("src"), node(F.col("x") + F.col("dx"), F.col("y") + F.col("dy")).alias("dst"), "blocked"))
    free = steps.where("not blocked").select("src", "dst")
    edges = free.unionByName(free.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = components(edges.select(F.col("src").alias("node")).distinct(), edges)
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).withColumn("scene", F.floor(F.col("component") / 10000).cast("int"))
    best = sizes.groupBy("scene").agg(F.min(F.struct((-F.col("n")).alias("n"), "component")).alias("b")).select("scene", F.col("b.component").alias("best"))
    joined = steps.join(found, steps.src == found.node, "left").join(best, "scene", "left")
    return joined.select("scene", "src", "dst", "blocked", F.coalesce(~F.col("blocked") & (F.col("component") == F.col("best")), F.lit(False)).alias("kept"))


@query(
    "M16 M17 G16",
    """WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS x, p_partkey % 48 AS y, p_partkey % 4 * 90 AS r FROM part)
SELECT p_partkey, r AS rotation, CASE r WHEN 0 THEN x WHEN 90 THEN y WHEN 180 THEN 63 - x ELSE 47 - y END AS nx, CASE r WHEN 0 THEN y WHEN 90 THEN 63 - x WHEN 180 THEN 47 - y ELSE x END AS ny,
  CASE r WHEN 0 THEN x - 30 WHEN 90 THEN 20 - y WHEN 180 THEN 30 - x ELSE y - 20 END AS ego_x, CASE r WHEN 0 THEN y - 20 WHEN 90 THEN x - 30 WHEN 180 THEN 20 - y ELSE 30 - x END AS ego_y, x AS back_x, y AS back_y FROM p""",
)
def turned_maps(spark, d):
    """Cells of maps turned by quarter turns, offsets from an agent at (30, 20) as it sees them, and back."""
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("x"), F.pmod("p_partkey", F.lit(48)).alias("y"), (F.pmod("p_partkey", F.lit(4)) * 90).alias("rotation"))
    x, y, r = F.col("x"), F.col("y"), F.col("rotation")
    nx, ny = grids.turned(x, y, r, 64, 48)
    ex, ey = grids.to_ego(x - 30, y - 20, r)
    rows = rows.select("p_partkey", "rotation", nx.alias("nx"), ny.alias("ny"), ex.alias("ego_x"), ey.alias("ego_y"))
    bx, by = grids.from_ego(F.col("ego_x"), F.col("ego_y"), r)
    return rows.select("*", (bx + 30).alias("back_x"), (by + 20).alias("back_y"))


@query(
    "W10",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END AS x, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT event_id, user_id, event_type, i, x AS b FROM e WHERE i = 1 UNION ALL SELECT e.event_id, e.user_id, e.event_type, e.i, CASE WHEN f.b = 0 THEN e.x ELSE 0.5 * e.x + 0.5 * f.b END FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.i = f.i + 1)
SELECT event_id, floor(b * 1000000 + 0.5) / 1000000 AS intensity FROM f""",
)
def cell_intensity(spark, d):
    """The intensity that an environment's map holds of a cell after each visit: the first one, then the mean of old and new."""
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", F.when(F.pmod("event_id", F.lit(5)) == 0, 0.0).otherwise(F.col("value")).alias("x"))
    found = linear(rows, ["user_id", "event_type"], STEP, F.lit(0.5), 0.5 * F.col("x"), F.nullif("x", F.lit(0.0)), "b")  # nothing is held until a sound is heard
    return found.select("event_id", micro(F.coalesce("b", F.lit(0.0))).alias("intensity"))


@query(
    "GR6 GR9",
    f"""WITH {_EDGES}, a(src, dst) AS (VALUES (1, 2), (2, 1), (3, 30), (30, 3), (90, 91)), p AS (SELECT src, dst FROM e WHERE src + dst <> 20 UNION SELECT src, dst FROM a), q AS (SELECT src, dst FROM p WHERE (src + dst) % 5 <> 0 AND src <> 7 AND dst <> 7)
SELECT 'patched' AS state, src, dst FROM p UNION ALL SELECT 'episode', src, dst FROM q UNION ALL SELECT 'reset', src, dst FROM p""",
)
def patched_graph(spark, d):
    """A scene's graph with its lasting patches, with the edges and a node that an episode finds blocked gone, and restored."""
    edges = _edges(spark, d)
    added = spark.createDataFrame([(1, 2), (2, 1), (3, 30), (30, 3), (90, 91)], "src long, dst long")
    lasting = patched(edges, edges.where("src + dst = 20"), added)
    found = patched(lasting, lasting.where("(src + dst) % 5 = 0"), nodes=spark.createDataFrame([(7,)], "node long"))
    state = lambda name, rows: rows.select(F.lit(name).alias("state"), "src", "dst")
    return state("patched", lasting).unionByName(state("episode", found)).unionByName(state("reset", lasting))


@query(
    "GR7",
    """WITH RECURSIVE o AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS src, CAST(s_nationkey % 6 + 100 AS BIGINT) AS dst FROM supplier), e AS (SELECT src, dst FROM o UNION SELECT dst, src FROM o),
r(node, root) AS (SELECT src, src FROM e UNION SELECT e.dst, r.root FROM r JOIN e ON r.node = e.src WHERE e.dst > r.root), c AS (SELECT node, min(root) AS component FROM r GROUP BY node)
SELECT c_custkey, coalesce(a.component = b.component, false) AS reachable FROM customer LEFT JOIN c a ON a.node = c_nationkey LEFT JOIN c b ON b.node = c_custkey % 9 + 100""",
)
def reachable_pairs(spark, d):
    """Whether a path leads from one node to another; nodes that are not in the graph reach nothing."""
    one = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("src"), (F.pmod("s_nationkey", F.lit(6)) + 100).cast("long").alias("dst")).distinct()
    edges = kept(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    found = components(edges.select(F.col("src").alias("node")).distinct(), edges)
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
    pairs = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a"), (F.pmod("c_custkey", F.lit(9)) + 100).alias("b"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select("c_custkey", F.coalesce(F.col("a_part") == F.col("b_part"), F.lit(False)).alias("reachable"))
