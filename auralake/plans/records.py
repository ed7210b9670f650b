"""Records of runs: lookups, checkpoints, buffers, reports and draws."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.summary import summarize
from ..operators.windows import numbered, order, upto
from ..registry import query
from ..sources.tables import table
from .measures import KEY, STEP


@query(
    "X3 X17",
    """SELECT conv_id, arg_min(role, turn) AS goal_role, length(arg_min(text, turn)) AS goal_chars, conv_id % 5 AS offset_, max(turn) + 1 AS duration, coalesce(min(CASE WHEN role = 'system' THEN turn END), -1) AS pose FROM conversations GROUP BY conv_id""",
)
def agent_config(spark, d):
    """What an episode tells its agent: its first goal, an offset, a duration and a pose where it has one."""
    goal = F.struct("turn", "role", "text")
    episodes = table(spark, d, "conversations").groupBy("conv_id").agg(F.min(goal).alias("goal"), F.max("turn").alias("last"), F.min(F.when(F.col("role") == "system", F.col("turn"))).alias("pose"))
    return episodes.select("conv_id", F.col("goal.role").alias("goal_role"), F.length("goal.text").alias("goal_chars"), F.pmod("conv_id", F.lit(5)).alias("offset_"), (F.col("last") + 1).alias("duration"), F.coalesce("pose", F.lit(-1)).alias("pose"))


@query(
    "T6 SC14 S10",
    """WITH f AS (SELECT p_brand AS folder, 'ckpt.' || p_size || '.pth' AS name, max(p_retailprice) AS mtime FROM part GROUP BY 1, 2), n AS (SELECT *, CAST(regexp_extract(name, '\\.([0-9]+)\\.', 1) AS INTEGER) AS suffix FROM f)
SELECT folder, name, row_number() OVER (PARTITION BY folder ORDER BY suffix) - 1 AS nth, row_number() OVER (PARTITION BY folder ORDER BY mtime, name) - 1 AS nth_by_time, suffix = max(suffix) OVER (PARTITION BY folder) AS last_ FROM n""",
)
def checkpoint_order(spark, d):
    """Checkpoints of a folder by the number in their name and by the time of writing."""
    files = table(spark, d, "part").groupBy(F.col("p_brand").alias("folder"), F.concat(F.lit("ckpt."), "p_size", F.lit(".pth")).alias("name")).agg(F.max("p_retailprice").alias("mtime"))
    files = files.withColumn("suffix", F.regexp_extract("name", r"\.([0-9]+)\.", 1).cast("int"))
    own = Window.partitionBy("folder")
    return files.select("folder", "name", (F.row_number().over(own.orderBy("suffix")) - 1).alias("nth"), (F.row_number().over(own.orderBy("mtime", "name")) - 1).alias("nth_by_time"), (F.col("suffix") == F.max("suffix").over(own)).alias("last_"))


@query(
    "J12 S6",
    """WITH n AS (SELECT printf('%.2f', n_nationkey / 4.0) || '_' || printf('%.2f', n_regionkey * 1.0) AS key, n_nationkey AS node FROM nation)
SELECT c_custkey, node, node IS NULL AS missing FROM customer LEFT JOIN n ON key = printf('%.2f', c_nationkey / 4.0) || '_' || printf('%.2f', (c_custkey % 5) * 1.0)""",
)
def position_lookup(spark, d):
    """Nodes by positions written with two digits; ``missing`` marks positions that no node has."""
    two = lambda c: F.call_function("format_number", c, F.lit("0.00"))
    key = lambda x, y: F.concat_ws("_", two(x.cast("double")), two(y.cast("double")))
    nodes = table(spark, d, "nation").select(key(F.col("n_nationkey") / 4, F.col("n_regionkey")).alias("key"), F.col("n_nationkey").alias("node"))
    asked = table(spark, d, "customer").select("c_custkey", key(F.col("c_nationkey") / 4, F.pmod("c_custkey", F.lit(5))).alias("key"))
    return asked.join(nodes, "key", "left").select("c_custkey", "node", F.col("node").isNull().alias("missing"))


@query("J22", """WITH k AS (SELECT vec_id, label || '_' || vec_id % 3 AS goals_key FROM embeddings) SELECT vec_id, goals_key, min(vec_id) OVER (PARTITION BY goals_key) AS goals FROM k""")
def goal_lookup(spark, d):
    """Goals kept once for each key, and looked up again by the episodes."""
    rows = table(spark, d, "embeddings").select("vec_id", F.concat_ws("_", "label", F.pmod("vec_id", F.lit(3))).alias("goals_key"))
    return rows.join(rows.groupBy("goals_key").agg(F.min("vec_id").alias("goals")), "goals_key")


@query(
    "J5",
    """SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'no candidate' WHEN NOT c_acctbal > 0 THEN 'invalid candidate' ELSE 'other action' END AS problem FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON c_custkey = o_custkey
WHERE NOT coalesce(c_acctbal > 0 AND c_nationkey % 5 = o_orderkey % 5, false)""",
)
def viewpoint_candidates(spark, d):
    """Viewpoints whose candidate is missing, invalid or of another action."""
    candidates = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey", (F.col("c_acctbal") > 0).alias("valid"), F.pmod("c_nationkey", F.lit(5)).alias("action"))
    joined = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(candidates, F.col("c_custkey") == F.col("o_custkey"), "left")
    fine = F.col("valid") & (F.col("action") == F.pmod("o_orderkey", F.lit(5)))
    problem = F.when(F.col("c_custkey").isNull(), "no candidate").when(~F.col("valid"), "invalid candidate").otherwise("other action")
    return joined.where(~F.coalesce(fine, F.lit(False))).select("o_orderkey", problem.alias("problem"))


@query(
    "X7 X27",
    """WITH n AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events),
u AS (SELECT user_id, list(event_id ORDER BY back DESC) FILTER (back <= 6) AS memory FROM n GROUP BY user_id HAVING NOT bool_or(back = 1 AND event_type = 'error'))
SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS env, memory FROM u""",
)
def ring_read(spark, d):
    """A buffer of six slots read from the oldest entry on; environments that end in an error are paused and the others move up."""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", (F.row_number().over(order(KEY, STEP)) - 1).alias("step"))
    slots = rows.groupBy("user_id", F.pmod("step", F.lit(6)).alias("slot")).agg(F.max(F.struct("step", "event_id", "event_type")).alias("b"))
    rings = slots.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("slot", "b.event_id"))).alias("s"), F.max(F.struct("b.step", "b.event_type")).alias("last"))
    start = F.when(F.size("s") < 6, 0).otherwise(F.pmod(F.col("last.step") + 1, F.lit(6))).cast("int")
    entries = F.transform("s", lambda x: x["event_id"])
    read = rings.select("user_id", F.concat(F.slice(entries, start + 1, F.size("s") - start), F.slice(entries, F.lit(1), start)).alias("memory"), F.col("last.event_type").alias("last"))
    paused = read.where("last = 'error'").select("user_id")
    return numbered(read.join(paused, "user_id", "left_anti").drop("last"), [], ["user_id"], "env").select("user_id", "env", "memory")


_FIELDS = """u AS (SELECT 'acctbal' AS field, c_acctbal AS x FROM customer UNION ALL SELECT 'totalprice', o_totalprice FROM orders)"""


def _fields(spark, d):
    take = lambda t, c, name: table(spark, d, t).select(F.lit(name).alias("field"), F.col(c).cast("double").alias("x"))
    return summarize(take("customer", "c_acctbal", "acctbal").unionByName(take("orders", "o_totalprice", "totalprice")), "x", ["field"])


#: What a threshold would rest on: its name, the distribution and the percentile that speaks for it.
EVIDENCE = [("least_balance", "acctbal", "p05"), ("most_balance", "acctbal", "p95"), ("most_price", "totalprice", "p95"), ("same_price", "totalprice", "p05")]


@query(
    "V7",
    f"""WITH {_FIELDS}, q AS (SELECT field, round(quantile_cont(x, 0.05), 6) AS p05, round(quantile_cont(x, 0.95), 6) AS p95 FROM u GROUP BY 1), s(name, field, percentile) AS (VALUES {", ".join(map(str, EVIDENCE))})
SELECT name, percentile, CASE percentile WHEN 'p05' THEN p05 ELSE p95 END AS value, CAST(NULL AS DOUBLE) AS proposed_value, 'needs review' AS status FROM s JOIN q USING (field)""",
)
def threshold_proposals(spark, d):
    """Percentiles as evidence for thresholds, which are never proposed by themselves."""
    specs = spark.createDataFrame(EVIDENCE, "name string, field string, percentile string")
    found = specs.join(_fields(spark, d), "field")
    return found.select("name", "percentile", F.round(F.when(F.col("percentile") == "p05", F.col("p05")).otherwise(F.col("p95")), 6).alias("value"), F.lit(None).cast("double").alias("proposed_value"), F.lit("needs review").alias("status"))


@query(
    "X31 SK6",
    f"""WITH {_FIELDS}, q AS (SELECT field, '| ' || field || ' | ' || count(x) || ' | ' || printf('%.4f', quantile_cont(x, 0.5)) || ' | ' || printf('%.4f', max(x)) || ' |' AS line FROM u GROUP BY field) SELECT '| field | count | median | max |' || chr(10) || '|-|-|-|-|' || chr(10) || string_agg(line, chr(10) ORDER BY field) AS markdown FROM q""",
)
def markdown_summary(spark, d):
    four = lambda c: F.call_function("format_number", F.col(c), F.lit("0.0000"))
    lines = _fields(spark, d).select("field", F.concat(F.lit("| "), F.concat_ws(" | ", "field", "count", four("median"), four("max")), F.lit(" |")).alias("line"))
    rows = lines.agg(F.sort_array(F.collect_list(F.struct("field", "line"))).alias("s"))
    return rows.select(F.concat_ws("\n", F.lit("| field | count | median | max |"), F.lit("|-|-|-|-|"), F.transform("s", lambda x: x["line"])).alias("markdown"))


@query(
    "A2 PF5",
    """WITH r AS (SELECT l_returnflag AS scene, CASE WHEN l_discount >= 0.09 THEN 'snap_failed' WHEN l_tax >= 0.07 THEN 'outside_map' END AS reason FROM lineitem), h AS (SELECT scene, reason, count(*) AS n FROM r GROUP BY 1, 2)
SELECT scene, reason, n, reason IS NULL AS valid, round(n / sum(n) OVER (PARTITION BY scene), 6) AS share FROM h""",
)
def reason_histogram(spark, d):
    """How often each reason makes a candidate invalid in a scene, valid ones under the null reason, and the shares."""
    reason = F.when(F.col("l_discount") >= 0.09, "snap_failed").when(F.col("l_tax") >= 0.07, "outside_map")
    counts = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("scene"), reason.alias("reason")).agg(F.count("*").alias("n"))
    return counts.select("scene", "reason", "n", F.col("reason").isNull().alias("valid"), F.round(F.col("n") / F.sum("n").over(Window.partitionBy("scene")), 6).alias("share"))


@query(
    "A9 A11",
    """WITH w AS (SELECT user_id % 8 AS worker, avg(value) AS m, avg(value * value) AS q, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS done, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY 1), a AS (SELECT avg(m) AS mean, avg(q) - avg(m) * avg(m) AS var_ FROM w)
SELECT worker, done, n, round(mean, 4) AS mean, round(var_, 4) AS var_ FROM w, a""",
)
def worker_moments(spark, d):
    """Sums over finished episodes of each worker, and mean and variance as the mean of the workers' own."""
    ended = F.col("event_type") == "purchase"
    workers = table(spark, d, "events").groupBy(F.pmod("user_id", F.lit(8)).alias("worker")).agg(F.avg("value").alias("m"), F.avg(F.col("value") * F.col("value")).alias("q"), F.round(F.sum(F.when(ended, F.col("value")).otherwise(0.0)), 4).alias("done"), F.count_if(ended).alias("n"))
    mean = workers.agg(F.avg("m")).scalar()
    variance = workers.agg(F.avg("q") - F.avg("m") * F.avg("m")).scalar()
    return workers.select("worker", "done", "n", F.round(mean, 4).alias("mean"), F.round(variance, 4).alias("var_"))


@query(
    "A20 SC12 Q2",
    """WITH s AS (SELECT user_id, event_id AS step, value, event_type AS tag FROM events), u AS (SELECT DISTINCT user_id FROM s)
SELECT user_id, coalesce((SELECT arg_min(step, (-value, step)) FROM s WHERE s.user_id = u.user_id AND value > 0 AND contains(tag, 'c')), -1) AS loose, coalesce((SELECT arg_min(step, (-value, step)) FROM s WHERE s.user_id = u.user_id AND value > 0 AND tag = 'click'), -1) AS strict_ FROM u""",
)
def best_tagged(spark, d):
    """The first step with the highest score above zero of the scalars whose tag contains a text, and of those whose tag is one."""
    best = lambda tagged: F.coalesce(F.min(F.when(tagged & (F.col("value") > 0), F.struct((-F.col("value")).alias("v"), F.col("event_id").alias("step"))))["step"], F.lit(-1))
    return table(spark, d, "events").groupBy("user_id").agg(best(F.col("event_type").contains("c")).alias("loose"), best(F.col("event_type") == "click").alias("strict_"))


@query(
    "A15 A16",
    """WITH p AS (SELECT page_id % 50 AS episode, page_id, strlen(html) AS size, url LIKE '%?%' AS asked FROM pages WHERE url NOT LIKE '%_SUCCESS')
SELECT episode, count(*) FILTER (asked) AS asked_files, CAST(coalesce(sum(size) FILTER (asked), 0) AS BIGINT) AS asked_bytes, count(*) FILTER (NOT asked) AS plain_files, CAST(coalesce(sum(size) FILTER (NOT asked), 0) AS BIGINT) AS plain_bytes, list(page_id ORDER BY page_id) AS files FROM p GROUP BY episode""",
)
def episode_storage(spark, d):
    """Files and bytes of each episode by kind, and the list of its files."""
    asked, size = F.col("url").contains("?"), F.octet_length("html")
    total = lambda which: F.coalesce(F.sum(F.when(which, size)), F.lit(0)).cast("long")
    rows = table(spark, d, "pages").where(~F.col("url").endswith("_SUCCESS"))
    return rows.groupBy(F.pmod("page_id", F.lit(50)).alias("episode")).agg(F.count_if(asked).alias("asked_files"), total(asked).alias("asked_bytes"), F.count_if(~asked).alias("plain_files"), total(~asked).alias("plain_bytes"), F.sort_array(F.collect_list("page_id")).alias("files"))


@query("J23", """SELECT p_brand AS material, list(DISTINCT p_type ORDER BY p_type) AS categories FROM part GROUP BY p_brand""")
def material_inverse(spark, d):
    """Materials of each category turned into categories of each material."""
    known = table(spark, d, "part").groupBy("p_type").agg(F.collect_set("p_brand").alias("materials"))
    return known.select("p_type", F.explode("materials").alias("material")).groupBy("material").agg(F.sort_array(F.collect_set("p_type")).alias("categories"))


#: Four moves of a metre and two turns, by kind, heading and amount.
ACTIONS = [("move", 0, 1.0), ("move", 90, 1.0), ("move", 180, 1.0), ("move", 270, 1.0), ("turn", 0, 45.0), ("turn", 0, -45.0)]


@query("J19", f"""WITH a(kind, heading, amount) AS (VALUES {", ".join(map(str, ACTIONS))}) SELECT o_orderkey, kind, heading, CAST(amount AS DOUBLE) AS amount, round((heading + o_custkey * 37) % 360 - 180.0, 1) AS yaw FROM orders, a""")
def candidate_actions(spark, d):
    """Each episode's candidates: four moves and two turns."""
    actions = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(h).alias("heading"), F.lit(a).alias("amount")) for k, h, a in ACTIONS])
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.inline(actions)).select("o_orderkey", "kind", "heading", "amount", F.round(F.pmod(F.col("heading") + F.col("o_custkey") * 37, F.lit(360)) - 180.0, 1).alias("yaw"))


@query("X25", """SELECT p_partkey, [p_partkey % 40 * 67 % 256, p_partkey % 40 * 131 % 256, p_partkey % 40 * 199 % 256] AS rgb FROM part""")
def palette_rgb(spark, d):
    """The colour of an object, from a table of 40."""
    colours = F.array(*[F.array(*[F.lit(i * f % 256) for f in (67, 131, 199)]) for i in range(40)])
    return table(spark, d, "part").select("p_partkey", F.get(colours, F.pmod("p_partkey", F.lit(40)).cast("int")).alias("rgb"))


@query(
    "X4",
    """SELECT event_id, event_type = 'purchase' AND CASE WHEN user_id % 2 = 0 THEN value / 100 < 1 ELSE event_id % 10 = user_id % 10 END AS success FROM events""",
)
def stop_success(spark, d):
    """Success at a stop: near enough in continuous space, at the goal's node on a graph."""
    there = F.when(F.pmod("user_id", F.lit(2)) == 0, F.col("value") / 100 < 1).otherwise(F.pmod("event_id", F.lit(10)) == F.pmod("user_id", F.lit(10)))
    return table(spark, d, "events").select("event_id", ((F.col("event_type") == "purchase") & there).alias("success"))


@query(
    "X13 X15",
    """WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS x, p_partkey % 50 AS y FROM part)
SELECT p_partkey, list_transform(range(CAST(trunc(-x / 4.0) AS BIGINT), CAST(trunc((100 - x) / 4.0) AS BIGINT)), lambda n: x + n * 4) AS xs, list_transform(range(CAST(trunc(-y / 4.0) AS BIGINT), CAST(trunc((100 - y) / 4.0) AS BIGINT)), lambda n: y + n * 4) AS ys, x - 100 * 0.05::DOUBLE AS least_x, x + 100 * 0.05::DOUBLE AS most_x, y - 100 * 0.05::DOUBLE AS least_y, y + 100 * 0.05::DOUBLE AS most_y FROM p""",
)
def lattice_around(spark, d):
    """Lattice coordinates on both axes around an agent, every fourth cell of a map of 100, and the map's extent in the world."""
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("x"), F.pmod("p_partkey", F.lit(50)).alias("y"))
    line = lambda c: F.transform(F.sequence((-F.col(c) / 4).cast("long"), ((100 - F.col(c)) / 4).cast("long") - 1), lambda n: F.col(c) + n * 4)
    return rows.select("p_partkey", line("x").alias("xs"), line("y").alias("ys"), *[(F.col(c) + s * 100 * 0.05).alias(f"{n}_{c}") for c in ("x", "y") for n, s in (("least", -1), ("most", 1))])


@query(
    "R2",
    """WITH s AS (SELECT s_suppkey AS agent, i AS step, CAST(('0x' || substr(sha256('11:' || s_suppkey || ':' || i), 1, 8)) AS UBIGINT) % 3 AS draw FROM supplier, (SELECT unnest(range(0, 20)) AS i)),
h AS (SELECT *, ((sum(CASE draw WHEN 1 THEN 90 WHEN 2 THEN -90 ELSE 0 END) OVER (PARTITION BY agent ORDER BY step)) % 360 + 360) % 360 AS heading FROM s)
SELECT agent, step, CASE draw WHEN 0 THEN 'F' WHEN 1 THEN 'L' ELSE 'R' END AS action, CAST(sum(CASE WHEN draw <> 0 THEN 0 WHEN heading = 0 THEN 1 WHEN heading = 180 THEN -1 ELSE 0 END) OVER w AS BIGINT) AS x, CAST(sum(CASE WHEN draw <> 0 THEN 0 WHEN heading = 90 THEN 1 WHEN heading = 270 THEN -1 ELSE 0 END) OVER w AS BIGINT) AS y FROM h WINDOW w AS (PARTITION BY agent ORDER BY step)""",
)
def random_walk(spark, d):
    """Agents that draw twenty actions by a seeded hash, so that a rerun walks alike."""
    steps = table(spark, d, "supplier").select(F.col("s_suppkey").alias("agent"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("step"))
    draw = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit("11"), "agent", "step"), 256), 1, 8), 16, 10).cast("long"), F.lit(3))
    rows = steps.withColumn("draw", draw)
    turn = F.when(F.col("draw") == 1, 90).when(F.col("draw") == 2, -90).otherwise(0)
    rows = rows.withColumn("heading", F.pmod(F.sum(turn).over(upto(["agent"], ["step"])), F.lit(360)))
    along = lambda plus, minus: F.sum(F.when(F.col("draw") != 0, 0).when(F.col("heading") == plus, 1).when(F.col("heading") == minus, -1).otherwise(0)).over(upto(["agent"], ["step"]))
    return rows.select("agent", "step", F.when(F.col("draw") == 0, "F").when(F.col("draw") == 1, "L").otherwise("R").alias("action"), along(0, 180).alias("x"), along(90, 270).alias("y"))


def drawn(seed: int, scenes: int, sounds: int, longest: float, low: float, high: float, tries: int = 128) -> tuple:
    """An episode's draws by its own generator: scene, sound, start, yaw, then listener and source until they are between ``low`` and ``high`` apart."""
    rng = np.random.default_rng(seed)
    head = (int(rng.integers(0, scenes)), int(rng.integers(0, sounds)), float(rng.uniform(0.0, longest)), float(rng.uniform(-180.0, 180.0)))
    for n in range(1, tries + 1):
        listener, source = rng.uniform(-10, 10, 2), rng.uniform(-10, 10, 2)
        apart = float(np.hypot(*(listener - source)))
        if low <= apart <= high:
            return *head, apart, n
    return *head, None, tries


@query("R1")
def sampled_episodes(spark, d):
    """Episodes drawn from a seed of their own, so that neither order nor number of the others matters."""
    digest = F.sha2(F.concat(F.lit("20260824:ep_"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0")), 256)
    seeds = table(spark, d, "orders").select("o_orderkey", F.substring(digest, 1, 16).alias("seed"))
    names, types = ["scene", "sound", "start", "yaw", "apart", "tries"], [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [drawn(int(s, 16), 4, 7, 25.0, 2.0, 12.0) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[i] for f in found], t) for i, t in enumerate(types)]], names=["o_orderkey", *names])

    return seeds.mapInArrow(draw, "o_orderkey long, scene int, sound int, start double, yaw double, apart double, tries int")
