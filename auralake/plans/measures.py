"""Aggregates, ordered operators and episode metrics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.summary import SHARES, rate, summarize
from ..operators import windows
from ..operators.windows import episodes, linear, numbered, order, running_total, upto
from ..registry import query
from ..sources.tables import table



def micro(value):
    """Rounded half up to six digits by plain arithmetic, which every engine does alike."""
    return F.floor(value * 1000000 + 0.5) / 1000000


KEY, STEP = ["user_id"], ["ts", "event_id"]


@query(
    "A1 A2 A3 PF7",
    """WITH u AS (SELECT 'acctbal' AS field, c_acctbal AS x FROM customer UNION ALL SELECT 'totalprice', o_totalprice FROM orders UNION ALL SELECT 'retailprice', p_retailprice FROM part UNION ALL SELECT 'none', NULL FROM region)
SELECT field, count(x) AS count, min(x) AS min, round(quantile_cont(x, 0.05), 6) AS p05, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS p75, round(quantile_cont(x, 0.95), 6) AS p95, max(x) AS max FROM u GROUP BY field""",
)
def summary_percentiles(spark, d):
    take = lambda t, c, name: table(spark, d, t).select(F.lit(name).alias("field"), c.cast("double").alias("x"))
    rows = take("customer", F.col("c_acctbal"), "acctbal").unionByName(take("orders", F.col("o_totalprice"), "totalprice")).unionByName(take("part", F.col("p_retailprice"), "retailprice")).unionByName(take("region", F.lit(None), "none"))
    found = summarize(rows, "x", ["field"])
    return found.withColumns({k: F.round(k, 6) for k in SHARES})


@query(
    "A4 A5 A6 A7 A9 E5 E10",
    """SELECT event_type, round(avg(value), 6) AS mean_value, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(CASE WHEN value > 50 THEN 50 / greatest(value, 50) ELSE 0 END), 6) AS spl FROM events GROUP BY 1""",
)
def episode_means(spark, d):
    won = F.col("value") > 50
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.round(rate(won), 6).alias("success_rate"), F.round(F.avg(F.when(won, 50 / F.greatest("value", F.lit(50.0))).otherwise(0.0)), 6).alias("spl"))


@query("A8 E8", """WITH e AS (SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS r FROM events GROUP BY 1) SELECT count(*) AS episodes, round(avg(r), 6) AS reach_rate FROM e""")
def two_level_rate(spark, d):
    each = table(spark, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "click") / F.count("*")).alias("r"))
    return each.agg(F.count("*").alias("episodes"), F.round(F.avg("r"), 6).alias("reach_rate"))


@query(
    "A11 A12 A13 Q8",
    """WITH s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s1, greatest(var_pop(value), 0.01) AS v0 FROM events GROUP BY 1)
SELECT event_id, round((value - m) / (s1 + 1e-5), 6) AS sampled, round((value - m) / sqrt(v0), 6) AS population FROM events JOIN s USING (event_type)""",
)
def norm_advantage(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    s = events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s1"), F.greatest(F.var_pop("value"), F.lit(0.01)).alias("v0"))
    off = F.col("value") - F.col("m")
    return events.join(s, "event_type").select("event_id", F.round(off / (F.col("s1") + 1e-5), 6).alias("sampled"), F.round(off / F.sqrt("v0"), 6).alias("population"))


@query(
    "A15 A16",
    """SELECT CASE WHEN url LIKE '%?%' THEN 'query' WHEN url LIKE '%#%' THEN 'anchor' ELSE 'plain' END AS kind, count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages WHERE url NOT LIKE '%_SUCCESS' GROUP BY 1""",
)
def storage_rollup(spark, d):
    kind = F.when(F.col("url").contains("?"), "query").when(F.col("url").contains("#"), "anchor").otherwise("plain")
    return table(spark, d, "pages").where(~F.col("url").endswith("_SUCCESS")).groupBy(kind.alias("kind")).agg(F.count("*").alias("files"), F.sum(F.octet_length("html")).cast("long").alias("bytes"))


@query(
    "A20 SC12 Q2",
    """WITH s AS (SELECT user_id, event_id AS step, value FROM events WHERE event_type = 'view' AND value > 0) SELECT u.user_id, coalesce((SELECT arg_min(step, (-value, step)) FROM s WHERE s.user_id = u.user_id), -1) AS best_step FROM (SELECT DISTINCT user_id FROM events) u""",
)
def best_checkpoint(spark, d):
    scored = (F.col("event_type") == "view") & (F.col("value") > 0)
    best = table(spark, d, "events").groupBy("user_id").agg(F.min(F.when(scored, F.struct((-F.col("value")).alias("v"), F.col("event_id").alias("step")))).alias("b"))
    return best.select("user_id", F.coalesce("b.step", F.lit(-1)).alias("best_step"))


@query(
    "A21 A22 A23",
    """WITH t AS (SELECT label, CAST(embedding[1] AS DOUBLE) * 20 AS x, CAST(embedding[2] AS DOUBLE) * 20 AS y, CAST(embedding[3] AS DOUBLE) * 20 AS gx, CAST(embedding[4] AS DOUBLE) * 20 AS gy, list_transform(embedding, lambda e: abs(e)) AS a FROM embeddings)
SELECT label, round(avg(CASE WHEN round_even(x, 0) = round_even(gx, 0) AND round_even(y, 0) = round_even(gy, 0) THEN 1.0 ELSE 0.0 END), 6) AS located, CAST(sum(list_position(a, list_max(a)) - 1) AS BIGINT) AS argmax_sum, round(sum(abs(x - gx) * 64) / (64 * count(*)), 6) AS loss FROM t GROUP BY label""",
)
def rounded_accuracy(spark, d):
    at = lambda i: F.col("embedding")[i].cast("double") * 20
    rows = table(spark, d, "embeddings").select("label", *[at(i).alias(n) for i, n in enumerate(("x", "y", "gx", "gy"))], F.transform("embedding", F.abs).alias("a"))
    right = (F.bround("x", 0) == F.bround("gx", 0)) & (F.bround("y", 0) == F.bround("gy", 0))
    return rows.groupBy("label").agg(F.round(rate(right), 6).alias("located"), F.sum(F.array_position("a", F.array_max("a")) - 1).cast("long").alias("argmax_sum"), F.round(F.sum(F.abs(F.col("x") - F.col("gx")) * 64) / (64 * F.count("*")), 6).alias("loss"))


_RETURNS_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id, value AS r, event_type <> 'purchase' AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i, {v} AS v FROM events),
f AS (SELECT event_id, user_id, i, v, {first} AS g FROM e WHERE i = 1 UNION ALL SELECT e.event_id, e.user_id, e.i, e.v, {next} FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT event_id, {out} FROM f"""


def _trajectories(spark, d):
    """Events as steps: reward ``value``, value estimate ``value / 2``, the mask after a purchase is zero."""
    return table(spark, d, "events").select("user_id", "ts", "event_id", F.col("value").alias("r"), (F.col("event_type") != "purchase").alias("m"))


@query("W2", _RETURNS_SQL.format(v="0.0", first="r", next="e.r + CASE WHEN e.m THEN 0.99 * f.g ELSE 0 END", out="round(g, 6) AS ret"))
def discounted_returns(spark, d):
    found = linear(_trajectories(spark, d), KEY, STEP, F.when(F.col("m"), 0.99).otherwise(0.0), F.col("r"), F.col("r"), "ret", back=True)
    return found.select("event_id", F.round("ret", 6).alias("ret"))


@query(
    "W1",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, value AS r, CASE WHEN event_type <> 'purchase' THEN 1.0 ELSE 0.0 END AS m, value / 2 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events),
f AS (SELECT event_id, user_id, i, v, CAST(r - v AS DOUBLE) AS g FROM e WHERE i = 1 UNION ALL SELECT e.event_id, e.user_id, e.i, e.v, e.r + 0.99 * f.v * e.m - e.v + 0.99 * 0.95 * e.m * f.g FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT event_id, floor((g) * 1000000 + 0.5) / 1000000 AS advantage, floor((g + v) * 1000000 + 0.5) / 1000000 AS ret FROM f""",
)
def gae_returns(spark, d):
    rows = _trajectories(spark, d).withColumn("nv", F.coalesce(F.lead("r").over(order(KEY, STEP)), F.lit(0.0)) / 2)
    surprise = F.col("r") + F.when(F.col("m"), 0.99 * F.col("nv")).otherwise(0.0) - F.col("r") / 2
    found = linear(rows, KEY, STEP, F.when(F.col("m"), 0.99 * 0.95).otherwise(0.0), surprise, surprise, "g", back=True)
    return found.select("event_id", micro(F.col("g")).alias("advantage"), micro(F.col("g") + F.col("r") / 2).alias("ret"))


@query(
    "W3 W7 W12 E1",
    """WITH s AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM events)
SELECT event_id, CAST(episode AS BIGINT) AS episode, row_number() OVER w - 1 AS step, count(*) OVER (PARTITION BY user_id, episode) AS n_actions, round(sum(value) OVER w, 6) AS reward FROM s WINDOW w AS (PARTITION BY user_id, episode ORDER BY ts, event_id)""",
)
def episode_segments(spark, d):
    rows = episodes(table(spark, d, "events"), KEY, STEP, F.col("event_type") == "purchase")
    own = [*KEY, "episode"]
    return rows.select("event_id", "episode", (F.row_number().over(order(own, STEP)) - 1).alias("step"), F.count("*").over(Window.partitionBy(*own)).alias("n_actions"), F.round(F.sum("value").over(upto(own, STEP)), 6).alias("reward"))


@query(
    "W4",
    """WITH s AS (SELECT event_id, row_number() OVER w - 1 AS t, coalesce(lag(event_type) OVER w = 'purchase' AND lag(value) OVER w > 150, false) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT t, max(CASE WHEN fresh OR t = 0 THEN 1 ELSE 0 END) AS cut FROM s GROUP BY t), g AS (SELECT t, sum(cut) OVER (ORDER BY t) - 1 AS segment, max(CASE WHEN cut = 1 THEN t END) OVER (ORDER BY t) AS start FROM b)
SELECT event_id, CAST(segment AS BIGINT) AS segment, t - start AS place FROM s JOIN g USING (t)""",
)
def common_segments(spark, d):
    """Steps of environments that run side by side, cut for all of them wherever one begins anew."""
    w = order(KEY, STEP)
    fresh = F.coalesce((F.lag("event_type").over(w) == "purchase") & (F.lag("value").over(w) > 150), F.lit(False))
    steps = table(spark, d, "events").select("event_id", (F.row_number().over(w) - 1).alias("t"), fresh.alias("fresh"))
    times = steps.groupBy("t").agg(F.max((F.col("fresh") | (F.col("t") == 0)).cast("int")).alias("cut"))
    counted = running_total(times, ["t"], "cut", "n").select("t", (F.col("n") - 1).alias("segment"))
    starts = counted.groupBy("segment").agg(F.min("t").alias("start"))
    return steps.join(counted, "t").join(starts, "segment").select("event_id", "segment", (F.col("t") - F.col("start")).alias("place"))


@query(
    "W5",
    """WITH c AS (SELECT event_id, user_id, ts, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, round(CASE WHEN n = 1 THEN total ELSE total - first_value(total) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END, 6) AS delta, greatest(n - first_value(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 1) AS n_delta FROM c""",
)
def sliding_delta(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", F.sum("value").over(upto(KEY, STEP)).alias("total"), F.row_number().over(order(KEY, STEP)).alias("n"))
    return rows.select("event_id", F.round(windows.sliding_delta(F.col("total"), KEY, STEP, 10), 6).alias("delta"), F.greatest(F.col("n") - F.first("n").over(order(KEY, STEP).rowsBetween(-9, 0)), F.lit(1)).alias("n_delta"))


@query(
    "W6 E6 W15",
    """SELECT event_id, floor((-0.01 + (lag(value, 1, 100.0) OVER w - value) * 1.0 + CASE WHEN event_type = 'purchase' THEN 10 ELSE 0 END) * 1000000 + 0.5) / 1000000 AS reward, coalesce(lag(event_type) OVER w, 'none') AS previous, coalesce(lag(event_type) OVER w = event_type, false) AS repeated FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def delta_reward(spark, d):
    w = order(KEY, STEP)
    last = F.lag("event_type").over(w)
    reward = F.lit(-0.01) + (F.lag("value", 1, 100.0).over(w) - F.col("value")) * 1.0 + F.when(F.col("event_type") == "purchase", 10).otherwise(0)
    return table(spark, d, "events").select("event_id", micro(reward).alias("reward"), F.coalesce(last, F.lit("none")).alias("previous"), F.coalesce(last == F.col("event_type"), F.lit(False)).alias("repeated"))


@query(
    "W9 W10",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 'purchase' AS fresh FROM events),
f AS (SELECT event_id, user_id, i, x AS b FROM e WHERE i = 1 UNION ALL SELECT e.event_id, e.user_id, e.i, CASE WHEN e.fresh OR f.b IS NULL THEN e.x WHEN e.x IS NULL THEN f.b ELSE 0.5 * f.b + 0.5 * e.x END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT event_id, floor((b) * 1000000 + 0.5) / 1000000 AS belief FROM f""",
)
def ewma_belief(spark, d):
    rows = episodes(table(spark, d, "events"), KEY, STEP, F.col("event_type") == "purchase").withColumn("x", F.when(F.col("event_type") != "error", F.col("value")))
    heard = F.col("x").isNotNull()
    found = linear(rows.select(*KEY, *STEP, "episode", "x"), [*KEY, "episode"], STEP, F.when(heard, 0.5).otherwise(1.0), F.when(heard, 0.5 * F.col("x")).otherwise(0.0), F.col("x"), "b")
    return found.select("event_id", micro(F.col("b")).alias("belief"))


@query(
    "W11",
    """WITH s AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM events)
SELECT event_id, list(event_id) OVER (PARTITION BY user_id, episode ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS memory FROM s""",
)
def ring_memory(spark, d):
    rows = episodes(table(spark, d, "events"), KEY, STEP, F.col("event_type") == "purchase")
    return rows.select("event_id", F.collect_list("event_id").over(order([*KEY, "episode"], STEP).rowsBetween(-4, 0)).alias("memory"))


@query(
    "W13 W18",
    """WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)
SELECT event_id, (user_id * 31 + n * 1600) % 48000 AS cursor, round(1 - n / 100.0, 6) AS linear, round(pow(0.97, n), 6) AS exponential FROM r""",
)
def cursor_modulo(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", (F.row_number().over(order(KEY, STEP)) - 1).alias("n"))
    return rows.select("event_id", F.pmod(F.col("user_id") * 31 + F.col("n") * 1600, F.lit(48000)).alias("cursor"), F.round(1 - F.col("n") / 100.0, 6).alias("linear"), F.round(F.pow(F.lit(0.97), F.col("n")), 6).alias("exponential"))


_TURN = "CASE event_type WHEN 'view' THEN 90 WHEN 'signup' THEN -90 ELSE 0 END"


@query(
    "W17",
    f"""WITH h AS (SELECT event_id, user_id, ts, event_type, ((sum({_TURN}) OVER (PARTITION BY user_id ORDER BY ts, event_id)) % 360 + 360) % 360 AS heading FROM events),
m AS (SELECT *, CASE WHEN event_type = 'click' THEN CASE heading WHEN 0 THEN 1 WHEN 180 THEN -1 ELSE 0 END ELSE 0 END AS dx, CASE WHEN event_type = 'click' THEN CASE heading WHEN 90 THEN 1 WHEN 270 THEN -1 ELSE 0 END ELSE 0 END AS dy FROM h)
SELECT event_id, CAST(heading AS BIGINT) AS heading, CAST(sum(dx) OVER w AS BIGINT) AS x, CAST(sum(dy) OVER w AS BIGINT) AS y FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def dead_reckoning(spark, d):
    turn = F.when(F.col("event_type") == "view", 90).when(F.col("event_type") == "signup", -90).otherwise(0)
    rows = table(spark, d, "events").withColumn("heading", F.pmod(F.sum(turn).over(upto(KEY, STEP)), F.lit(360)))
    moved = F.col("event_type") == "click"
    along = lambda plus, minus: F.when(moved & (F.col("heading") == plus), 1).when(moved & (F.col("heading") == minus), -1).otherwise(0)
    return rows.select("event_id", "heading", F.sum(along(0, 180)).over(upto(KEY, STEP)).alias("x"), F.sum(along(90, 270)).over(upto(KEY, STEP)).alias("y"))


@query(
    "E2 E3 E4 PF17",
    """SELECT o_orderkey, round(s * (gt / greatest(gt, na)), 6) AS sna, floor((final / nullif(start, 0)) * 1000000 + 0.5) / 1000000 AS ndg, s * CASE WHEN na > 5 THEN 1 ELSE 0 END AS sws, round(s * start / greatest(start, na), 6) AS spl
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS s, CAST(o_custkey % 13 + 1 AS DOUBLE) AS gt, o_orderkey % 17 AS na, o_totalprice / 1000 AS final, CAST(o_custkey % 7 AS DOUBLE) AS start FROM orders) WHERE na + start > 0""",
)
def episode_metrics(spark, d):
    s, na = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0), F.pmod("o_orderkey", F.lit(17))
    gt, start = (F.pmod("o_custkey", F.lit(13)) + 1).cast("double"), F.pmod("o_custkey", F.lit(7)).cast("double")
    rows = table(spark, d, "orders").select("o_orderkey", s.alias("s"), gt.alias("gt"), na.alias("na"), (F.col("o_totalprice") / 1000).alias("final"), start.alias("start")).where("na + start > 0")
    return rows.select(
        "o_orderkey", F.round(F.col("s") * (F.col("gt") / F.greatest(F.col("gt"), F.col("na").cast("double"))), 6).alias("sna"), micro(F.try_divide("final", "start")).alias("ndg"),
        (F.col("s") * F.when(F.col("na") > 5, 1).otherwise(0)).alias("sws"), F.round(F.col("s") * F.col("start") / F.greatest("start", F.col("na").cast("double")), 6).alias("spl"),
    )


@query(
    "L1",
    """WITH r AS (SELECT event_type, exp((value - 50) / 500) AS ratio, (value - 60) / 50 AS adv, value / 100 AS v, value / 110 AS old FROM events)
SELECT event_type, round(-avg(least(ratio * adv, least(greatest(ratio, 0.9), 1.1) * adv)), 6) AS action_loss, round(0.5 * avg(greatest((v - 1) * (v - 1), (old + least(greatest(v - old, -0.1), 0.1) - 1) * (old + least(greatest(v - old, -0.1), 0.1) - 1))), 6) AS value_loss FROM r GROUP BY 1""",
)
def ppo_losses(spark, d):
    clip = lambda x, low, high: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    value = F.col("value")
    rows = table(spark, d, "events").select("event_type", F.exp((value - 50) / 500).alias("ratio"), ((value - 60) / 50).alias("adv"), (value / 100).alias("v"), (value / 110).alias("old"))
    ratio, adv, v, old = map(F.col, ("ratio", "adv", "v", "old"))
    clipped = old + clip(v - old, -0.1, 0.1) - 1
    return rows.groupBy("event_type").agg(F.round(-F.avg(F.least(ratio * adv, clip(ratio, 0.9, 1.1) * adv)), 6).alias("action_loss"), F.round(0.5 * F.avg(F.greatest((v - 1) * (v - 1), clipped * clipped)), 6).alias("value_loss"))


@query(
    "E9",
    """SELECT conv_id, string_agg(turn || ':' || role || ':' || CASE WHEN role = 'system' THEN -1 ELSE length(text) END, '|' ORDER BY turn) AS trace FROM conversations GROUP BY conv_id""",
)
def descriptor_trace(spark, d):
    row = F.struct("turn", "role", F.when(F.col("role") == "system", -1).otherwise(F.length("text")).alias("n"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("s"))
    return rows.select("conv_id", F.concat_ws("|", F.transform("s", lambda x: F.concat_ws(":", x["turn"], x["role"], x["n"]))).alias("trace"))


@query(
    "X7 X8 X27",
    """WITH n AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, step % 6 ORDER BY step DESC) AS age, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY step), 'start') AS prev FROM n)
SELECT user_id, step % 6 AS slot, event_id, prev, row_number() OVER (PARTITION BY user_id ORDER BY step % 6) - 1 AS env FROM k WHERE age = 1""",
)
def ring_buffer_slots(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", (F.row_number().over(order(KEY, STEP)) - 1).alias("step"), F.coalesce(F.lag("event_type").over(order(KEY, STEP)), F.lit("start")).alias("prev"))
    slots = rows.groupBy("user_id", F.pmod("step", F.lit(6)).alias("slot")).agg(F.max(F.struct("step", "event_id", "prev")).alias("b"))
    return slots.select("user_id", "slot", "b.event_id", "b.prev", (F.row_number().over(Window.partitionBy("user_id").orderBy("slot")) - 1).alias("env"))


@query(
    "X9",
    """WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, CAST(('0x' || substr(sha256('3:' || user_id), 1, 8)) AS UBIGINT) % 4 AS batch FROM events),
e AS (SELECT user_id, batch, row_number() OVER (PARTITION BY batch ORDER BY user_id) - 1 AS n, count(*) OVER (PARTITION BY batch) AS width FROM (SELECT DISTINCT user_id, batch FROM n))
SELECT event_id, CAST(n.batch AS BIGINT) AS batch, t * width + e.n AS flat FROM n JOIN e ON n.user_id = e.user_id""",
)
def minibatch_flatten(spark, d):
    batch = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit("3:"), F.col("user_id").cast("string")), 256), 1, 8), 16, 10).cast("long"), F.lit(4))
    rows = table(spark, d, "events").select("event_id", "user_id", (F.row_number().over(order(KEY, STEP)) - 1).alias("t"))
    envs = rows.select("user_id").distinct().withColumn("batch", batch)
    placed = numbered(envs, ["batch"], ["user_id"], "n").join(envs.groupBy("batch").agg(F.count("*").alias("width")), "batch")
    return rows.join(placed, "user_id").select("event_id", "batch", (F.col("t") * F.col("width") + F.col("n")).alias("flat"))


@query(
    "X10",
    """WITH s AS (SELECT *, coalesce(sum(CASE WHEN event_type IN ('purchase', 'error') OR value > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS macro FROM events)
SELECT user_id, CAST(macro AS BIGINT) AS macro, count(*) AS steps, round(sum(value), 6) AS reward FROM s GROUP BY 1, 2""",
)
def macro_step_reward(spark, d):
    stop = F.col("event_type").isin("purchase", "error") | (F.col("value") > 150)
    return episodes(table(spark, d, "events"), KEY, STEP, stop).groupBy("user_id", F.col("episode").alias("macro")).agg(F.count("*").alias("steps"), F.round(F.sum("value"), 6).alias("reward"))


@query(
    "X21 X22",
    """WITH n AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, i AS frame, round(before + (value - before) * i / 4.0, 6) AS position, CAST(((round_even(degrees(2 * acos(cos(value / 60))), 0)) % 360 + 360) % 360 AS INTEGER) AS rotation FROM n, (SELECT unnest([1, 2, 3]) AS i) WHERE before IS NOT NULL""",
)
def interpolate_steps(spark, d):
    rows = table(spark, d, "events").select("event_id", "value", F.lag("value").over(order(KEY, STEP)).alias("before")).where("before is not null").withColumn("frame", F.explode(F.sequence(F.lit(1), F.lit(3))))
    angle = F.pmod(F.bround(F.degrees(2 * F.acos(F.cos(F.col("value") / 60))), 0).cast("int"), F.lit(360))
    return rows.select("event_id", "frame", F.round(F.col("before") + (F.col("value") - F.col("before")) * F.col("frame") / 4.0, 6).alias("position"), angle.alias("rotation"))


