"""Signals, geometry, grids and graphs over the driver's tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pose, signal
from ..operators.graph import components, distances
from ..operators.joins import nearest
from ..registry import query
from ..sources.tables import table


def _ears(spark, d):
    """Embeddings as binaural signals: the first half of an embedding is the left ear, the second the right."""
    e = signal.doubles(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", "label", F.slice(e, 1, 32).alias("l"), F.slice(e, 33, 32).alias("r"))


_EARS = "s AS (SELECT vec_id, label, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS l, list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE)) AS r FROM embeddings)"


@query(
    "M2 M3 A25",
    f"""WITH {_EARS}, e AS (SELECT vec_id, list_sum(list_transform(l, lambda x: x * x)) AS el, list_sum(list_transform(r, lambda x: x * x)) AS er, list_max(list_transform(l, lambda x: abs(x))) AS pl, list_max(list_transform(r, lambda x: abs(x))) AS pr, len(list_filter(list_transform(range(1, 33), lambda i: greatest(abs(l[i]), abs(r[i]))), lambda x: x < 0.05)) AS quiet, len(list_filter(list_concat(l, r), lambda x: abs(x) >= 0.3)) AS loud FROM s)
SELECT vec_id, round(20 * log10(greatest(sqrt(el / 32), 1e-12)), 6) AS rms_left_dbfs, round(20 * log10(greatest(sqrt(er / 32), 1e-12)), 6) AS rms_right_dbfs, round(10 * log10((el / 32 + 1e-12) / (er / 32 + 1e-12)), 6) AS ild, round(pl, 6) AS peak_left, round(pr, 6) AS peak_right, quiet / 32.0 AS silence, loud / 64.0 AS clipping, round(el, 6) AS energy_left, round(er, 6) AS energy_right FROM e""",
)
def waveform_metrics(spark, d):
    rows = _ears(spark, d)
    el, er = signal.energy(F.col("l")), signal.energy(F.col("r"))
    both = F.zip_with("l", "r", lambda a, b: F.greatest(F.abs(a), F.abs(b)))
    e = rows.select("vec_id", el.alias("el"), er.alias("er"), signal.peak(F.col("l")).alias("pl"), signal.peak(F.col("r")).alias("pr"), F.size(F.filter(both, lambda x: x < 0.05)).alias("quiet"), F.size(F.filter(F.concat("l", "r"), lambda x: F.abs(x) >= 0.3)).alias("loud"))
    level = lambda c: signal.rounded(signal.dbfs(F.sqrt(F.col(c) / 32)), 6)
    return e.select(
        "vec_id", level("el").alias("rms_left_dbfs"), level("er").alias("rms_right_dbfs"), signal.rounded(10 * F.log10((F.col("el") / 32 + signal.EPS) / (F.col("er") / 32 + signal.EPS)), 6).alias("ild"),
        signal.rounded("pl", 6).alias("peak_left"), signal.rounded("pr", 6).alias("peak_right"), (F.col("quiet") / 32.0).alias("silence"), (F.col("loud") / 64.0).alias("clipping"), signal.rounded("el", 6).alias("energy_left"), signal.rounded("er", 6).alias("energy_right"),
    )


@query(
    "M1 M2 M3 A26",
    f"""WITH {_EARS}, g AS (SELECT *, CASE WHEN vec_id % 11 = 0 THEN 'rate' WHEN vec_id % 7 = 0 THEN 'channels' WHEN vec_id % 13 = 0 THEN 'type' WHEN vec_id % 5 = 0 THEN 'not finite' WHEN vec_id % 3 = 0 THEN 'short' END AS fault, l[1:24] AS a, r[1:24] AS b FROM s),
e AS (SELECT vec_id, fault, list_sum(list_transform(a, lambda x: x * x)) / 24 AS p, list_sum(list_transform(b, lambda x: x * x)) / 24 AS q, list_max(list_transform(list_concat(a, b), lambda x: abs(x))) AS peak, list_sum(list_transform(list_concat(l, r), lambda x: x * x)) AS total, len(list_filter(range(1, 25), lambda i: greatest(abs(a[i]), abs(b[i])) < 0.05)) / 24.0 AS quiet, len(list_filter(list_concat(a, b), lambda x: abs(x) >= 0.3)) / 48.0 AS loud FROM g)
SELECT vec_id, fault, CASE WHEN fault IS NULL THEN round(20 * log10(greatest(sqrt((p + q) / 2), 1e-12)), 6) END AS rms_mean, CASE WHEN fault IS NULL THEN round(p / (q + 1e-12), 6) END AS ratio, CASE WHEN fault IS NULL THEN round(peak, 6) END AS peak, CASE WHEN fault IS NULL THEN round(total, 6) END AS energy, CASE WHEN fault IS NULL THEN round(quiet, 6) END AS silence, CASE WHEN fault IS NULL THEN round(loud, 6) END AS clipping, CASE WHEN fault IS NULL THEN 0.002::DOUBLE END AS seconds FROM e""",
)
def guarded_windows(spark, d):
    """Measures of the first 24 of 32 samples of both ears, of those sounds that may be compared, and why the others may not."""
    v = F.col("vec_id")
    of = lambda k, odd, fine: F.when(v % k == 0, odd).otherwise(fine)
    fault = signal.window_fault(of(11, 8000, 16000), of(7, 1, 2), of(13, "int16", "float32"), v % 5 != 0, of(3, 20, 32), least=24)
    rows = _ears(spark, d).select("vec_id", fault.alias("fault"), "l", "r")
    m = signal.window_metrics(F.when(F.col("fault").isNull(), F.col("l")), F.col("r"), window=24, silent=0.05, clipped=0.3)
    rounded = {"rms_mean": "rms_mean_dbfs", "peak": "peak_max", "energy": "energy_total", "silence": "silence_fraction", "clipping": "clipping_fraction"}
    found = rows.select("vec_id", "fault", m.alias("m"))
    return found.select("vec_id", "fault", *[signal.rounded(f"m.{c}", 6).alias(n) for n, c in rounded.items()], signal.rounded(F.col("m.mean_square_left") / (F.col("m.mean_square_right") + signal.EPS), 6).alias("ratio"), F.col("m.duration_sec").alias("seconds"))


@query(
    "M4 T3",
    f"""WITH {_EARS}, g AS (SELECT vec_id, k AS lag, l[1 + greatest(0, -k):32 - greatest(0, k)] AS a, r[1 + greatest(0, k):32 - greatest(0, -k)] AS b FROM s, (SELECT unnest(range(-4, 5)) AS k)),
c AS (SELECT vec_id, lag, list_transform(a, lambda x: x - list_sum(a) / len(a)) AS a, list_transform(b, lambda x: x - list_sum(b) / len(b)) AS b FROM g),
p AS (SELECT vec_id, CAST(lag AS INTEGER) AS lag, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * b[i])) / (sqrt(list_sum(list_transform(a, lambda x: x * x)) * list_sum(list_transform(b, lambda x: x * x))) + 1e-12), 6) AS corr FROM c)
SELECT vec_id, arg_min(lag, (-corr, abs(lag), lag)) AS lag, max(corr) AS corr FROM p GROUP BY vec_id""",
)
def interaural_lag(spark, d):
    rows = _ears(spark, d).select("vec_id", signal.lagged_correlations(F.col("l"), F.col("r"), 4).alias("c"))
    rows = rows.select("vec_id", F.transform("c", lambda x, i: F.struct((i - 4).alias("lag"), signal.rounded(x, 6).alias("corr"))).alias("c"))
    best = F.array_min(F.transform("c", lambda x: F.struct((-x["corr"]).alias("c"), F.abs(x["lag"]).alias("a"), x["lag"].alias("lag"))))
    return rows.select("vec_id", best.alias("b")).select("vec_id", "b.lag", (-F.col("b.c")).alias("corr"))


@query("M5", f"""WITH {_EARS}, e AS (SELECT vec_id, list_sum(list_transform(l[25:32], lambda x: x * x)) AS t, list_sum(list_transform(l, lambda x: x * x)) AS e FROM s) SELECT vec_id, round(t / (e + 1e-12), 6) AS tail_ratio, round(10 * log10(t / (e + 1e-12) + 1e-12), 6) AS tail_db FROM e""")
def rir_tail(spark, d):
    ratio = signal.energy(F.slice("l", -8, 8)) / (signal.energy(F.col("l")) + signal.EPS)
    return _ears(spark, d).select("vec_id", ratio.alias("q")).select("vec_id", signal.rounded("q", 6).alias("tail_ratio"), signal.rounded(10 * F.log10(F.col("q") + signal.EPS), 6).alias("tail_db"))


@query(
    "M6",
    f"""WITH {_EARS}, c AS (SELECT vec_id, k, list_sum(list_transform(range(greatest(0, k - 31), least(k, 31) + 1), lambda i: l[i + 1] * r[k - i + 1])) AS v FROM s, (SELECT unnest(range(0, 63)) AS k)) SELECT vec_id, k, round(v, 6) + 0.0 AS v FROM c""",
)
def convolve_full(spark, d):
    rows = _ears(spark, d).select("vec_id", F.posexplode(signal.convolved(F.col("l"), F.col("r"))).alias("k", "v"))
    return rows.select("vec_id", F.col("k").cast("long").alias("k"), (signal.rounded("v", 6) + 0.0).alias("v"))


@query(
    "M13",
    f"""WITH {_EARS}, m AS (SELECT *, 0.1::DOUBLE * greatest(list_max(l), list_max(r)) AS least FROM s),
f AS (SELECT vec_id, l, r, least(coalesce(nullif(list_position(list_transform(l, lambda x: x > least), true), 0), 1), coalesce(nullif(list_position(list_transform(r, lambda x: x > least), true), 0), 1)) AS a FROM m)
SELECT vec_id, CAST(a - 1 AS INTEGER) AS first_sample, round(list_sum(list_transform(list_concat(l[a:a + 149], r[a:a + 149]), lambda x: x * x)) / len(list_concat(l[a:a + 149], r[a:a + 149])), 6) AS intensity FROM f""",
)
def direct_intensity(spark, d):
    """The mean square, over both ears, of 150 samples from the first on that is louder than a tenth of the loudest."""
    first = lambda ear: F.greatest(F.array_position(F.transform(ear, lambda x: x > F.col("least")), True), F.lit(1))
    rows = _ears(spark, d).select("vec_id", "l", "r", (0.1 * F.greatest(F.array_max("l"), F.array_max("r"))).alias("least")).select("vec_id", "l", "r", F.least(first("l"), first("r")).cast("int").alias("a"))
    rows = rows.select("vec_id", "a", F.concat(F.slice("l", F.col("a"), F.lit(150)), F.slice("r", F.col("a"), F.lit(150))).alias("s"))
    return rows.select("vec_id", (F.col("a") - 1).alias("first_sample"), signal.rounded(signal.energy(F.col("s")) / F.size("s"), 6).alias("intensity"))


@query(
    "M14 J11",
    """SELECT vec_id, list_transform(range(0, 21), lambda i: CASE WHEN i = CASE WHEN label > 6 THEN 20 ELSE label END THEN 1 ELSE 0 END) AS one_hot FROM embeddings""",
)
def onehot(spark, d):
    index = F.coalesce(F.when(F.col("label") <= 6, F.col("label")), F.lit(20))
    return table(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: (i == index).cast("int")).alias("one_hot"))


@query(
    "M9 M18 PF13",
    """WITH c AS (SELECT CAST(floor((c_acctbal + 1000) / 500) AS BIGINT) AS x, CAST(floor(c_nationkey / 5.0) AS BIGINT) AS y, c_acctbal < 0 AS blocked FROM customer WHERE c_acctbal <> 0 AND c_acctbal <= 9000),
g AS (SELECT x, y, bool_or(blocked) AS blocked, count(*) AS n FROM c GROUP BY 1, 2)
SELECT CAST(dx AS BIGINT) AS dx, CAST(dy AS BIGINT) AS dy, coalesce(CASE WHEN blocked THEN 1 ELSE 0 END, 0) AS obstacle, coalesce(n, 0) AS seen FROM (SELECT unnest(range(-3, 24)) AS dx), (SELECT unnest(range(-2, 8)) AS dy) LEFT JOIN g ON x = dx AND y = dy""",
)
def occupancy_grid(spark, d):
    seen = table(spark, d, "customer").where("c_acctbal <> 0 and c_acctbal <= 9000")
    cell = seen.select(F.floor((F.col("c_acctbal") + 1000) / 500).alias("x"), F.floor(F.col("c_nationkey") / 5.0).alias("y"), (F.col("c_acctbal") < 0).alias("blocked"))
    grid = cell.groupBy("x", "y").agg(F.bool_or("blocked").alias("blocked"), F.count("*").alias("n"))
    crop = spark.range(-3, 24).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(-2).cast("long"), F.lit(7).cast("long"))).alias("y"))
    return crop.join(grid, ["x", "y"], "left").select(F.col("x").alias("dx"), F.col("y").alias("dy"), F.coalesce(F.col("blocked").cast("int"), F.lit(0)).alias("obstacle"), F.coalesce("n", F.lit(0)).alias("seen"))


@query(
    "M10 M22",
    f"""WITH {_EARS} SELECT vec_id, list_transform(range(CAST(round_even(vec_id % 7 / 2.0, 0) AS BIGINT) + 1, CAST(round_even(vec_id % 7 / 2.0, 0) AS BIGINT) + 5), lambda i: round((l[i] + r[i]) / 2 * pow(10, -6.0 / 20), 6)) AS mono, round(least(greatest(l[1] * 20, 0), 10) / 10, 6) AS depth FROM s""",
)
def mono_gain(spark, d):
    rows = _ears(spark, d)
    start = F.bround(F.pmod("vec_id", F.lit(7)) / 2.0, 0).cast("int") + 1
    mixed = F.zip_with(F.slice("l", start, F.lit(4)), F.slice("r", start, F.lit(4)), lambda a, b: signal.rounded((a + b) / 2 * 10 ** (-6.0 / 20), 6))
    return rows.select("vec_id", mixed.alias("mono"), signal.rounded(F.least(F.greatest(F.col("l")[0] * 20, F.lit(0.0)), F.lit(10.0)) / 10, 6).alias("depth"))


@query("M7 M12")
def spectrogram(spark, d):
    """A second of sound at 16 kHz for each vector: its left half tiled as source, its right half as room response."""

    def heard(batches):
        for frame in batches:
            out = []
            for left, right in zip(frame["l"], frame["r"], strict=True):
                source = np.tile(np.asarray(left, np.float64), 16000 * 2 // 32)
                room = np.stack([right, right[::-1]], 1)
                s = signal.spectrogram(signal.audio_window(source, room, 1, 16000))
                out.append((s.shape[0], s.shape[1], round(float(s.mean()), 4), round(float(s.max()), 4)))
            yield pd.DataFrame({"vec_id": frame["vec_id"], **{c: [o[i] for o in out] for i, c in enumerate(("bands", "frames", "mean", "peak"))}})

    return _ears(spark, d).select("vec_id", "l", "r").mapInPandas(heard, "vec_id long, bands long, frames long, mean double, peak double")


@query(
    "G1 G2 G3 G4 G5 G6 G7 G8 G13",
    """WITH t AS (SELECT s_suppkey, CAST(s_suppkey * 37 % 720 AS DOUBLE) - 360 AS yaw, s_acctbal / 100 AS x, s_nationkey - 12 AS z FROM supplier),
n AS (SELECT *, ((yaw + 180) % 360 + 360) % 360 - 180 AS y FROM t), a AS (SELECT *, x * cos(radians(y)) - z * sin(radians(y)) AS rx, x * sin(radians(y)) + z * cos(radians(y)) AS rz FROM n)
SELECT s_suppkey, round(y, 6) AS yaw, round(-sin(radians(y)), 6) + 0.0 AS fx, round(-cos(radians(y)), 6) + 0.0 AS fz, round(degrees(atan2(rx, -rz)), 5) AS azimuth, round(sqrt(x * x + z * z + 2.25), 6) AS distance, round(((y + 45 + 180) % 360 + 360) % 360 - 180, 6) AS left_yaw, round(sqrt(x * x + z * z) * 1.2 / nullif(sqrt(x * x + z * z), 0), 6) AS detour, round(((270 - degrees(atan2(z, x))) % 360 + 360) % 360, 5) AS direction FROM a""",
)
def azimuth_geometry(spark, d):
    t = table(spark, d, "supplier").select("s_suppkey", (F.pmod(F.col("s_suppkey") * 37, F.lit(720)).cast("double") - 360).alias("yaw"), (F.col("s_acctbal") / 100).alias("x"), (F.col("s_nationkey") - 12).alias("z"))
    t = t.withColumn("y", pose.normalize_yaw(F.col("yaw")))
    y, x, z = F.col("y"), F.col("x"), F.col("z")
    fx, fz = pose.forward(y)
    right, back = pose.to_agent(x, z, y)  # straight behind is 180, as in SQL, where pose.azimuth has -180
    flat = F.sqrt(x * x + z * z)
    height = pose.sensor(F.lit(0.0))
    return t.select(
        "s_suppkey", signal.rounded(y, 6).alias("yaw"), (signal.rounded(fx, 6) + 0.0).alias("fx"), (signal.rounded(fz, 6) + 0.0).alias("fz"), signal.rounded(pose.bearing(right, back), 5).alias("azimuth"), signal.rounded(F.sqrt(x * x + z * z + height * height), 6).alias("distance"),
        signal.rounded(pose.normalize_yaw(y + 45), 6).alias("left_yaw"), signal.rounded(F.try_divide(flat * 1.2, flat), 6).alias("detour"), signal.rounded(F.pmod(270 - F.degrees(F.atan2(z, x)), F.lit(360.0)), 5).alias("direction"),
    )


@query(
    "G9 G10 G14 G15",
    """WITH t AS (SELECT s_suppkey, s_acctbal / 1000 AS x, CAST(s_nationkey AS DOUBLE) AS y, radians(CAST(s_suppkey * 37 % 360 AS DOUBLE)) AS h FROM supplier),
r AS (SELECT s_suppkey, h, x * cos(h) + y * sin(h) AS bx, y * cos(h) - x * sin(h) AS byy FROM t)
SELECT s_suppkey, round(bx, 6) AS bx, round(byy, 6) AS by_, round(atan2(sin(h - 1), cos(h - 1)), 6) AS heading, CASE WHEN abs(atan2(byy, bx)) <= radians(15) THEN 'FORWARD' WHEN atan2(byy, bx) > 0 THEN 'LEFT' ELSE 'RIGHT' END AS action, round(exp(-s_suppkey / 50.0), 6) AS fade FROM r""",
)
def frames_odom(spark, d):
    t = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.radians(F.pmod(F.col("s_suppkey") * 37, F.lit(360)).cast("double")).alias("h"))
    x, y, h = F.col("x"), F.col("y"), F.col("h")
    r = t.select("s_suppkey", "h", (x * F.cos(h) + y * F.sin(h)).alias("bx"), (y * F.cos(h) - x * F.sin(h)).alias("by"))
    turn = F.atan2("by", "bx")
    action = F.when(F.abs(turn) <= F.radians(F.lit(15)), "FORWARD").when(turn > 0, "LEFT").otherwise("RIGHT")
    return r.select("s_suppkey", signal.rounded("bx", 6).alias("bx"), signal.rounded("by", 6).alias("by_"), signal.rounded(F.atan2(F.sin(h - 1), F.cos(h - 1)), 6).alias("heading"), action.alias("action"), signal.rounded(F.exp(-F.col("s_suppkey") / 50.0), 6).alias("fade"))


def _edges(spark, d):
    """Nations as nodes: a nation leads to the nations its suppliers' keys point at, both ways."""
    one = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("src"), F.pmod(F.col("s_suppkey") * 7, F.lit(40)).alias("dst")).where("src <> dst")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


_EDGES = "o AS (SELECT CAST(s_nationkey AS BIGINT) AS src, s_suppkey * 7 % 40 AS dst FROM supplier WHERE s_nationkey <> s_suppkey * 7 % 40), e AS (SELECT src, dst FROM o UNION SELECT dst, src FROM o)"


@query("GR1 GR2", f"""WITH RECURSIVE {_EDGES}, b(node, hops) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.dst, hops + 1 FROM b JOIN e ON b.node = e.src WHERE hops < 45) SELECT node, min(hops) AS hops, min(hops) * 0.5 AS metres FROM b GROUP BY node""")
def graph_bfs(spark, d):
    start = spark.createDataFrame([(0,)], "node long")
    return distances(_edges(spark, d), start).select("node", "hops", (F.col("hops") * 0.5).alias("metres"))


@query(
    "GR4 GR7 A27 T8",
    """WITH RECURSIVE o AS (SELECT o_custkey % 400 AS src, o_orderkey % 397 + 1000 AS dst FROM orders), e AS (SELECT src, dst FROM o UNION SELECT dst, src FROM o),
r(node, root) AS (SELECT src, src FROM e UNION SELECT e.dst, r.root FROM r JOIN e ON r.node = e.src WHERE e.dst > r.root), c AS (SELECT node, min(root) AS component FROM r GROUP BY node), z AS (SELECT component, count(*) AS size FROM c GROUP BY 1)
SELECT node, component, size, component = (SELECT arg_min(component, (-size, component)) FROM z) AS largest FROM c JOIN z USING (component) WHERE size >= 2""",
)
def graph_components(spark, d):
    one = table(spark, d, "orders").select((F.col("o_custkey") % 400).alias("src"), (F.col("o_orderkey") % 397 + 1000).alias("dst"))
    edges = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    found = components(edges.select(F.col("src").alias("node")).distinct(), edges)
    size = found.groupBy("component").agg(F.count("*").alias("size"))
    best = size.agg(F.min(F.struct((-F.col("size")).alias("s"), "component")).alias("b")).select(F.col("b.component").alias("component"), F.lit(True).alias("top"))
    return found.join(size, "component").where("size >= 2").join(best, "component", "left").select("node", "component", "size", F.coalesce("top", F.lit(False)).alias("largest"))


@query(
    "GR6 GR9 G12",
    """WITH c AS (SELECT DISTINCT p_size % 10 AS x, p_partkey % 10 AS y FROM part WHERE p_retailprice > 905), q AS (SELECT x * 10 + y AS node, x, y FROM c WHERE NOT (x = 3 AND y = 3))
SELECT a.node AS src, b.node AS dst, CAST((round_even(degrees(atan2(CAST(b.y - a.y AS DOUBLE), CAST(b.x - a.x AS DOUBLE))), 0) % 360 + 360) % 360 AS BIGINT) AS direction FROM q a JOIN q b ON abs(a.x - b.x) + abs(a.y - b.y) = 1""",
)
def graph_lattice(spark, d):
    cells = table(spark, d, "part").where("p_retailprice > 905").select(F.pmod("p_size", F.lit(10)).cast("long").alias("x"), F.pmod("p_partkey", F.lit(10)).alias("y")).distinct()
    removed = spark.createDataFrame([(3, 3)], "x long, y long")
    nodes = cells.join(removed, ["x", "y"], "left_anti").withColumn("node", F.col("x") * 10 + F.col("y"))
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (0, 1), (-1, 0), (0, -1))])
    near = nodes.select(F.col("node").alias("src"), "x", "y", F.inline(steps)).select("src", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "dx", "dy")
    direction = F.pmod(F.bround(F.degrees(F.atan2(F.col("dy").cast("double"), F.col("dx").cast("double"))), 0), F.lit(360)).cast("long")
    return near.join(nodes.withColumnRenamed("node", "dst"), ["x", "y"]).select("src", "dst", direction.alias("direction"))


@query(
    "GR3",
    """WITH s AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS i, CASE event_type WHEN 'view' THEN 90 WHEN 'signup' THEN 180 WHEN 'error' THEN 270 ELSE 0 END AS dir FROM events),
t AS (SELECT *, ((dir - coalesce(lag(dir) OVER (PARTITION BY user_id ORDER BY i), 0)) % 360 + 360) % 360 AS turn FROM s)
SELECT user_id, string_agg(CASE turn WHEN 0 THEN 'F' WHEN 90 THEN 'L,F' WHEN 180 THEN 'L,L,F' ELSE 'R,F' END, ',' ORDER BY i) || ',STOP' AS actions FROM t GROUP BY user_id""",
)
def oracle_actions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    direction = F.when(F.col("event_type") == "view", 90).when(F.col("event_type") == "signup", 180).when(F.col("event_type") == "error", 270).otherwise(0)
    edges = table(spark, d, "events").select("user_id", F.row_number().over(w).alias("i"), F.pmod(direction - F.coalesce(F.lag(direction).over(w), F.lit(0)), F.lit(360)).alias("turn"))
    moves = F.when(F.col("turn") == 0, F.array(F.lit("F"))).when(F.col("turn") == 90, F.array(F.lit("L"), F.lit("F"))).when(F.col("turn") == 180, F.array(F.lit("L"), F.lit("L"), F.lit("F"))).otherwise(F.array(F.lit("R"), F.lit("F")))
    paths = edges.select("user_id", F.struct("i", moves.alias("m")).alias("s")).groupBy("user_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return paths.select("user_id", F.concat_ws(",", F.flatten(F.transform("s", lambda x: x["m"])), F.lit("STOP")).alias("actions"))


@query(
    "X6",
    f"""WITH RECURSIVE {_EDGES}, b(node, hops) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.dst, hops + 1 FROM b JOIN e ON b.node = e.src WHERE hops < 45), h AS (SELECT node, min(hops) AS hops FROM b GROUP BY node),
n AS (SELECT DISTINCT src AS node FROM e), p AS (SELECT c_custkey, c_acctbal / 250.0 AS at_ FROM customer), k AS (SELECT c_custkey, arg_min(node, (abs(at_ - node), node)) AS node FROM p, n GROUP BY c_custkey)
SELECT c_custkey, k.node, coalesce(hops, -1) AS hops FROM k LEFT JOIN h ON h.node = k.node""",
)
def distance_to_prediction(spark, d):
    edges = _edges(spark, d)
    line = F.lit(0.0).alias("y")
    nodes = edges.select(F.col("src").alias("node")).distinct().select("node", F.col("node").cast("double").alias("x"), line, F.lit(0).alias("k"))
    places = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 250.0).alias("x"), line, F.lit(0).alias("k"))
    near = nearest(places, nodes, ["k"], "c_custkey", "node")
    hops = distances(edges, spark.createDataFrame([(0,)], "node long")).select("node", "hops")
    return near.join(hops, "node", "left").select("c_custkey", "node", F.coalesce("hops", F.lit(-1)).alias("hops"))


@query(
    "X11 X12 X13 X15",
    """SELECT p_partkey, p_partkey % 81 // 9 AS row_, p_partkey % 81 % 9 AS col, p_partkey % 81 = 40 AS stop, p_size * 100 + p_partkey % 100 AS node, list_transform(range(0, 4), lambda i: CAST(trunc((p_size - 25) / 2.0) AS BIGINT) + i) AS lattice, -1 + 40 * 0.2 * (p_size // 10) AS extent FROM part""",
)
def flat_index(spark, d):
    action = F.pmod("p_partkey", F.lit(81))
    corner = ((F.col("p_size") - 25) / 2.0).cast("long")
    return table(spark, d, "part").select(
        "p_partkey", F.floor(action / 9).alias("row_"), F.pmod(action, F.lit(9)).alias("col"), (action == 40).alias("stop"), (F.col("p_size") * 100 + F.pmod("p_partkey", F.lit(100))).alias("node"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: corner + i).alias("lattice"), (F.lit(-1.0) + 40 * 0.2 * F.floor(F.col("p_size") / 10)).alias("extent"),
    )


@query(
    "X23 X24 X26",
    """SELECT vec_id, list_transform(range(1, 5), lambda i: round(CAST(embedding[i] AS DOUBLE) + CASE WHEN i = 1 THEN 0.1 ELSE 0 END, 6)) AS raised, list_transform(list_concat(embedding[1:2], embedding[1:2], embedding[1:2]), lambda x: round(CAST(x AS DOUBLE), 6)) AS tiled FROM embeddings""",
)
def nested_transform(spark, d):
    e = signal.doubles(F.col("embedding"))
    goals = F.transform(F.slice(e, 1, 4), lambda x, i: F.struct(x.alias("y"), F.lit(0).alias("iou"), i.alias("i")))
    raised = F.transform(goals, lambda g: signal.rounded(g["y"] + F.when(g["i"] == 0, 0.1).otherwise(0.0), 6))
    tiled = F.flatten(F.array_repeat(F.transform(F.slice(e, 1, 2), lambda x: signal.rounded(x, 6)), 3))
    return table(spark, d, "embeddings").select("vec_id", raised.alias("raised"), tiled.alias("tiled"))
