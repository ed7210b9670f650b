"""Scans, projections, integrity rules, joins and sorts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.joins import band_join, nearest, violations
from ..operators.windows import numbered
from ..registry import query
from ..sources.tables import finite, json_safe, parse_jsonl, table, tagged


@query(
    "SC1 SC2 SK1 T1 PF1",
    """SELECT CAST(event_id AS VARCHAR) AS id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events ORDER BY id""",
)
def manifest_scan_sorted(spark, d):
    events = table(spark, d, "events")
    lines = events.select(F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props")).alias("value"))
    rows = parse_jsonl(lines, "event_id long, user_id long, event_type string, value double, props string")
    k = F.get_json_object("props", "$.k").cast("long")
    return rows.select(F.col("event_id").cast("string").alias("id"), "user_id", "event_type", json_safe(F.col("value")).alias("value"), k.alias("k")).orderBy("id")


@query(
    "J8 PF16",
    """SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 3""",
)
def registry_broadcast_lookup(spark, d):
    nation, region, supplier = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    registry = nation.join(region.where("r_regionkey <> 3"), nation.n_regionkey == region.r_regionkey)
    return supplier.join(registry, supplier.s_nationkey == registry.n_nationkey).select("s_suppkey", "s_name", "n_name", "r_name")


@query(
    "S1 S2 S3 S4 S5 S6 S7 S8 S10 S11 S12 J12",
    """SELECT o_orderkey, 'ep_' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS episode_id,
  'ep_' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '__' || o_orderpriority AS composite,
  split_part(o_orderpriority, '-', 2) AS priority_name, replace(replace(o_orderpriority, ' ', '_'), '.', '_') AS slug,
  printf('%.2f', o_totalprice) || '_' || printf('%.2f', o_totalprice / 8) AS position_key,
  sha256('20260824:' || o_orderkey) AS digest,
  CAST(CAST(('0x' || substr(sha256('20260824:' || o_orderkey), 1, 16)) AS UBIGINT) AS DECIMAL(20,0)) AS seed,
  '{"k":' || o_orderkey || ',"p":"' || o_orderpriority || '"}' AS json,
  CAST(regexp_extract('ckpt.' || o_orderkey || '.pth', '\\.([0-9]+)\\.', 1) AS INTEGER) AS suffix,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 99 END AS status_rank,
  o_orderpriority LIKE '1%' OR o_orderpriority LIKE '%LOW' AS tagged
FROM orders""",
)
def string_keys(spark, d):
    orders = table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    episode = F.concat(F.lit("ep_"), F.lpad(key, 6, "0"))
    digest = F.sha2(F.concat(F.lit("20260824:"), key), 256)
    ranks = F.map_concat(F.create_map(F.lit("F"), F.lit(1)), F.create_map(F.lit("O"), F.lit(2)))
    two = lambda c: F.regexp_replace(F.call_function("format_number", c, F.lit("0.00")), ",", "")
    return orders.select(
        "o_orderkey", episode.alias("episode_id"), F.concat_ws("__", episode, "o_orderpriority").alias("composite"),
        F.element_at(F.split("o_orderpriority", "-"), 2).alias("priority_name"), F.translate("o_orderpriority", " .", "__").alias("slug"),
        F.concat_ws("_", two(F.col("o_totalprice")), two(F.col("o_totalprice") / 8)).alias("position_key"),
        digest.alias("digest"), F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").alias("seed"),
        F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))).alias("json"),
        F.regexp_extract(F.format_string("ckpt.%d.pth", "o_orderkey"), r"\.([0-9]+)\.", 1).cast("int").alias("suffix"),
        F.coalesce(F.try_element_at(ranks, F.col("o_orderstatus")), F.lit(99)).alias("status_rank"),
        (F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").endswith("LOW")).alias("tagged"),
    )


@query(
    "SC9 PF3 PF4 PF14",
    """WITH p AS (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS path FROM pages)
SELECT page_id, split_part(path, '/', 3) AS host, split_part(path, '/', 4) AS scene,
  'data/' || CASE WHEN starts_with(path, 'https://') THEN substr(path, 9) ELSE path END AS stored,
  NOT (contains(path, '..') OR starts_with(path, '/')) AS safe
FROM p""",
)
def path_partition_discovery(spark, d):
    path = F.regexp_extract("url", r"^([^?#]*)", 1)
    pages = table(spark, d, "pages").select("page_id", path.alias("path"))
    stripped = F.when(F.col("path").startswith("https://"), F.substring("path", 9, 1 << 20)).otherwise(F.col("path"))
    return pages.select(
        "page_id", F.coalesce(F.get(F.split("path", "/"), F.lit(2)), F.lit("")).alias("host"), F.coalesce(F.get(F.split("path", "/"), F.lit(3)), F.lit("")).alias("scene"),
        F.concat_ws("/", F.lit("data"), stripped).alias("stored"), (~(F.col("path").contains("..") | F.col("path").startswith("/"))).alias("safe"),
    )


@query(
    "SC11 J9 J10",
    """SELECT n_nationkey AS object_id, n_name AS object_name, CASE WHEN n_regionkey = 4 THEN -1 ELSE n_regionkey END AS category,
  CASE WHEN n_regionkey = 4 THEN 'none' ELSE coalesce(r_name, 'none') END AS category_name
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND n_regionkey <> 4 WHERE n_regionkey <> 2""",
)
def record_typed_text(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    code = F.when(F.col("n_regionkey") == 4, F.lit(-1)).otherwise(F.col("n_regionkey"))
    lines = nation.select(F.concat_ws("  ", F.lit("O"), "n_nationkey", code, "n_name").alias("value")).unionByName(region.select(F.concat_ws(" ", F.lit("C"), "r_regionkey", F.regexp_replace("r_name", " ", "~")).alias("value")))
    objects = tagged(lines, "O", ["object_id", "category", "object_name"])
    categories = tagged(lines, "C", ["category", "category_name"])
    listed = categories.where("category <> '2'").select("category").unionByName(spark.createDataFrame([("-1",)], "category string"))
    kept = objects.join(listed, "category", "left_semi").join(categories, "category", "left")
    return kept.select(F.col("object_id").cast("int").alias("object_id"), "object_name", F.col("category").cast("int").alias("category"), F.coalesce(F.regexp_replace("category_name", "~", " "), F.lit("none")).alias("category_name"))


@query(
    "PF2 Q10",
    """WITH f(scene, rem) AS (VALUES ('src1', 0), ('src', 3), ('c1', 0), ('src2', 5))
SELECT doc_id, source, f.scene AS filter_scene FROM documents JOIN f ON contains(source, f.scene) AND doc_id % 7 = f.rem""",
)
def filter_ids_bag(spark, d):
    wanted = spark.createDataFrame([("src1", 0), ("src", 3), ("c1", 0), ("src2", 5)], "scene string, rem int")
    documents = table(spark, d, "documents").select("doc_id", "source")
    return documents.join(F.broadcast(wanted), (F.pmod("doc_id", F.lit(7)) == F.col("rem")) & F.contains("source", "scene")).select("doc_id", "source", F.col("scene").alias("filter_scene"))


@query(
    "PF5 PF6 A14 T7",
    """WITH r AS (SELECT CASE WHEN l_discount >= 0.09 THEN 'snap_failed' WHEN l_tax >= 0.07 THEN 'outside_navmesh' WHEN l_quantity <= 2 THEN 'actual_move_too_small' WHEN l_returnflag = 'A' THEN 'no_path' END AS reason FROM lineitem)
SELECT reason, count(*) AS n, count(*) FILTER (reason IS NULL) AS valid FROM r GROUP BY reason ORDER BY reason""",
)
def reason_case_chain(spark, d):
    reason = F.when(F.col("l_discount") >= 0.09, "snap_failed").when(F.col("l_tax") >= 0.07, "outside_navmesh").when(F.col("l_quantity") <= 2, "actual_move_too_small").when(F.col("l_returnflag") == "A", "no_path")
    rows = table(spark, d, "lineitem").select(reason.alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("reason").isNull(), F.lit(False))).alias("valid")).orderBy("reason")


@query(
    "PF8 PF9 SO4 W16",
    """WITH o(prio, rank) AS (VALUES ('3-MEDIUM', 0), ('1-URGENT', 1), ('5-LOW', 2), ('9-NONE', 3))
SELECT o_orderkey, rank, (row_number() OVER (PARTITION BY rank ORDER BY o_orderkey) - 1) % 8 AS worker FROM orders JOIN o ON o_orderpriority = prio WHERE prio <> '5-LOW'""",
)
def enum_ordered_filter(spark, d):
    ranked = spark.createDataFrame([("3-MEDIUM", 0), ("1-URGENT", 1), ("5-LOW", 2), ("9-NONE", 3)], "o_orderpriority string, rank int").where("o_orderpriority <> '5-LOW'")
    rows = table(spark, d, "orders").join(F.broadcast(ranked), "o_orderpriority").select("rank", "o_orderkey")  # a row for each rank
    return numbered(rows, ["rank"], ["o_orderkey"], "at").select("o_orderkey", "rank", F.pmod("at", F.lit(8)).alias("worker"))


@query("PF10 PF11 SK8", """SELECT event_id, 'info.k' AS name, CAST(json_extract(props, '$.k') AS DOUBLE) AS scalar FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, 'value', value FROM events""")
def json_scalar_flatten(spark, d):
    events = table(spark, d, "events").withColumn("info", F.from_json("props", "map<string,double>"))
    nested = F.transform_keys("info", lambda k, _: F.concat(F.lit("info."), k))
    flat = F.map_concat(nested, F.create_map(F.lit("value"), F.col("value")))
    rows = events.drop("props", "ts", "user_id").select("event_id", "event_type", F.explode(flat).alias("name", "scalar"))
    return rows.where((F.col("event_type") != "error") | (F.col("name") == "value")).select("event_id", "name", "scalar")


@query(
    "J1 W8 G1",
    """WITH f AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id, arg_min(value, (ts, event_id)) AS base FROM events GROUP BY user_id)
SELECT event_id, user_id, round(value - base, 6) AS delta, round(((value - base + 180) % 360 + 360) % 360 - 180, 6) AS azimuth_delta FROM events JOIN f USING (user_id) WHERE event_id <> first_id AND event_type <> 'error'""",
)
def compare_to_baseline(spark, d):
    events = table(spark, d, "events")
    first = events.groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "value")).alias("f")).select("user_id", F.col("f.event_id").alias("first_id"), F.col("f.value").alias("base"))
    delta = F.col("value") - F.col("base")
    return events.where("event_type <> 'error'").join(first, "user_id").where("event_id <> first_id").select("event_id", "user_id", F.round(delta, 6).alias("delta"), F.round(F.pmod(delta + 180, F.lit(360.0)) - 180, 6).alias("azimuth_delta"))


@query(
    "J2 J3 SO2 SC15",
    """SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') UNION ALL SELECT 'part', p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)""",
)
def orphan_antijoin(spark, d):
    customer, part, orders, lineitem = (table(spark, d, t) for t in ("customer", "part", "orders", "lineitem"))
    orders, lineitem = orders.where("o_orderpriority = '1-URGENT'"), lineitem.where("l_returnflag = 'R' and l_quantity > 40")
    a = customer.join(orders, customer.c_custkey == orders.o_custkey, "left_anti").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    b = part.join(lineitem, part.p_partkey == lineitem.l_partkey, "left_anti").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"))
    return a.unionByName(b)


@query(
    "J4 A18 PF12",
    """WITH c AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT (l_returnflag, l_linestatus)) AS states FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(states, 0) AS states, (o_orderstatus = 'F') = (coalesce(n, 0) >= 4) AS consistent FROM orders LEFT JOIN c ON l_orderkey = o_orderkey WHERE coalesce(states, 0) <> 1""",
)
def cardinality_check(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct(F.struct("l_returnflag", "l_linestatus")).alias("states"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    rows = orders.join(counts, orders.o_orderkey == counts.l_orderkey, "left").na.fill(0, ["n", "states"])
    return rows.where("states <> 1").select("o_orderkey", "n", "states", (F.col("o_orderstatus") == "F").eqNullSafe(F.col("n") >= 4).alias("consistent"))


@query("A19 V1 SO5", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL""")
def pk_violations(spark, d):
    return violations(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "J7 V10 V2",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'render' WHEN quality = 1 AND n_chars > 0 THEN 'skip' ELSE 'again' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def resume_incremental(spark, d):
    planned, existing = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("found"))
    action = F.when(F.col("found").isNull(), "render").when((F.col("quality") == 1) & (F.col("n_chars") > 0), "skip").otherwise("again")
    return planned.join(existing, "doc_id", "left").select("doc_id", action.alias("action"))


@query(
    "J13",
    """SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(abs(a.s_acctbal - b.s_acctbal), 6) AS gap FROM supplier a JOIN supplier b ON a.s_nationkey % 5 = b.s_nationkey % 5 AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) > 1 AND abs(a.s_acctbal - b.s_acctbal) < 250""",
)
def range_band_join(spark, d):
    points = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.pmod("s_nationkey", F.lit(5)).alias("scene"))
    gap = F.round(F.abs(F.col("l.x") - F.col("r.x")), 6)
    found = band_join(points, points, "x", 250.0, ["scene"]).where(F.col("l.id") < F.col("r.id"))
    near = F.abs(F.col("l.x") - F.col("r.x"))
    return found.where((near > 1) & (near < 250)).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), gap.alias("gap"))


@query(
    "J14",
    """WITH g AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), s AS (SELECT vec_id, label, CAST(embedding[3] AS DOUBLE) AS x, CAST(embedding[4] AS DOUBLE) AS y FROM embeddings),
r AS (SELECT q.vec_id, arg_min(s.vec_id, ((q.x - s.x) * (q.x - s.x) + (q.y - s.y) * (q.y - s.y), s.vec_id)) AS nearest, min((q.x - s.x) * (q.x - s.x) + (q.y - s.y) * (q.y - s.y)) AS d2 FROM g q JOIN s ON q.label = s.label GROUP BY 1)
SELECT vec_id, nearest, round(sqrt(d2), 6) AS distance FROM r""",
)
def nearest_neighbor(spark, d):
    at = lambda i, name: F.col("embedding")[i].cast("double").alias(name)
    points = table(spark, d, "embeddings").select("vec_id", "label", at(0, "x"), at(1, "y"))
    nodes = table(spark, d, "embeddings").select(F.col("vec_id").alias("nearest"), "label", at(2, "x"), at(3, "y"))
    found = nearest(points, nodes, ["label"], "vec_id", "nearest")
    return found.select("vec_id", "nearest", F.round(F.sqrt("d2"), 6).alias("distance"))


@query(
    "J17 A1",
    """WITH l AS (SELECT l_orderkey, l_extendedprice AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
p AS (SELECT a.l_orderkey, abs(a.x - b.x) AS d FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.i < b.i)
SELECT l_orderkey, count(*) AS pairs, round(min(d), 4) AS least, round(quantile_cont(d, 0.5), 4) AS middle, round(max(d), 4) AS most FROM p GROUP BY 1""",
)
def pairwise_in_group(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("x"), F.row_number().over(order).alias("i"))
    pairs = lines.join(lines.select("l_orderkey", F.col("x").alias("y"), F.col("i").alias("j")), "l_orderkey").where("i < j").select("l_orderkey", F.abs(F.col("x") - F.col("y")).alias("d"))
    return pairs.groupBy("l_orderkey").agg(F.count("*").alias("pairs"), F.round(F.min("d"), 4).alias("least"), F.round(F.percentile("d", 0.5), 4).alias("middle"), F.round(F.max("d"), 4).alias("most"))


@query("J19 J20 T9", """SELECT r_regionkey, i AS step, [0, 90, 180, 270][i + 1] AS angle FROM region, (SELECT unnest([0, 1, 2, 3]) AS i)""")
def cross_actions(spark, d):
    return table(spark, d, "region").select("r_regionkey", F.posexplode(F.array(*map(F.lit, (0, 90, 180, 270)))).alias("step", "angle"))


@query(
    "J18 T5",
    """WITH k AS (SELECT s_nationkey AS scene, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256('7:s:' || s_suppkey), s_suppkey) AS ns, row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256('7:r:' || s_suppkey), s_suppkey) AS nr FROM supplier)
SELECT a.scene, a.id AS s, b.id AS r FROM k a JOIN k b ON a.scene = b.scene AND a.ns <= 5 AND b.nr <= 5""",
)
def group_pair_product(spark, d):
    """Five senders and five receivers of each scene, drawn by a seeded hash, and all pairs of these; never all pairs of a scene."""
    nodes = table(spark, d, "supplier").select(F.col("s_nationkey").alias("scene"), F.col("s_suppkey").alias("id"))
    drawn = lambda role: nodes.withColumn("n", F.row_number().over(Window.partitionBy("scene").orderBy(F.sha2(F.concat_ws(":", F.lit(7), F.lit(role), "id"), 256), "id"))).where("n <= 5").select("scene", F.col("id").alias(role))
    return drawn("s").join(drawn("r"), "scene").select("scene", "s", "r")


@query(
    "J22 W14 T6 SC14",
    """SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1, 2""",
)
def first_by_key(spark, d):
    found = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("a"), F.max(F.struct("ts", "event_id", "value")).alias("b"))
    return found.select("user_id", "event_type", F.col("a.event_id").alias("first_id"), F.col("b.event_id").alias("last_id"), F.col("b.value").alias("last_value"))


@query(
    "SC7 SC8 SK11",
    """SELECT conv_id, turn, role, length(text) AS chars FROM conversations""",
)
def nested_explode(spark, d):
    turns = table(spark, d, "conversations")
    episodes = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    written = episodes.select(F.to_json(F.struct("conv_id", "turns")).alias("value"))
    read = parse_jsonl(written, "conv_id long, turns array<struct<turn:long,role:string,text:string>>")
    return read.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.turn", "t.role", F.length("t.text").alias("chars"))


@query("SC10", """SELECT s_suppkey AS node, round(s_acctbal, 4) AS x, round(s_nationkey - 1.5528907, 6) AS y, round(-(s_acctbal / 10), 6) AS z FROM supplier""")
def text_axis_remap(spark, d):
    lines = table(spark, d, "supplier").select(F.concat_ws("\t", "s_suppkey", F.col("s_acctbal").cast("string"), (F.col("s_acctbal") / 10).cast("string"), "s_nationkey").alias("value"))
    t = F.split("value", "\t")
    read = lines.select(t[0].cast("long").alias("node"), t[1].cast("double").alias("x"), t[2].cast("double").alias("y"), t[3].cast("double").alias("z"))
    return read.select("node", F.round("x", 4).alias("x"), F.round(F.col("z") - 1.5528907, 6).alias("y"), F.round(-F.col("y"), 6).alias("z"))


@query(
    "SK7 A10",
    """SELECT user_id || ',' || event_type AS key, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY user_id, event_type""",
)
def append_log(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("value").cast("decimal(18,2)").alias("v"))
    log = events.where("event_id % 2 = 0").unionByName(events.where("event_id % 2 <> 0"))
    return log.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("total")).select(F.concat_ws(",", "user_id", "event_type").alias("key"), "n", "total")


@query(
    "J21",
    """SELECT event_id, EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.value > 100) AS finished FROM events e""",
)
def unfinished_semi(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    done = events.where("event_type = 'purchase' and value > 100").select("user_id", F.lit(True).alias("done")).distinct()
    return events.select("event_id", "user_id").join(done, "user_id", "left").select("event_id", F.coalesce("done", F.lit(False)).alias("finished"))


@query(
    "J23 D12",
    """SELECT p_partkey, i AS band, CAST(125 * pow(2, i) AS DOUBLE) AS freq, round(least(1.0, greatest(0.0, p_retailprice / 2000.0 + i * 0.05)), 6) AS coeff FROM part, (SELECT unnest([0, 1, 2, 3]) AS i)""",
)
def material_explode(spark, d):
    freq = [125.0, 250.0, 500.0, 1000.0]
    interleaved = F.flatten(F.array(*[F.array(F.lit(f), F.col("p_retailprice") / 2000.0 + i * 0.05) for i, f in enumerate(freq)]))
    jittered = F.transform(interleaved, lambda x, i: F.when(i % 2 == 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))).otherwise(x))
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.get(jittered, i * 2).alias("freq"), F.round(F.get(jittered, i * 2 + 1), 6).alias("coeff")))).alias("band", "m"))
    return rows.select("p_partkey", "band", "m.freq", "m.coeff")


@query(
    "T2 T4",
    """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 99 END, coalesce(o_orderstatus, ''), o_totalprice DESC, o_orderkey LIMIT 50""",
)
def composite_sort_topk(spark, d):
    rank = F.coalesce(F.try_element_at(F.create_map(F.lit("1-URGENT"), F.lit(0), F.lit("2-HIGH"), F.lit(1)), F.col("o_orderpriority")), F.lit(99))
    return table(spark, d, "orders").orderBy(rank, F.coalesce("o_orderstatus", F.lit("")), F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query(
    "SO1 SO3",
    """SELECT 'initial' AS kind, r_regionkey AS id FROM region UNION ALL SELECT 'candidate', n_nationkey FROM nation UNION ALL SELECT 'same_keys', CAST((SELECT count(*) FROM (SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region)) + (SELECT count(*) FROM (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation)) AS INTEGER)""",
)
def union_viewpoints(spark, d):
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    a, b = nation.select(F.col("n_regionkey").alias("k")).distinct(), region.select(F.col("r_regionkey").alias("k")).distinct()
    unlike = a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").cast("int").alias("id")).select(F.lit("same_keys").alias("kind"), "id")
    return region.select(F.lit("initial").alias("kind"), F.col("r_regionkey").alias("id")).unionByName(nation.select(F.lit("candidate").alias("kind"), F.col("n_nationkey").alias("id"))).unionByName(unlike)


@query(
    "V1 V3 V5 A24",
    """WITH f AS (SELECT 'duplicate_key' AS rule, l_orderkey || '/' || l_linenumber AS key, 'hard' AS level FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'missing_order', CAST(l_orderkey AS VARCHAR), 'hard' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'price_range', CAST(o_orderkey AS VARCHAR), 'hard' FROM orders WHERE o_totalprice IS NULL OR o_totalprice < 0
UNION ALL SELECT 'loud', CAST(vec_id AS VARCHAR), 'warning' FROM embeddings WHERE list_max(list_transform(embedding, lambda x: abs(x))) > 0.4
UNION ALL SELECT 'short_text', CAST(doc_id AS VARCHAR), 'warning' FROM documents WHERE n_chars < 40)
SELECT rule, level, count(*) AS n, min(key) AS first_key FROM f GROUP BY rule, level""",
)
def validation_report(spark, d):
    lineitem, orders, embeddings, documents = (table(spark, d, t) for t in ("lineitem", "orders", "embeddings", "documents"))
    rule = lambda rows, name, key, level="hard": rows.select(F.lit(name).alias("rule"), key.cast("string").alias("key"), F.lit(level).alias("level"))
    found = [
        rule(violations(lineitem, ["l_orderkey", "l_linenumber"]), "duplicate_key", F.concat_ws("/", "l_orderkey", "l_linenumber")),
        rule(lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey, "left_anti"), "missing_order", F.col("l_orderkey")),
        rule(orders.where(~finite(F.col("o_totalprice")) | (F.col("o_totalprice") < 0)), "price_range", F.col("o_orderkey")),
        rule(embeddings.where(F.array_max(F.transform("embedding", F.abs)) > F.lit(0.4).cast("float")), "loud", F.col("vec_id"), "warning"),
        rule(documents.where("n_chars < 40"), "short_text", F.col("doc_id"), "warning"),
    ]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("rule", "level").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


@query(
    "R1 R3 SC13",
    """SELECT o_orderkey, CAST(CAST(('0x' || substr(sha256('20260824:ep_' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0')), 1, 16)) AS UBIGINT) AS DECIMAL(20,0)) AS seed,
  CAST(CAST(('0x' || substr(sha256('20260824:ep_' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0')), 1, 16)) AS UBIGINT) % 8 AS INTEGER) AS bucket FROM orders""",
)
def seeded_draw(spark, d):
    digest = F.sha2(F.concat(F.lit("20260824:ep_"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0")), 256)
    seed = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return table(spark, d, "orders").select("o_orderkey", seed.alias("seed"), (seed % 8).cast("int").alias("bucket"))


@query(
    "X1 X2 X17 X20 X25 X30",
    """SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 END AS task_id, p_partkey % 40 AS palette, CASE WHEN p_size > 25 THEN 256 ELSE 128 END AS resolution, a AS angle, coalesce(nullif(p_brand, 'Brand#1'), 'UNKNOWN') AS commit_id
FROM (SELECT *, unnest(CASE WHEN p_size > 25 THEN [0, 120, 240] ELSE [0, 90, 180, 270] END) AS a FROM part)""",
)
def lookup_projection(spark, d):
    tasks = F.create_map(*[F.lit(x) for kv in (("SMALL", 0), ("MEDIUM", 1), ("LARGE", 2)) for x in kv])
    wide = F.col("p_size") > 25
    angles = F.when(wide, F.array(*map(F.lit, (0, 120, 240)))).otherwise(F.array(*map(F.lit, (0, 90, 180, 270))))
    return table(spark, d, "part").select(
        "p_partkey", F.try_element_at(tasks, F.col("p_type")).alias("task_id"), F.pmod("p_partkey", F.lit(40)).alias("palette"), F.when(wide, 256).otherwise(128).alias("resolution"),
        F.explode(angles).alias("angle"), F.coalesce(F.nullif("p_brand", F.lit("Brand#1")), F.lit("UNKNOWN")).alias("commit_id"),
    )


@query(
    "X4 X5 X33 X34",
    """SELECT event_id, event_type = 'purchase' AND value < 50 AS success, event_type = 'error' OR (event_type = 'purchase' AND value < 50) AS done, coalesce(CASE event_type WHEN 'click' THEN 'FORWARD' WHEN 'view' THEN 'LEFT' WHEN 'signup' THEN 'RIGHT' END, 'STOP') AS action, least(value, 2.0) AS proximity FROM events""",
)
def done_success(spark, d):
    success = (F.col("event_type") == "purchase") & (F.col("value") < 50)
    action = F.when(F.col("event_type") == "click", "FORWARD").when(F.col("event_type") == "view", "LEFT").when(F.col("event_type") == "signup", "RIGHT")
    return table(spark, d, "events").select("event_id", success.alias("success"), ((F.col("event_type") == "error") | success).alias("done"), F.coalesce(action, F.lit("STOP")).alias("action"), F.least("value", F.lit(2.0)).alias("proximity"))


@query(
    "X16 X19 X31",
    """SELECT n_nationkey, d AS direction, CASE d WHEN 'left' THEN 45 ELSE -45 END AS yaw, true AS valid, (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents) AS total_bytes, printf('%.4f', n_nationkey / 7.0) AS shown FROM nation, (SELECT unnest(['left', 'right']) AS d)""",
)
def plan_extras(spark, d):
    total = table(spark, d, "documents").agg(F.sum("n_chars").alias("total_bytes")).scalar()
    turns = F.array(F.struct(F.lit("left").alias("direction"), F.lit(45).alias("yaw")), F.struct(F.lit("right").alias("direction"), F.lit(-45).alias("yaw")))
    rows = table(spark, d, "nation").select("n_nationkey", F.inline(turns))
    return rows.select("n_nationkey", "direction", "yaw", F.lit(True).alias("valid"), total.alias("total_bytes"), F.call_function("format_number", F.col("n_nationkey") / F.lit(7.0), F.lit("0.0000")).alias("shown"))
