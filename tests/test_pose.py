import math

import pytest
from pyspark.sql import functions as F

from auralake.functions import pose
from auralake.operators.graph import components, distances
from auralake.sources.tables import parse_jsonl, read_episodes, tagged


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize(("yaw", "x", "z"), [(0, 0, -1), (45, -math.sqrt(0.5), -math.sqrt(0.5)), (-45, math.sqrt(0.5), -math.sqrt(0.5)), (90, -1, 0)])
def test_forward(spark, yaw, x, z):
    got = one(spark, *pose.forward(F.lit(yaw)))
    assert got[0] == pytest.approx(x, abs=1e-9) and got[1] == pytest.approx(z, abs=1e-9)


@pytest.mark.parametrize("yaw", [180, -180, 540])
def test_yaw_is_half_open(spark, yaw):
    assert one(spark, pose.normalize_yaw(F.lit(float(yaw))))[0] == -180


@pytest.mark.parametrize(("x", "z", "azimuth"), [(0, -1, 0), (1, 0, 90), (-1, 0, -90)])
def test_azimuth(spark, x, z, azimuth):
    assert one(spark, pose.azimuth(F.lit(float(x)), F.lit(float(z)), F.lit(0.0)))[0] == pytest.approx(azimuth)


def test_jsonl_skips_blank_lines_and_refuses_bad_ones(spark):
    lines = spark.createDataFrame([('{"a": 1}',), ("  ",), ('{"a": 2}',)], "value string")
    assert sorted(r.a for r in parse_jsonl(lines, "a int").collect()) == [1, 2]
    with pytest.raises(Exception, match=r"(?i)malformed|parse"):
        parse_jsonl(spark.createDataFrame([("{nope",)], "value string"), "a int").collect()


def test_tagged_lines(spark):
    lines = spark.createDataFrame([("O 1 2 chair",), ("C 5 sofa",), ("O  3 4",)], "value string")
    assert sorted(tuple(r) for r in tagged(lines, "O", ["id", "category", "name"]).collect()) == sorted([("1", "2", "chair"), ("3", "4", None)], key=str)


def test_gzipped_episodes(spark, tmp_path):
    import gzip
    import json

    from pyspark.sql import types as T

    with gzip.open(tmp_path / "office.json.gz", "wt") as f:
        json.dump({"episodes": [{"episode_id": "1"}, {"episode_id": "2"}]}, f)
    rows = read_episodes(spark, str(tmp_path), T.StructType([T.StructField("episode_id", T.StringType())]))
    assert sorted(tuple(r) for r in rows.collect()) == [("office", "1"), ("office", "2")]


def test_graph_rounds(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11)]
    edges = spark.createDataFrame(links + [(b, a) for a, b in links], "src long, dst long")
    found = {r.node: (r.hops, r.parent) for r in distances(edges, spark.createDataFrame([(1,)], "node long")).collect()}
    assert found == {1: (0, None), 2: (1, 1), 3: (2, 2), 4: (3, 3)}
    labels = {r.node: r.component for r in components(edges.selectExpr("src as node").distinct(), edges).collect()}
    assert labels == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10}


def test_nearest_neighbours_agree_with_brute_force(spark):
    import random

    from auralake.operators.joins import nearest

    rng = random.Random(6)
    places = [(k, i, rng.gauss(0, 1) ** 3, rng.gauss(0, 1)) for i in range(300) for k in ("a", "b")]
    nodes = [(k, i, rng.gauss(0, 1) ** 3, rng.choice([0.0, 1.0])) for i in range(60) for k in ("a", "c")]
    points = spark.createDataFrame([(k, f"{k}{i}", x, y) for k, i, x, y in places], "k string, point string, x double, y double")
    found = nearest(points, spark.createDataFrame(nodes, "k string, node long, x double, y double"), ["k"], "point", "node").collect()
    want = {f"{k}{i}": min(((x - u) ** 2 + (y - v) ** 2, j) for q, j, u, v in nodes if q == k)[1] for k, i, x, y in places if k == "a"}
    assert {r.point: r.node for r in found} == want and len(found) == len(want)
    assert nearest(points, spark.createDataFrame([], "k string, node long, x double, y double"), ["k"], "point", "node").count() == 0
