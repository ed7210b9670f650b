"""Joins in space at their bounds and without broadcasts."""

import __spark_entry__ as entry
import duckdb
import pytest

from auralake.operators.joins import near_in_space


@pytest.mark.parametrize(("name", "far"), [("near_sources", 0.7), ("space_band_join", 0.8)])
def test_a_distance_at_the_bound_counts_as_in_sql(spark, tmp_path, name, far):
    """Pairs at the bound, by whose rounding their squares lie on one or the other side of it."""
    rows = [(7 * 31 * i, 0, round(100 * n + 1000 * far * k)) for i, (n, k) in enumerate((n, k) for n in range(90) for k in (0, 1))]
    spark.createDataFrame([(i, n, float(b)) for i, n, b in rows], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    found = entry.queries()[name](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    sql = duck.execute(entry.oracle_sql()[name])
    at = [found.columns.index(c[0]) for c in sql.description]
    assert sorted(tuple(r[i] for i in at) for r in found.collect()) == sorted(sql.fetchall())


def test_neither_side_of_a_join_in_space_is_broadcast(spark):
    points = spark.range(5000).selectExpr("id", "cast(id % 3 as int) as scene", "id / 100.0D as x", "0.0D as y", "0.0D as z")
    found = near_in_space(points, points, 0.0001, ["scene"])
    assert found.count() == 5000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "NestedLoop" not in plan


@pytest.fixture(scope="module")
def boxes(spark, tmp_path_factory):
    """Boxes, some with a key twice, and points of which many lie on the boxes' sides, several in one place, on few lines."""
    place = str(tmp_path_factory.mktemp("boxes"))
    part = spark.range(0, 12000, 5).selectExpr("id as p_partkey", "cast(id % 50 + 1 as int) as p_size")
    part.unionByName(part.where("p_partkey % 7 = 0")).write.parquet(f"{place}/part.parquet")
    points = spark.range(6000).selectExpr("id as c_custkey", "0 as c_nationkey", "cast(floor(id / 31) % 100 * 100 - 1000 + 10 * (id % 3) as double) as c_acctbal")
    points.unionByName(points.where("c_custkey % 11 = 0")).unionByName(points.limit(1).selectExpr("c_custkey", "c_nationkey", "cast(null as double) as c_acctbal")).write.parquet(f"{place}/customer.parquet")
    return place


@pytest.mark.parametrize("name", ["points_in_boxes", "objects_per_scene"])
def test_points_in_boxes_are_counted_without_broadcasts(spark, boxes, name):
    found = entry.queries()[name](spark, boxes)
    duck = duckdb.connect()
    for table in ("customer", "part"):
        duck.execute(f"create view {table} as select * from '{boxes}/{table}.parquet/*.parquet'")
    sql = duck.execute(entry.oracle_sql()[name])
    at = [found.columns.index(c[0]) for c in sql.description]
    rows = sql.fetchall()
    assert rows and sorted(tuple(r[i] for i in at) for r in found.collect()) == sorted(rows)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_objects_near_points_at_bounds_and_without_broadcasts(spark, tmp_path):
    """Objects beside the only points of their scene, some in the cube of one, some around it, some at the distance itself."""
    objects = [(i * 217, n, float(100 * i - 3000)) for i in range(60) for n in (0, 1)]
    spark.createDataFrame(objects, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, 0, 0.0), (217, 0, 0.0), (434, 1, 1490.0)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    found = entry.queries()["objects_near_points"](spark, str(tmp_path))
    duck = duckdb.connect()
    for table in ("customer", "supplier"):
        duck.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    rows = sorted(duck.execute(entry.oracle_sql()["objects_near_points"]).fetchall())
    assert len(rows) == 2 and sorted((r.scene, r.objects) for r in found.collect()) == rows
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
