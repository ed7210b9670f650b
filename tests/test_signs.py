"""Signs that SQL keeps: of straight behind, and of zeros that rounding leaves."""

import math

import __spark_entry__ as entry
import duckdb

from .test_queries import plain


def _both(spark, folder, name, table):
    found = entry.queries()[name](spark, folder)
    duck = duckdb.connect()
    duck.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    sql = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in sql.description]
    return sorted(plain([r[n] for n in names]) for r in found.collect()), sorted(map(plain, sql.fetchall()))


def test_straight_behind(spark, tmp_path):
    """Suppliers straight behind and straight ahead."""
    rows = [(k, n, float(b)) for k in range(720) if k * 37 % 90 == 0 for n in (12, 7, 20) for b in (0, 2150, -300)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    found, expected = _both(spark, str(tmp_path), "azimuth_geometry", "supplier")
    assert found == expected


def test_zeros_keep_their_sign(spark, tmp_path):
    small = [0.0, -0.0, 1e-9, -1e-9, 4e-7, -4e-7, -6e-7, 0.3, -0.3, math.nan]
    rows = [(i, i % 5, [small[(i + k * (i + 1)) % len(small)] for k in range(64)]) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("mono_gain", "nested_transform", "nested_goals"):
        found, expected = _both(spark, str(tmp_path), name, "embeddings")
        assert found == expected, name
