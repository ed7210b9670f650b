"""The llm queries that have SQL give DuckDB's rows."""

import os
from pathlib import Path

import duckdb
import pytest

from auralake.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows(spark, name):
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    frame = queries.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    found = connection.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert sorted(str(tuple(r[c] for c in columns)) for r in frame.collect()) == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


def test_pairs_of_like_openings(spark, tmp_path):
    """Shared openings, gaps between ids, openings left over and an odd number of conversations."""
    ids = [3, 4, 9, 70, 71, 200, 205, 300, 301, 999, 1000]
    rows = [(i, t, role, text) for n, i in enumerate(ids) for t, role, text in ((0, "system", f"open {n % 3}" if n < 8 else f"own {n}"), (1, "user", f"ask {i % 2}"), (2, "assistant", f"say {i}" if n % 2 else None))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    frame = queries.queries()["op3_preference_format"](spark, str(tmp_path))
    columns = sorted(frame.columns)
    connection = duckdb.connect()
    connection.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    found = connection.execute(queries.oracle_sql()["op3_preference_format"])
    names = [c[0] for c in found.description]
    mine = sorted(str(tuple(r[c] for c in columns)) for r in frame.collect())
    assert mine == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
    assert len({r.pair_id for r in frame.select("pair_id").collect()}) == (len(ids) + 1) // 2
