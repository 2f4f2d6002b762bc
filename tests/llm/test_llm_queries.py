"""Every query with SQL gives the same rows as DuckDB over the smallest tables."""

import os
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")
from evalloom.llm.oracle import oracle_sql  # noqa: E402
from evalloom.llm.queries import queries  # noqa: E402

DATA = os.environ.get("EVALLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_names():
    assert set(oracle_sql()) <= set(queries()) and {f"p{n}_found" for n in range(1, 10)} <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    rows = queries()[name](spark, DATA)
    got = rows.collect()
    if name.endswith("_found"):
        assert len(set(got)) == len(got)
    if name not in oracle_sql():
        return
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    found = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert Counter(map(tuple, got)) == Counter(found)
