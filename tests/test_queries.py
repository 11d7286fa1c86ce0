"""Every registered query against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from quarry.plans import REGISTRY

FOLDER = os.environ.get("QUARRY_TEST_TABLES", "/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for n in NAMES:
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{FOLDER}/{n}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "None" if math.isnan(v) else f"{v:.5f}"
    return f"{v:.5f}" if isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_query(spark, duck, name):
    got = REGISTRY.queries[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in got.collect())
    if name not in REGISTRY.sql:
        assert rows
        return
    want = duck.sql(REGISTRY.sql[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted([plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at] for r in want.fetchall())
