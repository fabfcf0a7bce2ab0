"""Every query against its SQL."""

import math

import duckdb
import pytest

from studylake.plans import registry

SF = "/root/testdata/sf0.01"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, bool):
        return str(x)
    return f"{float(x):.6g}" if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(map(plain, r)) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.fetchall())
    assert rows
