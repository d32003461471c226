"""Every query of the library against its SQL on the small tables."""

import duckdb
import pytest

from netloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def key(row):
    return [(x is None, str(type(x)), x if not isinstance(x, float) else round(x, 9)) for x in row]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    assert rows, "an empty result tests nothing"
    if name not in ORACLES:
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == sorted(got.columns)
    order = [want.columns.index(c) for c in got.columns]
    expected = [tuple(r[i] for i in order) for r in want.fetchall()]
    assert sorted(map(repr, map(key, rows))) == sorted(map(repr, map(key, expected)))
