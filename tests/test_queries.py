"""Every query with SQL gives the rows that DuckDB gives."""

import collections
import os

import pytest

from gneiss import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-6 * max(1.0, abs(a))


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_rows_match(spark, duck, name):
    out = registry.QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    got = [tuple(r) for r in out.select(columns).collect()]
    r = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in r.fetchall()]
    assert len(got) == len(want)
    if collections.Counter(map(repr, got)) != collections.Counter(map(repr, want)):
        key = lambda row: tuple(round(x, 4) if isinstance(x, float) else x for x in row)
        assert all(close(x, y) for a, b in zip(sorted(got, key=lambda r: repr(key(r))), sorted(want, key=lambda r: repr(key(r)))) for x, y in zip(a, b))


def test_all_have_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
