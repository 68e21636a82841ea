"""Every query with SQL gives the SQL's rows on the smallest tables; the entry works without the optional subpackage."""

import os

import duckdb
import pytest

from pagelume.plans import registry

DIR = "/root/testdata/sf0.001"


def normal(v):
    if v is None or v != v:
        return None
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime().replace(tzinfo=None).isoformat()
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return bool(v)
    return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([normal(r[i]) for i in order]) for r in table)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(DIR):
        c.execute(f"create view {f[:-8]} as select * from '{DIR}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, DIR)
    data = got.collect()
    if name in registry.ORACLES:
        want = con.execute(registry.ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert rows(got.columns, data) == rows(columns, want.fetchall())
    else:
        assert got.columns


def test_entry_module():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
