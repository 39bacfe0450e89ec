"""Every registered query over whole tables against its SQL."""

import duckdb
import pytest
from keyweave.plans import tpch
from keyweave.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def other(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, data, other, name):
    found = QUERIES[name](spark, data)
    names = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in found.collect()), key=repr)
    other.execute(ORACLE_SQL[name])
    theirs = [d[0] for d in other.description]
    assert sorted(theirs) == names
    expected = sorted((tuple(plain(dict(zip(theirs, r))[c]) for c in names) for r in other.fetchall()), key=repr)
    assert rows == expected


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_some_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", sorted(tpch.DRAWS))
def test_drawn_parameters(name):
    """The same for a seed, among those that the query has, and not the same for all seeds."""
    draws = [tpch.drawn(name, seed) for seed in range(40)]
    assert draws == [tpch.drawn(name, seed) for seed in range(40)]
    assert all(d.keys() <= tpch.QUERIES[name].params.keys() for d in draws)
    assert any(d != draws[0] for d in draws)
