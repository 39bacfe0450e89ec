"""The registered queries over whole tables."""

import duckdb
import pytest
from keyweave.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_over_the_whole_table(spark, data, name):
    found = QUERIES[name](spark, data)
    table, key = ("pages", "page_id") if name.startswith("op6") else ("documents", "doc_id")
    ids = sorted(r[0] for r in found.select(key).collect())
    if name.startswith("op5"):
        assert ids
    else:
        assert ids == sorted(r[0] for r in spark.read.parquet(f"{data}/{table}.parquet").select(key).collect())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, data, name):
    other = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        other.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = QUERIES[name](spark, data)
    other.execute(ORACLE_SQL[name])
    names = sorted(found.columns)
    theirs = [x[0] for x in other.description]
    assert sorted(theirs) == names
    assert sorted(tuple(r[c] for c in names) for r in found.collect()) == sorted(tuple(dict(zip(theirs, r))[c] for c in names) for r in other.fetchall())
