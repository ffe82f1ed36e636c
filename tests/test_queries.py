"""Every query with SQL against that SQL in DuckDB, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from trackmill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    got = [tuple(plain(r[c]) for c in sorted(found.columns)) for r in found.collect()]
    rel = duck.sql(registry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    assert sorted(rel.columns) == sorted(found.columns)
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    """What they give is held against brute force in the tests of their operators."""
    found = registry.queries()[name](spark, SF).collect()
    assert found and all(len(r) == len(found[0]) for r in found)
