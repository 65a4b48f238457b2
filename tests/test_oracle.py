"""Every registered query of the reference's operators against its SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from dossierlake.plans import load
from dossierlake.plans.fixtures import GIVEN

SF = "/root/testdata/sf0.001"
REGISTRY = load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in GIVEN:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(REGISTRY.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    got = REGISTRY.QUERIES[name](spark, SF)
    cursor = duck.execute(REGISTRY.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(REGISTRY.QUERIES) - set(REGISTRY.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert REGISTRY.QUERIES[name](spark, SF).columns
