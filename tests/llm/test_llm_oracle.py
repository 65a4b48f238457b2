"""Queries of this subpackage that SQL can express, against that SQL on the smallest tables."""

import duckdb
import pytest

from dossierlake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda columns, rows: sorted((tuple(r[columns.index(n)] for n in sorted(names)) for r in rows), key=repr)
    assert plain(got.columns, got.collect()) == plain(names, cursor.fetchall())
