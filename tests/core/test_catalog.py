"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from palimpsest.catalog.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SOME = sorted(ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        t = name.removesuffix(".parquet")
        path = f"{SF}/{name}" if os.path.isfile(f"{SF}/{name}") else f"{SF}/{name}/*.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(table):
    columns = sorted(table.column_names)
    return sorted(map(repr, zip(*(table.column(c).to_pylist() for c in columns), strict=True)))


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    want = duck.sql(ORACLE_SQL[name]).to_arrow_table()
    got = QUERIES[name](spark, SF).toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_names_agree():
    assert set(ORACLE_SQL) <= set(QUERIES)
