"""Each registered query of the library against its SQL on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from textloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    expected = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(expected.columns)
    assert sorted(df.columns) == columns
    kinds = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: TYPES.get(t) for c, t in df.dtypes} == kinds
    at = [expected.columns.index(c) for c in columns]
    theirs = Counter(tuple(plain(row[k]) for k in at) for row in expected.fetchall())
    mine = Counter(tuple(plain(v) for v in row) for row in df.select(*columns).collect())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
