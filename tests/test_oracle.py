"""Every named query against its DuckDB statement over the same parquet tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as contract
from weekover.plans import catalog, oracles

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events".split()
# The training-data queries have tests of their own.
SQL = oracles.statements()
KINDS = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
         "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, Decimal):
        pytest.fail("decimal in the output")
    return value if value is None or isinstance(value, bool) else str(value)


def _key(row):
    return tuple((c is None, str(c)) for c in row)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=_key)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    kinds = {row[0]: KINDS.get(row[1], row[1]) for row in duck.execute(f"DESCRIBE {SQL[name]}").fetchall()}
    assert dict(df.dtypes) == kinds
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    want = canonical(columns, cursor.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want)
    assert got == want
    assert got


def test_every_query_has_sql():
    assert set(catalog.REGISTRY) == set(SQL)


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0
