"""Queries that SQL can express, against DuckDB over the same tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from tests.llm.conftest import SF
from weekover.llm import queries

KINDS = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    kinds = {row[0]: KINDS[row[1]] for row in con.execute(f"DESCRIBE {queries.ORACLES[name]}").fetchall()}
    assert dict(df.dtypes) == kinds
    found = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(map(str, map(tuple, df.select(columns).collect()))) == sorted(map(str, found.fetchall()))


def test_all_are_registered():
    names = set(contract.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(queries.ORACLES) <= set(contract.oracle_sql())
