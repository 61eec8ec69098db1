"""Every relational query against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from tessera.plans import catalogue, composed, statements, text  # noqa: F401

DATA = "/root/testdata/sf0.001"
ORACLES = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in catalogue.TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_duckdb(spark, duck, name):
    ours = catalogue.queries()[name](spark, DATA)
    theirs = duck.sql(ORACLES[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours.collect(), ours.columns) == canonical(theirs.fetchall(), theirs.columns)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(catalogue.queries()) == set(ORACLES)
