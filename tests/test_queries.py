"""Each registered query of the trace operators against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tracelark import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    if not os.path.isdir(DATA):
        pytest.skip("the tables are not here")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, database, name):
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(database.sql(queries.ORACLE_SQL[name]).df())


def test_entry_points_hold_together():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
