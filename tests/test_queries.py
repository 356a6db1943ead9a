"""Every registered query against its SQL twin in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
ORACLES = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return None
        return round(value, 9) if isinstance(value, float) else value

    return sorted([tuple(cell(row[i]) for i in order) for row in rows], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, sf, duck, name):
    df = entry_point.queries()[name](spark, sf)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(df.columns, df.collect()) == table(columns, cursor.fetchall())


def test_entry_has_rows(spark):
    assert not entry_point.entry(spark).isEmpty()


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(entry_point.queries())
