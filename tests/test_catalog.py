"""Every registered query against its SQL twin, whole tables."""

import pytest

import __spark_entry__ as driver
from newsloom.catalog import QUERIES
from oracle import connect, duckdb_table, spark_table


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert name in driver.oracle_sql()
    columns, rows = spark_table(driver.queries()[name](spark, sf_dir))
    sql_columns, sql_rows = duckdb_table(con, driver.oracle_sql()[name])
    assert columns == sql_columns
    assert rows == sql_rows
    assert rows


def test_entry(spark):
    assert driver.entry(spark).count() == 10
