"""The numbered queries: registered once each, and equal to their SQL twins where they have one."""

import pytest

import __spark_entry__ as driver
from newsloom.llm.queries import ORACLES, QUERIES
from oracle import connect, duckdb_table, spark_table


def test_all_numbers_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert spark_table(QUERIES[name](spark, sf_dir)) == duckdb_table(connect(sf_dir), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_per_document(spark, sf_dir, documents, name):
    rows = QUERIES[name](spark, sf_dir)
    assert "doc_id" in rows.columns
    assert rows.select("doc_id").distinct().count() == documents.count()
