"""Every media query that has SQL, on the small tables."""

import pytest
from clipweave.plans.registry import collect
from compare import SF, connect, spark_rows, sql_rows

QUERIES, SQL = collect("QUERIES"), collect("SQL")


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(connect(), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
