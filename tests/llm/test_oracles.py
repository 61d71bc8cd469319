"""The queries against DuckDB on the smallest tables."""

import pytest
from helpers import oracle_rows, spark_rows

from quadrille.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, small, name):
    assert spark_rows(queries.QUERIES[name](spark, small)) == oracle_rows(queries.SQL[name], small)
