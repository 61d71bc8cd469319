"""Every engine query against relational SQL in DuckDB."""

import pytest
from helpers import oracle_rows, spark_rows

from quadrille import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    assert spark_rows(queries.QUERIES[name](spark, small)) == oracle_rows(queries.SQL[name], small)


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 25


def test_constants_reach_the_reader(spark, small):
    """A constant subject or object is a filter on the table's own column, and only the columns asked for are read."""
    plan = queries.sparql("SELECT ?c WHERE { ?o v:o_orderstatus 'F' . ?o v:o_custkey ?c }")(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_orderpriority" not in plan
    assert "EqualTo(c_custkey,7)" in queries.sparql("SELECT ?o WHERE { b:customer\\/7 v:c_name ?o }")(spark, small)._jdf.queryExecution().executedPlan().toString()


def test_stars_need_no_join(spark, small):
    for text in (queries.SELECTS["bgp_star"][0], "SELECT * WHERE { ?s v:o_orderstatus 'F' . ?s v:o_custkey b:customer\\/7 . ?s v:o_orderpriority ?p . ?s v:o_orderpriority ?q }"):
        df = queries.sparql(text)(spark, small)
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    both = queries.sparql("SELECT * WHERE { ?s v:n_regionkey ?r . ?s v:n_name ?r }")(spark, small)  # a variable twice in a star
    assert both.count() == 0


@pytest.mark.parametrize("name", ["page_concat", "stored_pages"])
def test_pages_are_one_plan(spark, small, name):
    """Results of several pages at this scale: the written rows are read by one scan."""
    sf_dir = small.replace("sf0.001", "sf0.01")
    df = queries.QUERIES[name](spark, sf_dir)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert spark_rows(df) == oracle_rows(queries.SQL[name], sf_dir)
