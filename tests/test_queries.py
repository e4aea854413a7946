"""Every audit query against its SQL, and the entry points."""

import pytest

from auditspan import oracles, queries

from .helpers import same_as_sql


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    same_as_sql(queries.queries()[name](spark, sf_dir), oracles.oracle_sql()[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracles.oracle_sql())))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count() > 0


def test_sql_has_queries():
    assert set(oracles.oracle_sql()) <= set(queries.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
