"""Every registered audit query against its SQL, or for a run and some rows."""

import pytest
from conftest import DATA, same_as_sql

from stratalens import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, duck, name):
    same_as_sql(spark, duck, catalog.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry_imports_and_lists_queries(spark):
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 3
