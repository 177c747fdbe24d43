import pytest

from marram.plans import catalogue
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_agrees_with_sql(name, spark, small_dir):
    assert_same(catalogue.QUERIES[name](spark, small_dir), catalogue.ORACLE_SQL[name], small_dir)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_gives_rows(name, spark, small_dir):
    assert catalogue.QUERIES[name](spark, small_dir).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
