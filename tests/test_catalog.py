import pytest

from braidgraph.plans import catalog
from compare import assert_equal


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, small, name):
    assert_equal(catalog.QUERIES[name](spark, small), catalog.ORACLES[name], small)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
