import pytest
from oracle import compare

import __spark_entry__ as entry
from rulemill.jobs import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name], sf)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
