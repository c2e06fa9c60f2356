"""Every query with an oracle, side by side at the smallest scale."""

import pytest

from compare import oracle_rows, spark_rows
from stepweave.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf, name):
    assert spark_rows(registry.QUERIES[name](spark, sf)) == oracle_rows(registry.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    """Values of these are in test_golden and test_rules; here the whole table goes through, twice with equal results."""
    df = registry.QUERIES[name](spark, sf)
    found = spark_rows(df)
    assert found[0] == sorted(df.columns) and found == spark_rows(registry.QUERIES[name](spark, sf))
