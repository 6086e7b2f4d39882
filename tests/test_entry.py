"""The driver contract holds with and without the optional parts."""

import __spark_entry__ as contract


def test_entry_returns_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
