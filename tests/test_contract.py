import __spark_entry__ as contract


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
