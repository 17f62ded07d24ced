"""Every catalog query that has SQL against DuckDB."""

import pytest
from differential import compare, connect

from ledgerloom.catalog import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
NAMES = sorted(all_oracles())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, all_queries()[name], all_oracles()[name], SF) is None


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["vendor", "direction", "cents", "n"]
