"""Queries against their SQL on the smallest tables."""

import pytest

from tidemark.plans.catalogue import ORACLE_SQL, QUERIES

#: The lists and figures that these put together are compared one by one.
SLOW = {"model_comparison", "narrative"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL and n not in SLOW])
def test_query_agrees_with_sql(name, agree):
    agree(name, QUERIES, ORACLE_SQL)


def test_entry_and_maps(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).columns) == 3
    assert set(e.oracle_sql()) <= set(e.queries())
