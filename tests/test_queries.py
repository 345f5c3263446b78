import pytest

import __spark_entry__ as entry
from lexiquarry import queries as core

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query_equals_sql(spark, sf, same, name):
    same(core.queries()[name](spark, sf), SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 25
    assert set(core.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
