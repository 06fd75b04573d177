"""Every registered query against its oracle SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences, duck

SQL = entry.oracle_sql()


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, name):
    ours, theirs, same, more, less = differences(spark, duck(sf), sf, entry.queries()[name], SQL[name])
    assert same and ours == theirs and not more and not less, (more, less)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() >= 0
