"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from conftest import SMALL

# The training-text queries have tests of their own.
OWN = {n for n in entry.queries() if n.startswith("op") or n == "pipeline"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - OWN))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SMALL, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_every_query_has_a_twin():
    assert set(entry.queries()) - set(entry.oracle_sql()) <= OWN


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_stable_twice(spark):
    first = entry.queries()["predict_employer"](spark, SMALL)
    again = entry.queries()["predict_employer"](spark, SMALL)
    assert first.schema == again.schema
    assert sorted(map(repr, first.collect())) == sorted(map(repr, again.collect()))
