"""Every named query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tidemart.plans.registry import ORACLES, QUERIES
from check_queries import compare, connect

SF_DIR = "/root/testdata/sf0.001"
OWN = list(QUERIES)


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    problem, n = compare(spark, duck, SF_DIR, entry.queries()[name], entry.oracle_sql().get(name))
    assert not problem and n > 0


def test_entry(spark):
    assert [r.name for r in entry.entry(spark).collect()] == ["20岁以下", "20岁至29岁", "30岁以上"]
