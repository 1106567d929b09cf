"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as contract
from adtally.plans.oracle import ORACLE
from adtally.plans.registered import QUERIES
from oracle_check import compare, connect


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, name):
    problem = compare(spark, QUERIES[name], ORACLE[name], small, connect(small))
    assert problem is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_hourly_count_known_figure(spark):
    counted = contract.queries()["campaign_window_count_hourly"](spark, "/root/testdata/sf0.01")
    assert counted.count() == 1729
    assert counted.agg({"seen_count": "sum"}).first()[0] == 1982
