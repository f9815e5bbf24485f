from __future__ import annotations

import pytest

import __spark_entry__
from lexloom.plans import catalogue

from conftest import SF
from oracle import connect, differences


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    assert differences(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLE_SQL[name]) == ([], [])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_is_the_flagship(spark):
    assert __spark_entry__.entry(spark).columns == ["qid", "id", "score", "rank", "q", "method"]
