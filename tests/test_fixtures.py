"""Operators over small fixtures give the rows that are written out beside them."""

from __future__ import annotations

import duckdb
import fixture_queries
import fixture_streams
import fixture_texts
import pytest

from conftest import SF
from oracle import differences

QUERIES = fixture_queries.QUERIES | fixture_texts.QUERIES | fixture_streams.QUERIES
ROWS = fixture_queries.ORACLE_SQL | fixture_texts.ORACLE_SQL | fixture_streams.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ROWS))
def test_rows_are_the_expected_ones(spark, name):
    assert differences(QUERIES[name](spark, SF), duckdb.connect(), ROWS[name]) == ([], [])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ROWS)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
