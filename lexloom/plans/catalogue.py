"""The registered queries over the test tables, with the SQL that checks them.

The tables stand in for a lexicon: documents are entries, sentences their glosses, ``labels.quality`` and length their priors,
``embeddings`` their vectors (by equal number), ``benchmark`` the queries, ``events`` the telemetry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import browse_queries, event_queries, search_queries, storage_queries, stored_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (text_queries, search_queries, browse_queries, event_queries, storage_queries, stored_queries):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
