"""All registered queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.plans import catalog_queries, change_queries, import_queries, series_queries, settings_queries, similarity_queries, stream_queries
from gleaner.plans.domain import for_duckdb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _module in (catalog_queries, change_queries, import_queries, settings_queries, similarity_queries, series_queries, stream_queries):
    for _name, (_query, _sql) in _module.REGISTERED.items():
        QUERIES[_name] = _query
        if _sql:
            ORACLE_SQL[_name] = for_duckdb(_sql)
