"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, tuple[Query, str | None]]:
    """name to query and SQL (None: rows only)."""
    from tessera.plans import api, csv_queries, dataframe_queries, function_queries, relational, result_queries, sql_queries, stream_queries

    out: dict[str, tuple[Query, str | None]] = {}
    for part in (relational.QUERIES, function_queries.QUERIES, sql_queries.QUERIES, dataframe_queries.QUERIES, api.QUERIES, csv_queries.QUERIES, result_queries.QUERIES, stream_queries.QUERIES):
        if again := out.keys() & part.keys():
            raise ValueError(f"query names repeat: {again}")
        out |= part
    return out
