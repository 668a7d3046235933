"""A Spark-native analytics engine: lazy relations, expressions, SQL, sources and sinks over DataFrames.

Every method of a connection is a function of this module too, on the default connection or on connection=.
"""

from __future__ import annotations

from typing import Any

from tessera.connection import Connection, Statement, apilevel, connect, default_connection, paramstyle, set_default_connection, threadsafety
from tessera.errors import *  # noqa: F403
from tessera.expression import CaseExpression, CoalesceOperator, ColumnExpression, ConstantExpression, DefaultExpression, Expression, FunctionExpression, LambdaExpression, SQLExpression, StarExpression
from tessera.relation import Relation
from tessera.sql_text import tokenize
from tessera.types import array_type, decimal_type, dtype, enum_type, list_type, map_type, row_type, sqltype, string_type, struct_type, union_type

#: Methods of relations that take a frame first when called as functions.
_FRAME_FIRST = ("project", "filter", "aggregate", "distinct", "limit", "order", "write_csv")


def __getattr__(name: str) -> Any:
    if name in _FRAME_FIRST:
        return lambda df, *args, connection=None, **options: getattr((connection or default_connection()).from_df(df), name)(*args, **options)
    if name == "query_df":
        return lambda df, view, sql, connection=None: (connection or default_connection()).from_df(df).query(view, sql)
    if not name.startswith("_") and (hasattr(Connection, name) or name.startswith("fetch")):
        return lambda *args, connection=None, **options: getattr(connection or default_connection(), name)(*args, **options)
    raise AttributeError(f"module 'tessera' has no attribute {name}")
