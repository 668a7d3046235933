"""Relations: lazy, immutable, composable queries over one DataFrame."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import sql_text
from tessera.errors import BinderException, InvalidInputException, translated
from tessera.expression import Default, Expression, Star, to_column
from tessera.operators import aggregates
from tessera.sources import writers
from tessera.types import split_top, sqltype, type_name

_JOINS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "semi": "left_semi", "anti": "left_anti"}
_counter = itertools.count()


class Relation:
    """A query; nothing runs before its rows are asked for."""

    def __init__(self, df: DataFrame, connection: Any, alias: str | None = None, kind: str = "QUERY_RELATION", table: str | None = None, sql: str = "") -> None:
        self._df, self.connection, self._kind, self._table, self._sql = df, connection, kind, table, sql
        self.alias = alias or f"unnamed_relation_{next(_counter)}"
        self._rows: Iterator | None = None

    @property
    def dataframe(self) -> DataFrame:
        return self._df

    def _derive(self, df: DataFrame, alias: str | None = None, kind: str = "QUERY_RELATION") -> Relation:
        return Relation(df, self.connection, alias or self.alias, kind)

    # --- names and types

    @property
    def columns(self) -> list[str]:
        return self._df.columns

    @property
    def types(self) -> list:
        return [f.dataType for f in self._df.schema.fields]

    dtypes = types

    @property
    def type(self) -> str:
        return self._kind

    @property
    def description(self) -> list[tuple]:
        return [(f.name, type_name(f.dataType), None, None, None, None, None) for f in self._df.schema.fields]

    def set_alias(self, alias: str) -> Relation:
        return self._derive(self._df.alias(alias), alias)

    def __contains__(self, name: str) -> bool:
        return name.lower() in (c.lower() for c in self.columns)

    def __len__(self) -> int:
        with translated():
            return self._df.count()

    @property
    def shape(self) -> tuple[int, int]:
        return len(self), len(self.columns)

    def __getitem__(self, name: str) -> Relation:
        if name in self:
            return self._derive(self._df.select(F.col(sql_text.quoted(name))))
        fields = self._df.schema.fields
        if len(fields) == 1 and hasattr(fields[0].dataType, "fieldNames") and name in fields[0].dataType.fieldNames():
            return self._derive(self._df.select(F.col(f"{sql_text.quoted(fields[0].name)}.{sql_text.quoted(name)}")))
        raise BinderException(f"no column {name}")

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except BinderException:
            raise AttributeError(name) from None

    # --- projection and filter

    def _columns(self, values: tuple | list) -> list[Column]:
        out: list[Column] = []
        for v in values:
            if isinstance(v, Star):
                out += v.columns(self.columns)
            elif isinstance(v, str):
                out += [F.col("*") if p == "*" else F.expr(p) for p in split_top(sql_text.expression(v))]
            else:
                out.append(to_column(v))
        return out

    def select(self, *exprs: Any, groups: str = "") -> Relation | None:
        if not exprs:
            return None
        with translated():
            if groups:
                return self.aggregate(list(exprs) if len(exprs) > 1 or not isinstance(exprs[0], str) else exprs[0], groups)
            if len(exprs) == 1 and isinstance(exprs[0], str):
                return self._derive(self._df.selectExpr(*split_top(sql_text.expression(exprs[0]))), kind="PROJECTION_RELATION")
            return self._derive(self._df.select(*self._columns([F.col(e) if isinstance(e, str) else e for e in exprs])), kind="PROJECTION_RELATION")

    project = select

    def _run(self, text: str, *others: DataFrame) -> DataFrame:
        """SQL text of the dialect over this relation's rows, which stand for {}."""
        return self._df.sparkSession.sql(_braced(sql_text.spark_sql(text.replace("{}", "__this"))).replace("__this", "{this}"), this=self._df)

    def select_types(self, types: list) -> Relation:
        wanted = [sqltype(t) for t in types]
        names = [f.name for f in self._df.schema.fields if f.dataType in wanted]
        if not names:
            raise InvalidInputException("no column has one of these types")
        return self._derive(self._df.select(*map(sql_text.quoted, names)))

    select_dtypes = select_types

    def filter(self, condition: str | Expression) -> Relation:
        with translated():
            own = F.expr(sql_text.expression(condition)) if isinstance(condition, str) else to_column(condition)
            return self._derive(self._df.filter(own), kind="FILTER_RELATION")

    # --- joins and sets

    def join(self, other: Relation, condition: Any, how: str = "inner") -> Relation:
        if not isinstance(other, Relation):
            raise InvalidInputException("a relation joins a relation")
        if self.alias == other.alias:
            raise BinderException("both relations have the same alias; set_alias tells them apart")
        way = _JOINS.get(how.lower().strip())
        if way is None:
            raise InvalidInputException(f"a join is one of {', '.join(_JOINS)}, not {how}")
        left, right = self._df.alias(self.alias), other._df.alias(other.alias)
        with translated():
            if isinstance(condition, list):
                on: Any = condition
            elif isinstance(condition, str):
                on = [condition.strip()] if re.fullmatch(r"\s*\w+\s*", condition) else F.expr(sql_text.expression(condition))
            else:
                on = to_column(condition)
            return self._derive(left.join(right, on, way), kind="JOIN_RELATION")

    def cross(self, other: Relation) -> Relation:
        return self._derive(self._df.alias(self.alias).crossJoin(other._df.alias(other.alias)), kind="CROSS_PRODUCT_RELATION")

    def union(self, other: Relation) -> Relation:
        return self._derive(self._df.union(other._df), kind="SET_OPERATION_RELATION")

    def except_(self, other: Relation) -> Relation:
        return self._derive(self._df.exceptAll(other._df), kind="SET_OPERATION_RELATION")

    def intersect(self, other: Relation) -> Relation:
        return self._derive(self._df.intersectAll(other._df), kind="SET_OPERATION_RELATION")

    def distinct(self) -> Relation:
        return self._derive(self._df.distinct(), kind="DISTINCT_RELATION")

    def unique(self, columns: str) -> Relation:
        return self.select(columns).distinct()

    # --- order

    def order(self, text: str) -> Relation:
        with translated():
            items = []
            for item in split_top(sql_text.order_items(text)):
                if found := re.match(r"#(\d+)\b", item):
                    item = sql_text.quoted(self.columns[int(found[1]) - 1]) + item[found.end() :]
                items.append(item)
            return self._derive(self._run(f"SELECT * FROM {{}} ORDER BY {', '.join(items)}"), kind="ORDER_RELATION")

    def sort(self, *exprs: Any) -> Relation:
        if not exprs:
            raise InvalidInputException("sort needs an expression")
        return self._derive(self._df.orderBy(*[e.sort_column if isinstance(e, Expression) else to_column(e).asc_nulls_last() for e in exprs]), kind="ORDER_RELATION")

    def limit(self, n: int, offset: int = 0) -> Relation:
        df = self._df.offset(offset) if offset else self._df
        return self._derive(df.limit(n), kind="LIMIT_RELATION")

    # --- aggregates and windows

    def aggregate(self, aggr_expr: str | list, group_expr: str = "") -> Relation:
        with translated():
            if isinstance(aggr_expr, str):
                return self._derive(self._run(f"SELECT {aggr_expr} FROM {{}} GROUP BY {group_expr or 'ALL'}"), kind="AGGREGATE_RELATION")
            columns = self._columns(aggr_expr)
            aggs = [c for c in columns if self._is_aggregate(c)]
            if found := re.fullmatch(r"(?is)\s*(cube|rollup)\s*\((.*)\)\s*", group_expr):
                grouped = getattr(self._df, found[1].lower())(*[F.expr(k) for k in split_top(sql_text.expression(found[2]))])
            else:
                keys = [F.expr(k) for k in split_top(sql_text.expression(group_expr))]
                grouped = self._df.groupBy(*(keys or [c for c in columns if not self._is_aggregate(c)]))
            out = grouped.agg(*(aggs or [F.count("*").alias("__n")]))
            return self._derive(out.select(*[sql_text.quoted(self._df.select(c).columns[0]) for c in columns]), kind="AGGREGATE_RELATION")

    def _is_aggregate(self, column: Column) -> bool:
        return self._df.select(column)._jdf.queryExecution().analyzed().nodeName() == "Aggregate"

    def apply(self, function_name: str, function_aggr: str, group_expr: str = "", function_parameter: str = "", projected_columns: str = "") -> Relation:
        own = aggregates.ALIASES.get(function_name, function_name)
        made = [(f"{function_name}({c})", aggregates.SIMPLE[own](c) if own in aggregates.SIMPLE and not function_parameter else f"{sql_text.FUNCTIONS.get(own, own)}({c}{', ' + function_parameter if function_parameter else ''})") for c in split_top(function_aggr)]
        return self._aggregate_text(made, group_expr, "", projected_columns)

    def _aggregate_text(self, made: list[tuple[str, str]], groups: str, window: str, projected: str) -> Relation:
        """Select aggregates, by name and Spark SQL text, of groups or over a window."""
        if groups and window:
            raise InvalidInputException("groups and window_spec exclude each other")
        with translated():
            items = [p for p in split_top(projected)]
            over = " " + sql_text.expression(window) if window else ""
            items += [f"{text.replace(aggregates.OVER, over) if aggregates.OVER in text else text + over} AS {sql_text.quoted(name)}" for name, text in made]
            text = f"SELECT {', '.join(items)} FROM __this"
            if groups:
                text += f" GROUP BY {sql_text.expression(groups)}"
            return self._derive(self._df.sparkSession.sql(_braced(text).replace("__this", "{this}"), this=self._df), kind="PROJECTION_RELATION" if window else "AGGREGATE_RELATION")

    def arg_max(self, arg_column: str, value_column: str, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        return self._aggregate_text([(f"arg_max({arg_column}, {value_column})", f"max_by({arg_column}, {value_column})")], groups, window_spec, projected_columns)

    def arg_min(self, arg_column: str, value_column: str, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        return self._aggregate_text([(f"arg_min({arg_column}, {value_column})", f"min_by({arg_column}, {value_column})")], groups, window_spec, projected_columns)

    def product(self, expression: str, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        name, keys = f"product({expression})", split_top(sql_text.expression(groups))
        if window_spec or any(p not in split_top(groups) for p in split_top(projected_columns)):
            return self._aggregate_text([(name, aggregates.product(expression))], groups, window_spec, projected_columns)
        with translated():
            out = self._df.groupBy(*[F.expr(k) for k in keys]).agg(F.product(F.expr(expression).cast("double")).alias(name))
            return self._derive(out.select(*split_top(projected_columns), sql_text.quoted(name)), kind="AGGREGATE_RELATION")

    def bitstring_agg(self, expression: str, min: int | None = None, max: int | None = None, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:  # noqa: A002
        if (min is None) != (max is None):
            raise InvalidInputException("bitstring_agg needs both min and max, or neither")
        if min is None:
            if window_spec:
                raise BinderException("bitstring_agg over a window needs min and max")
            min, max = self._df.agg(F.min(F.expr(expression)), F.max(F.expr(expression))).first()  # noqa: A001
        return self._aggregate_text([(f"bitstring_agg({expression})", aggregates.bitstring(expression, min, max))], groups, window_spec, projected_columns)

    def histogram(self, expression: str, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        name = f"histogram({expression})"
        if window_spec or any(p not in split_top(groups) for p in split_top(projected_columns)):
            return self._aggregate_text([(name, aggregates.histogram(expression))], groups, window_spec, projected_columns)
        keys = split_top(sql_text.expression(groups))
        value = F.expr(expression)
        counts = self._df.filter(value.isNotNull()).groupBy(*[F.expr(k) for k in keys], value.alias("__value")).agg(F.count("*").alias("__n"))
        made = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("__value").alias("key"), F.col("__n").alias("value")))))
        out = counts.groupBy(*keys).agg(made.alias(name)) if keys else counts.agg(made.alias(name))
        return self._derive(out.select(*split_top(projected_columns), sql_text.quoted(name)), kind="AGGREGATE_RELATION")

    def string_agg(self, expression: str, sep: str = ",", groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        return self._aggregate_text([(f"string_agg({expression}, '{sep}')", aggregates.string_agg(expression, sep))], groups, window_spec, projected_columns)

    def quantile_cont(self, expression: str, q: float | list = 0.5, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        return self._aggregate_text([(f"quantile_cont({expression}, {q})", aggregates.quantile_cont(expression, q))], groups, window_spec, projected_columns)

    def quantile_disc(self, expression: str, q: float | list = 0.5, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        kind = self._df.select(F.expr(expression)).schema.fields[0].dataType.simpleString()
        return self._aggregate_text([(f"quantile_disc({expression}, {q})", aggregates.quantile_disc(expression, q, kind))], groups, window_spec, projected_columns)

    quantile = quantile_disc

    def value_counts(self, expression: str, groups: str = "") -> Relation:
        return self._aggregate_text([(f"count({expression})", f"count({expression})")], ", ".join(filter(None, [groups, expression])), "", expression)

    def describe(self) -> Relation:
        """count, mean, stddev, min, max and median of each column, as rows."""
        stats = ("count", "mean", "stddev", "min", "max", "median")
        numeric = {f.name for f in self._df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")}

        def stat(s: str, c: str) -> Column:
            own = F.col(sql_text.quoted(c))
            if s == "count":
                return F.count(own).cast("double" if c in numeric else "string")
            if c not in numeric:
                return getattr(F, s)(own.cast("string")) if s in ("min", "max") else F.lit(None).cast("string")
            return {"mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max, "median": F.median}[s](own).cast("double")

        wide = self._df.agg(*[F.struct(*[stat(s, c).alias(c) for c in self.columns]).alias(s) for s in stats])
        rows = F.array(*[F.struct(F.lit(s).alias("aggr"), *[F.col(f"{s}.{sql_text.quoted(c)}").alias(c) for c in self.columns]) for s in stats])
        return self._derive(wide.select(F.inline(rows)))

    def _window(self, name: str, text: str, window: str, projected: str) -> Relation:
        return self._aggregate_text([(name, text)], "", window, projected)

    def row_number(self, window_spec: str, projected_columns: str = "") -> Relation:
        spec = window_spec if re.search(r"(?i)order\s+by", window_spec) else re.sub(r"\)\s*$", " order by monotonically_increasing_id())", window_spec)
        return self._window("row_number()", "row_number()", spec, projected_columns)

    def rank(self, window_spec: str, projected_columns: str = "") -> Relation:
        return self._window("rank()", "rank()", window_spec, projected_columns)

    def dense_rank(self, window_spec: str, projected_columns: str = "") -> Relation:
        return self._window("dense_rank()", "dense_rank()", window_spec, projected_columns)

    rank_dense = dense_rank

    def percent_rank(self, window_spec: str, projected_columns: str = "") -> Relation:
        return self._window("percent_rank()", "percent_rank()", window_spec, projected_columns)

    def cume_dist(self, window_spec: str, projected_columns: str = "") -> Relation:
        return self._window("cume_dist()", "cume_dist()", window_spec, projected_columns)

    def n_tile(self, window_spec: str, num_buckets: int, projected_columns: str = "") -> Relation:
        return self._window(f"ntile({num_buckets})", f"ntile({num_buckets})", window_spec, projected_columns)

    def first_value(self, expression: str, window_spec: str = "", projected_columns: str = "") -> Relation:
        return self._window(f"first_value({expression})", f"first_value({expression})", window_spec, projected_columns)

    def last_value(self, expression: str, window_spec: str = "", projected_columns: str = "") -> Relation:
        return self._window(f"last_value({expression})", f"last_value({expression})", window_spec, projected_columns)

    def nth_value(self, expression: str, window_spec: str, offset: int, ignore_nulls: bool = False, projected_columns: str = "") -> Relation:
        return self._window(f"nth_value({expression}, {offset})", f"nth_value({expression}, {offset}){' ignore nulls' * ignore_nulls}", window_spec, projected_columns)

    def lag(self, expression: str, window_spec: str, offset: int = 1, default_value: str = "NULL", ignore_nulls: bool = False, projected_columns: str = "") -> Relation:
        return self._window(f"lag({expression}, {offset}, {default_value})", f"lag({expression}, {offset}, {default_value}){' ignore nulls' * ignore_nulls}", window_spec, projected_columns)

    def lead(self, expression: str, window_spec: str, offset: int = 1, default_value: str = "NULL", ignore_nulls: bool = False, projected_columns: str = "") -> Relation:
        return self._window(f"lead({expression}, {offset}, {default_value})", f"lead({expression}, {offset}, {default_value}){' ignore nulls' * ignore_nulls}", window_spec, projected_columns)

    # --- sinks

    def to_parquet(self, file_name: str, **options: Any) -> None:
        with translated():
            writers.write_parquet(self._df, file_name, **options)

    write_parquet = to_parquet

    def to_csv(self, file_name: str, **options: Any) -> None:
        with translated():
            writers.write_csv(self._df, file_name, **options)

    write_csv = to_csv

    def create(self, table_name: str) -> None:
        with translated():
            self._df.write.saveAsTable(table_name)

    to_table = create

    def create_view(self, view_name: str, replace: bool = True) -> Relation:
        with translated():
            (self._df.createOrReplaceTempView if replace else self._df.createTempView)(view_name)
        return self.connection.view(view_name)

    to_view = create_view

    def insert_into(self, table_name: str) -> None:
        with translated():
            self._df.write.insertInto(table_name)

    def insert(self, values: list | tuple) -> None:
        if not self._table:
            raise InvalidInputException("rows are inserted into a table's relation")
        with translated():
            spark = self._df.sparkSession
            row = spark.range(1).select(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, self._df.schema.fields, strict=True)])
            row.write.insertInto(self._table)

    def update(self, set: dict, *, condition: Expression | None = None) -> None:  # noqa: A002
        if not self._table:
            raise InvalidInputException("rows are updated in a table's relation")
        if not set or not all(isinstance(k, str) for k in set) or not all(isinstance(v, (Expression, Default)) for v in set.values()):
            raise InvalidInputException("update takes a dictionary of column names to expressions")
        with translated():
            self.connection.rewrite_table(self._table, lambda df: df.select(*[self._updated(f.name, set, condition) for f in df.schema.fields]))

    @staticmethod
    def _updated(name: str, values: dict, condition: Expression | None) -> Column:
        own = F.col(sql_text.quoted(name))
        new = next((v for k, v in values.items() if k.lower() == name.lower()), None)
        if new is None:
            return own
        value = F.lit(None) if isinstance(new, Default) else new.bare
        return (value if condition is None else F.when(condition.bare, value).otherwise(own)).alias(name)

    def query(self, virtual_table_name: str, sql_query: str) -> Relation | None:
        if len(sql_text.statements(sql_query)) != 1:
            raise InvalidInputException("query takes one statement")
        self._df.createOrReplaceTempView(virtual_table_name)
        return self.connection.sql(sql_query)

    def map(self, map_function: Callable, *, schema: Any = None) -> Relation:
        """Rows through a function from pandas frame to pandas frame, a batch at a time."""
        import pandas as pd

        df = self._df
        if schema is None:
            trial = map_function(df.limit(0).toPandas())
            if not isinstance(trial, pd.DataFrame):
                raise InvalidInputException("the function must return a pandas frame")
            made = df.sparkSession.createDataFrame(trial.astype(object).where(trial.notna(), None), None) if len(trial) else None
            fields = [f"`{c}` {_pandas_type(k)}" for c, k in trial.dtypes.items()] if made is None else [f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema]
            kinds = ", ".join(fields)
        else:
            kinds = ", ".join(f"`{n}` {sqltype(t).simpleString()}" for n, t in schema.items())
        names = [p.split("`")[1] for p in split_top(kinds)]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = map_function(batch)
                if not isinstance(out, pd.DataFrame):
                    raise ValueError("the function must return a pandas frame")
                if list(out.columns) != names:
                    raise ValueError(f"the function returned the columns {list(out.columns)}, not {names}")
                yield out

        return self._derive(df.mapInPandas(run, kinds))

    # --- rows

    def execute(self) -> Relation:
        with translated():
            own = self._df.persist()
            own.count()
        self._df, self._rows = own, None
        return self

    def close(self) -> None:
        self._df.unpersist()
        self._rows = None

    def _cursor(self) -> Iterator:
        if self._rows is None:
            self._rows = self._df.toLocalIterator(prefetchPartitions=True)
        return self._rows

    def fetchone(self) -> tuple | None:
        with translated():
            row = next(self._cursor(), None)
        return None if row is None else tuple(row)

    def fetchmany(self, size: int = 1) -> list[tuple]:
        with translated():
            return [tuple(r) for r in itertools.islice(self._cursor(), size)]

    def fetchall(self) -> list[tuple]:
        with translated():
            return [tuple(r) for r in (self._df.collect() if self._rows is None else self._rows)]

    def to_arrow_table(self, batch_size: int = 1_000_000) -> Any:
        with translated():
            return self._df.toArrow()

    fetch_arrow_table = to_arrow_table

    def to_arrow_reader(self, batch_size: int = 1_000_000) -> Any:
        """Record batches as they are read: a partition's rows are with the driver at a time, never all of them."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        df = self._df
        schema = to_arrow_schema(df.schema)

        def packed(own: Iterator) -> Iterator:
            """Each Arrow batch as one value of bytes. (Not of the module, so that workers needn't have it.)"""
            import pyarrow as pa

            for batch in own:
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, batch.schema) as writer:
                    writer.write_batch(batch)
                yield pa.record_batch([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["batch"])

        def batches() -> Iterator[Any]:
            for row in df.mapInArrow(packed, "batch binary").toLocalIterator(prefetchPartitions=True):
                for batch in pa.ipc.open_stream(row.batch):
                    for a in range(0, batch.num_rows, batch_size):
                        part = batch.slice(a, batch_size)
                        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns, schema)], schema=schema)

        with translated():
            return pa.RecordBatchReader.from_batches(schema, batches())

    arrow = fetch_record_batch = fetch_arrow_reader = to_arrow_reader

    def __arrow_c_stream__(self, requested_schema: Any = None) -> Any:
        return self.to_arrow_reader().__arrow_c_stream__(requested_schema)

    def df(self, *, date_as_object: bool = False) -> Any:
        with translated():
            out = self._df.toPandas()
        if not date_as_object:
            import pandas as pd

            for f in self._df.schema.fields:
                if f.dataType.typeName() == "date":
                    out[f.name] = pd.to_datetime(out[f.name])
        return out

    fetchdf = to_df = df

    def fetch_df_chunk(self, vectors_per_chunk: int = 1, *, date_as_object: bool = False) -> Any:
        import pandas as pd

        return pd.DataFrame(self.fetchmany(2048 * vectors_per_chunk), columns=self.columns)

    def fetchnumpy(self) -> dict:
        import numpy as np

        table = self.to_arrow_table()
        out = {}
        for name, column in zip(self.columns, table.columns):
            values = column.to_numpy()
            gone = np.array(column.is_null().to_pylist(), bool)
            out[name] = np.ma.masked_array(values, gone) if gone.any() else values
        return out

    def pl(self, batch_size: int = 1_000_000, *, lazy: bool = False) -> Any:
        import polars

        out = polars.from_arrow(self.to_arrow_table())
        return out.lazy() if lazy else out

    def torch(self) -> dict:
        import torch

        return {k: torch.from_numpy(v) for k, v in self.fetchnumpy().items()}

    def tf(self) -> dict:
        import tensorflow

        return {k: tensorflow.convert_to_tensor(v) for k, v in self.fetchnumpy().items()}

    def show(self, *, max_width: int | None = None, max_rows: int | None = None, max_col_width: int | None = None, null_value: str | None = None, render_mode: Any = None) -> None:
        self._df.show(max_rows or 20, max_col_width or 20)

    def explain(self, type: str = "standard", format: str | None = None) -> str:  # noqa: A002
        mode = {"standard": "formatted", "analyze": "cost"}.get(type, type)
        jvm = self._df.sparkSession._jvm
        return jvm.PythonSQLUtils.explainString(self._df._jdf.queryExecution(), mode)

    def sql_query(self) -> str:
        return self._sql


def _braced(text: str) -> str:
    """Text whose braces stand for themselves where frames are filled in."""
    return text.replace("{", "{{").replace("}", "}}")


def _pandas_type(kind: Any) -> str:
    name = str(kind)
    return {"int64": "bigint", "int32": "int", "int16": "smallint", "int8": "tinyint", "float64": "double", "float32": "float", "bool": "boolean"}.get(name, "timestamp_ntz" if name.startswith("datetime64") else "string")


def _simple(name: str) -> Callable:
    own = aggregates.ALIASES.get(name, name)

    def method(self: Relation, expression: str, groups: str = "", window_spec: str = "", projected_columns: str = "") -> Relation:
        return self._aggregate_text([(f"{name}({c})", aggregates.SIMPLE[own](c)) for c in split_top(expression)], groups, window_spec, projected_columns)

    method.__name__, method.__doc__ = name, f"{own} of each column."
    return method


for _name in [*aggregates.SIMPLE, *(a for a, b in aggregates.ALIASES.items() if b in aggregates.SIMPLE)]:
    if _name not in vars(Relation) and _name != "corr":
        setattr(Relation, _name, _simple(_name))
