"""Connections: SQL with parameters, sources, registered objects, table changes, functions; a DB-API cursor too."""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sql_text
from tessera.errors import CatalogException, ConnectionException, InvalidInputException, NotImplementedException, TransactionException, translated
from tessera.expression import Expression
from tessera.relation import Relation
from tessera.session import session
from tessera.sources import csv, files, readers
from tessera.types import split_top, sqltype
from tessera.udf import Functions

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"
_SETTINGS = {"pandas_analyze_sample": 1000, "python_enable_replacements": True, "python_scan_all_frames": False}
#: Settings that are kept but change nothing here: Spark's own configuration rules threads and memory.
_KEPT = {"threads", "worker_threads", "memory_limit", "max_memory", "temp_directory", "timezone", "enable_progress_bar", "preserve_insertion_order", "profiling", "enable_profiling", "default_null_order", "default_order"}


class Statement:
    """One parsed statement of a script."""

    def __init__(self, query: str) -> None:
        self.query = query

    @property
    def named_parameters(self) -> list[str]:
        return sql_text.named_parameters(self.query)

    @property
    def type(self) -> str:
        return sql_text.kind(self.query)

    @property
    def expected_result_type(self) -> list[str]:
        return {"SELECT": ["QUERY_RESULT"], "EXPLAIN": ["QUERY_RESULT"], "DESCRIBE": ["QUERY_RESULT"], "SHOW": ["QUERY_RESULT"], "INSERT": ["CHANGED_ROWS", "QUERY_RESULT"], "UPDATE": ["CHANGED_ROWS"], "DELETE": ["CHANGED_ROWS"], "COPY": ["CHANGED_ROWS"]}.get(self.type, ["NOTHING"])


class Connection:
    """A session with a last result."""

    def __init__(self, spark: SparkSession | None = None, config: dict | None = None) -> None:
        self.spark = spark or session()
        self.settings = dict(_SETTINGS)
        for k, v in (config or {}).items():
            if k in self.settings:
                self.settings[k] = v
            else:
                self.spark.conf.set(k, v)
        self.functions = Functions(self.spark)
        self._result: Relation | None = None
        self._closed = False
        self._prepared: dict[str, str] = {}

    # --- life

    def cursor(self) -> Connection:
        self._open()
        return Connection(self.spark.newSession())

    duplicate = cursor

    def close(self) -> None:
        self._result, self._closed = None, True

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, *exc: Any) -> None:
        self.close()

    def _open(self) -> None:
        if self._closed:
            raise ConnectionException("the connection is closed")

    def begin(self) -> Connection:
        return self

    def commit(self) -> Connection:
        return self

    def rollback(self) -> Connection:
        raise TransactionException("Spark tables have no transactions; nothing can be rolled back")

    def checkpoint(self) -> Connection:
        return self

    def interrupt(self) -> None:
        self.spark.interruptAll()

    def query_progress(self) -> float:
        """Share of the tasks of active stages that have ended; -1 if nothing runs."""
        tracker = self.spark.sparkContext.statusTracker()
        stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
        total = sum(s.numTasks for s in stages)
        return sum(s.numCompletedTasks for s in stages) / total if total else -1.0

    def install_extension(self, extension: str, **options: Any) -> None:
        raise NotImplementedException("packages are given to Spark by spark.jars.packages when it starts")

    load_extension = install_extension

    def register_filesystem(self, filesystem: Any) -> None:
        files.register_filesystem(filesystem)

    def unregister_filesystem(self, name: str) -> None:
        files.unregister_filesystem(name)

    def list_filesystems(self) -> list[str]:
        return files.list_filesystems()

    def filesystem_is_registered(self, name: str) -> bool:
        return files.filesystem_is_registered(name)

    def get_profiling_information(self, format: str = "json") -> str:  # noqa: A002
        return self._result.explain("formatted") if self._result else ""

    def enable_profiling(self) -> None:
        self.settings["profiling"] = True

    def disable_profiling(self) -> None:
        self.settings["profiling"] = False

    # --- sources

    def _relation(self, df: DataFrame, alias: str | None = None, **more: Any) -> Relation:
        self._open()
        return Relation(df, self, alias or None, **more)

    def read_csv(self, path_or_buffer: Any, **options: Any) -> Relation:
        with translated():
            return self._relation(csv.read_csv(self.spark, path_or_buffer, **options), kind="READ_CSV_RELATION")

    from_csv_auto = read_csv

    def read_json(self, path_or_buffer: Any, **options: Any) -> Relation:
        with translated():
            return self._relation(readers.read_json(self.spark, path_or_buffer, **options))

    def read_parquet(self, path_or_buffer: Any, binary_as_string: bool = False, **options: Any) -> Relation:
        with translated():
            return self._relation(readers.read_parquet(self.spark, path_or_buffer, binary_as_string, **options))

    from_parquet = read_parquet

    def table(self, name: str) -> Relation:
        with translated():
            if self.spark.catalog.tableExists(name):
                return self._relation(self.spark.table(name), name, kind="TABLE_RELATION", table=name)
            return self.sql(f"SELECT * FROM {name}", alias=name)

    def view(self, name: str) -> Relation:
        with translated():
            return self._relation(self.spark.table(name), name, kind="VIEW_RELATION")

    def values(self, *args: Any) -> Relation:
        """Rows of tuples or a list of values; a row of expressions; a row of single values."""
        if not args:
            raise InvalidInputException("values needs a value")
        if len(args) == 1 and isinstance(args[0], list):
            rows = [tuple(args[0])]
        elif all(isinstance(a, tuple) for a in args):
            rows = list(args)
        else:
            rows = [tuple(args)]
        if len({len(r) for r in rows}) > 1:
            raise InvalidInputException("all rows must have as many values")
        one = self.spark.range(1)
        parts = [one.select(*[(v.bare if isinstance(v, Expression) else F.lit(v)).alias(f"col{i}") for i, v in enumerate(r)]) for r in rows]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return self._relation(out, kind="VALUE_LIST_RELATION")

    def table_function(self, name: str, parameters: list | None = None) -> Relation:
        args = parameters or []
        own = {"read_csv": self.read_csv, "read_csv_auto": self.read_csv, "read_json": self.read_json, "read_json_auto": self.read_json, "read_parquet": self.read_parquet, "parquet_scan": self.read_parquet}
        if name in own:
            return own[name](*args)
        if name in ("range", "generate_series"):
            start, stop, step = (0, args[0], 1) if len(args) == 1 else (*args, 1)[:3]
            return self._relation(self.spark.range(start, stop + (step if name != "range" else 0), step).toDF(name))
        if name in ("repeat", "repeat_row"):
            *row, n = args
            return self._relation(self.spark.range(n).select(*[F.lit(v).alias(f"column{i}") for i, v in enumerate(row)]))
        if name == "parquet_schema":
            return self._relation(readers.parquet_schema(self.spark, args[0]))
        raise CatalogException(f"no table function {name}")

    def from_df(self, df: Any) -> Relation:
        return self._relation(readers.from_object(self.spark, df, self.settings["pandas_analyze_sample"]))

    from_arrow = from_df

    def register(self, view_name: str, python_object: Any) -> Connection:
        readers.from_object(self.spark, python_object, self.settings["pandas_analyze_sample"]).createOrReplaceTempView(view_name)
        return self

    def unregister(self, view_name: str) -> Connection:
        self.spark.catalog.dropTempView(view_name)
        return self

    def append(self, table_name: str, df: Any, *, by_name: bool = False) -> Connection:
        with translated():
            own = readers.from_object(self.spark, df, self.settings["pandas_analyze_sample"])
            wanted = self.spark.table(table_name).schema
            if by_name:
                names = {c.lower(): c for c in own.columns}
                own = own.select(*[(F.col(f"`{names[f.name.lower()]}`") if f.name.lower() in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
            own.write.insertInto(table_name)
        return self

    # --- SQL

    def extract_statements(self, query: str) -> list[Statement]:
        return [Statement(s) for s in sql_text.statements(query)]

    def get_table_names(self, query: str, *, qualified: bool = False) -> set[str]:
        """Names of the tables that a query reads."""
        with translated():
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql_text.spark_sql(query))
        names = set(re.findall(r"UnresolvedRelation \[([^\]]+)\]", plan.toString()))
        ctes = {m.lower() for m in re.findall(r"(?i)(?:\bwith(?:\s+recursive)?|,)\s+(\w+)\s*(?:\([^)]*\))?\s+as\s*\(", query)}
        parts = {tuple(p.strip() for p in n.split(",")) for n in names}
        return {".".join(p) if qualified else p[-1] for p in parts if p[-1].lower() not in ctes}

    def sql(self, query: str | Statement, *, alias: str = "", params: Any = None) -> Relation | None:
        """The last statement's relation (lazy if it is a SELECT); None if that gives no rows. Statements before it run."""
        self._open()
        scripts = sql_text.statements(query.query if isinstance(query, Statement) else query)
        if not scripts:
            return None
        frames = _frames(sys._getframe(1)) if self.settings["python_enable_replacements"] else []
        for s in scripts[:-1]:
            self._run(s, None, frames)
        df = self._run(scripts[-1], params, frames)
        return None if df is None else self._relation(df, alias, sql=scripts[-1])

    query = from_query = sql

    def execute(self, query: str | Statement, parameters: Any = None) -> Connection:
        self._open()
        frames = _frames(sys._getframe(1)) if self.settings["python_enable_replacements"] else []
        scripts = sql_text.statements(query.query if isinstance(query, Statement) else query)
        for i, s in enumerate(scripts):
            df = self._run(s, parameters if i == len(scripts) - 1 else None, frames)
            self._result = None if df is None else self._relation(df)
        return self

    def executemany(self, query: str, parameters: Any = None) -> Connection:
        if not parameters:
            raise InvalidInputException("executemany needs sets of parameters")
        found = re.fullmatch(r"(?is)\s*insert\s+into\s+([\w.]+)\s+values\s*\(\s*\?(?:\s*,\s*\?)*\s*\)\s*;?\s*", query)
        if found:  # all rows at once
            schema = self.spark.table(found[1]).schema
            rows = self.spark.createDataFrame([tuple(p) for p in parameters], [f.name for f in schema]) if not any(v is None for p in parameters for v in p) else self.spark.createDataFrame([tuple(p) for p in parameters], schema)
            rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema]).write.insertInto(found[1])
            return self
        for p in parameters:
            self.execute(query, p)
        return self

    def _run(self, statement: str, parameters: Any, frames: list) -> DataFrame | None:
        kind = sql_text.kind(statement)
        handler = getattr(self, f"_run_{kind.lower()}", None)
        with translated():
            if handler and (done := handler(statement, parameters, frames)) is not NotImplemented:
                return done
            return self._spark_sql(statement, parameters, frames, kind)

    def _spark_sql(self, statement: str, parameters: Any, frames: list, kind: str = "SELECT") -> DataFrame | None:
        if named := sql_text.by_name(statement):
            parts, keeps = named
            out = self._spark_sql(parts[0], parameters, frames)
            for part, keep in zip(parts[1:], keeps):
                out = out.unionByName(self._spark_sql(part, parameters, frames), allowMissingColumns=True)
                out = out if keep else out.distinct()
            return out
        text, args = sql_text.bind(statement, parameters)
        text = re.sub(r"(?i)\bcurrent_setting\s*\(\s*'(\w+)'\s*\)", self._setting, text)
        text = sql_text.spark_sql(text)
        self._replace(text, frames)
        df = self.spark.sql(text, args=args) if args else self.spark.sql(text)
        return df if kind in ("SELECT", "DESCRIBE", "SHOW", "EXPLAIN", "CALL") or df.columns else None

    def _setting(self, found: re.Match) -> str:
        """The value of current_setting('name'), as a literal."""
        name = found[1].lower()
        if name not in self.settings:
            raise CatalogException(f"there is no setting {name}")
        value = self.settings[name]
        return str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"

    def _replace(self, text: str, frames: list) -> None:
        """Make temporary views of the Python objects that a query names."""
        if not frames:
            return
        try:
            names = self.get_table_names(text)
        except Exception:
            return
        for name in names:
            if self.spark.catalog.tableExists(name) and name not in getattr(self, "_replaced", set()):
                continue
            for frame in frames:
                value = frame.get(name)
                if value is not None and readers.is_table_like(value):
                    readers.from_object(self.spark, value, self.settings["pandas_analyze_sample"]).createOrReplaceTempView(name)
                    self._replaced = getattr(self, "_replaced", set()) | {name}
                    break
                if not self.settings["python_scan_all_frames"] and frame is frames[min(1, len(frames) - 1)]:
                    break

    def _run_transaction(self, statement: str, parameters: Any, frames: list) -> None:
        if statement.lower().startswith("rollback"):
            self.rollback()

    def _run_pragma(self, statement: str, parameters: Any, frames: list) -> DataFrame | None:
        found = re.fullmatch(r"(?is)pragma\s+(\w+)(?:\s*=\s*(.+))?", statement)
        if found and found[2] is not None:
            self.settings[found[1].lower()] = found[2].strip("'\" ")
        return None

    def _run_set(self, statement: str, parameters: Any, frames: list) -> Any:
        found = re.fullmatch(r"(?is)set\s+(?:global\s+|session\s+)?([\w.]+)\s*(?:=|to)\s*(.+)", statement)
        if not found:
            return NotImplemented
        name, value = found[1].lower(), found[2].strip("'\" ;")
        if "." in name:
            self.spark.conf.set(found[1], value)
        else:
            kinds = {"true": True, "false": False}
            if name not in _SETTINGS and name not in _KEPT:
                raise CatalogException(f"there is no setting {name}")
            self.settings[name] = kinds.get(value.lower(), int(value) if value.isdigit() else value)
            if name == "timezone":
                self.spark.conf.set("spark.sql.session.timeZone", value)
        return None

    def _run_prepare(self, statement: str, parameters: Any, frames: list) -> None:
        found = re.fullmatch(r"(?is)prepare\s+(\w+)\s+as\s+(.+)", statement)
        self._prepared[found[1].lower()] = found[2]

    def _run_execute(self, statement: str, parameters: Any, frames: list) -> Any:
        found = re.fullmatch(r"(?is)execute\s+(\w+)\s*(?:\((.*)\))?", statement)
        if not found or found[1].lower() not in self._prepared:
            raise CatalogException("no such prepared statement")
        args = [self.spark.sql(f"SELECT {sql_text.expression(a)}").first()[0] for a in split_top(found[2] or "")]
        return self._run(self._prepared[found[1].lower()], args or None, frames)

    def _run_create(self, statement: str, parameters: Any, frames: list) -> Any:
        """CREATE TABLE in the dialect's types."""
        found = re.fullmatch(r"(?is)create\s+(or\s+replace\s+)?(temp(?:orary)?\s+)?table\s+(if\s+not\s+exists\s+)?([\w.\"`]+)\s*(.*)", statement)
        if not found:
            found = re.fullmatch(r"(?is)create\s+schema\s+(if\s+not\s+exists\s+)?(\w+)", statement)
            if found:
                self.spark.sql(f"CREATE DATABASE {found[1] or ''} {found[2]}")
                return None
            return NotImplemented
        replace, _, if_absent, name, rest = found.groups()
        if replace:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        elif if_absent and self.spark.catalog.tableExists(name):
            return None
        if query := re.match(r"(?is)as\s+(.*)", rest):
            self._spark_sql(query[1], parameters, frames).write.format("parquet").saveAsTable(name.strip('"`'))
            return None
        fields = []
        for item in split_top(rest.strip()[1:-1]):
            if re.match(r"(?i)(primary|unique|check|foreign|constraint)\b", item):
                continue
            column, kind = re.fullmatch(r'(?s)("[^"]+"|\w+)\s+(.+?)(?:\s+(?:not\s+null|null|primary\s+key|unique|default\s+.+))*', item, re.I).groups()
            fields.append(f"`{column.strip(chr(34))}` {sqltype(kind).simpleString()}")
        self.spark.sql(f"CREATE TABLE {name} ({', '.join(fields)}) USING parquet")
        return None

    def _run_insert(self, statement: str, parameters: Any, frames: list) -> Any:
        found = re.fullmatch(r"(?is)(insert\s+into\s+([\w.]+)\s*(\([^)]*\))?\s*)(.*?)\s+returning\s+(.+)", statement)
        if not found:
            return NotImplemented
        table, names = found[2], split_top((found[3] or "")[1:-1])
        own = self._spark_sql(found[4], parameters, frames)
        schema = self.spark.table(table).schema
        names = names or [f.name for f in schema][: len(own.columns)]
        given = dict(zip(map(str.lower, names), own.columns))
        rows = own.select(*[(F.col(f"`{given[f.name.lower()]}`") if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).persist()
        rows.write.insertInto(table)
        return rows.selectExpr(*[sql_text.expression(x) for x in split_top(found[5])])

    def _run_update(self, statement: str, parameters: Any, frames: list) -> DataFrame | None:
        text, args = sql_text.bind(statement, parameters)
        found = re.fullmatch(r"(?is)update\s+([\w.]+)\s+set\s+(.+?)(?:\s+where\s+(.+))?", text)
        changes = {}
        for item in split_top(found[2]):
            name, value = item.split("=", 1)
            changes[name.strip().strip('"').lower()] = sql_text.expression(value.strip())
        where = sql_text.expression(found[3]) if found[3] else "true"

        def change(df: DataFrame) -> DataFrame:
            items = [f"CASE WHEN {where} THEN {changes[f.name.lower()]} ELSE `{f.name}` END AS `{f.name}`" if f.name.lower() in changes else f"`{f.name}`" for f in df.schema.fields]
            return self.spark.sql(f"SELECT {', '.join(items)} FROM {{this}}", args=args or None, this=df)

        self.rewrite_table(found[1], change)
        return None

    def _run_delete(self, statement: str, parameters: Any, frames: list) -> DataFrame | None:
        text, args = sql_text.bind(statement, parameters)
        found = re.fullmatch(r"(?is)delete\s+from\s+([\w.]+)(?:\s+where\s+(.+))?", text)
        where = sql_text.expression(found[2]) if found[2] else "true"
        self.rewrite_table(found[1], lambda df: self.spark.sql(f"SELECT * FROM {{this}} WHERE NOT coalesce({where}, false)", args=args or None, this=df))
        return None

    def rewrite_table(self, name: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Write a table's changed rows beside it and put them in its place."""
        old = self.spark.table(name)
        schema = old.schema
        own = change(old).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema])
        beside = f"{name}_{uuid.uuid4().hex[:12]}"
        own.write.format("parquet").saveAsTable(beside)
        away = f"{beside}_old"
        self.spark.sql(f"ALTER TABLE {name} RENAME TO {away}")
        try:
            self.spark.sql(f"ALTER TABLE {beside} RENAME TO {name}")
        except Exception:
            self.spark.sql(f"ALTER TABLE {away} RENAME TO {name}")
            raise
        self.spark.sql(f"DROP TABLE {away}")
        self.spark.catalog.refreshTable(name)

    def _run_copy(self, statement: str, parameters: Any, frames: list) -> Any:
        found = re.fullmatch(r"(?is)copy\s+(\(.+\)|[\w.]+)\s+(to|from)\s+'([^']+)'\s*(?:with\s*)?(?:\((.*)\))?", statement)
        if not found:
            return NotImplemented
        what, way, path, text = found.groups()
        options = {k.lower(): (v or "true").strip("'\" ") for k, v in (re.fullmatch(r"(?s)(\w+)\s*(.*)", o).groups() for o in split_top(text or ""))}
        kind = options.pop("format", "parquet" if path.endswith(".parquet") else "json" if path.endswith(".json") else "csv").lower()
        if way.lower() == "to":
            df = self._spark_sql(what[1:-1] if what[0] == "(" else f"SELECT * FROM {what}", parameters, frames)
            writer = df.write.mode("overwrite")
            if "partition_by" in options:
                writer = writer.partitionBy(*[p.strip() for p in options.pop("partition_by").strip("()").split(",")])
            names = {"delimiter": "sep", "header": "header", "compression": "compression", "nullstr": "nullValue", "quote": "quote", "escape": "escape"}
            writer.options(**{names[k]: v for k, v in options.items() if k in names}).format(kind).save(path)
            return None
        schema = self.spark.table(what).schema
        reader = {"parquet": lambda: readers.read_parquet(self.spark, path), "json": lambda: readers.read_json(self.spark, path), "csv": lambda: csv.read_csv(self.spark, path, header=options.get("header", "false").lower() == "true", sep=options.get("delimiter", ","), all_varchar=True)}[kind]()
        reader.toDF(*[f.name for f in schema]).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema]).write.insertInto(what)
        return None

    def _run_export(self, statement: str, parameters: Any, frames: list) -> None:
        """EXPORT DATABASE: each table as Parquet, and its columns as DDL."""
        path = re.search(r"'([^']+)'", statement)[1]
        tables = [t.name for t in self.spark.catalog.listTables() if not t.isTemporary]
        for t in tables:
            self.spark.table(t).write.mode("overwrite").parquet(f"{path}/{t}.parquet")
        self.spark.createDataFrame([(t,) for t in tables], "name string").write.mode("overwrite").json(f"{path}/tables.json")

    def _run_import(self, statement: str, parameters: Any, frames: list) -> None:
        path = re.search(r"'([^']+)'", statement)[1]
        for row in self.spark.read.schema("name string").json(f"{path}/tables.json").collect():
            self.spark.read.parquet(f"{path}/{row.name}.parquet").write.saveAsTable(row.name)

    def _run_pivot(self, statement: str, parameters: Any, frames: list) -> DataFrame:
        """PIVOT t ON c USING agg [GROUP BY keys]."""
        found = re.fullmatch(r"(?is)pivot\s+([\w.]+|\(.+?\))\s+on\s+(.+?)\s+using\s+(.+?)(?:\s+group\s+by\s+(.+?))?(?:\s+order\s+by\s+(.+))?", statement)
        source, on, using, keys, order = found.groups()
        df = self._spark_sql(source[1:-1] if source[0] == "(" else f"SELECT * FROM {source}", parameters, frames)
        on_values = re.fullmatch(r"(?is)(\w+)\s+in\s*\((.+)\)", on)
        column = on_values[1] if on_values else on
        used = {t.lower() for k, t in sql_text.tokens(using) if k == "word"}
        names = [k.strip("`") for k in split_top(keys)] if keys else [c for c in df.columns if c.lower() != column.lower() and c.lower() not in used]
        grouped = df.groupBy(*names)
        values = [v.strip("'") for v in split_top(on_values[2])] if on_values else None
        out = (grouped.pivot(column, values) if values else grouped.pivot(column)).agg(*[F.expr(sql_text.expression(u)) for u in split_top(using)])
        return out.selectExpr("*") if not order else out.orderBy(*[F.expr(o) for o in split_top(order)])

    # --- functions

    def create_function(self, name: str, function: Callable, parameters: list | None = None, return_type: Any = None, **options: Any) -> Connection:
        self.functions.create(name, function, parameters, return_type, **options)
        return self

    def remove_function(self, name: str) -> Connection:
        self.functions.remove(name)
        return self

    # --- the last result

    @property
    def description(self) -> list[tuple] | None:
        return self._result.description if self._result else None

    @property
    def rowcount(self) -> int:
        return -1

    def _last(self) -> Relation:
        if self._result is None:
            raise InvalidInputException("there is no open result")
        return self._result

    def __getattr__(self, name: str) -> Any:
        if name in ("fetchone", "fetchmany", "fetchall", "fetchnumpy", "fetchdf", "fetch_df_chunk", "df", "pl", "to_arrow_table", "to_arrow_reader", "fetch_arrow_table", "fetch_record_batch", "arrow", "torch", "tf"):
            return getattr(self._last(), name)
        raise AttributeError(name)


def _frames(frame: Any) -> list[dict]:
    """The variables that a caller sees: its own, its module's, then those of the frames above."""
    out = []
    while frame is not None:
        out += [frame.f_locals, frame.f_globals]
        frame = frame.f_back
    return out


_default: Connection | None = None


def default_connection() -> Connection:
    global _default
    if _default is None or _default._closed:
        _default = Connection()
    return _default


def set_default_connection(connection: Connection) -> None:
    global _default
    _default = connection


def connect(database: str = ":memory:", read_only: bool = False, config: dict | None = None) -> Connection:
    """A connection; a database other than memory names the warehouse's schema that it uses."""
    own = Connection(config=config)
    if database not in (":memory:", "", ":default:"):
        name = re.sub(r"\W", "_", database.rsplit("/", 1)[-1].split(".")[0])
        own.spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
        own.spark.catalog.setCurrentDatabase(name)
    return own
