"""Queries by how results, tables, views and statements are handled: each way that rows leave or enter the engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

import tessera
from tessera import sql_text, types
from tessera.connection import Connection, connect, default_connection, set_default_connection
from tessera.errors import ConversionException, Error
from tessera.expression import ColumnExpression, ConstantExpression, DefaultExpression
from tessera.plans import Query
from tessera.plans.tables import relation, views
from tessera.relation import Relation

C, V = ColumnExpression, ConstantExpression
QUERIES: dict[str, tuple[Query, str | None]] = {}
_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
_KINDS = "n_nationkey int, n_name string, n_regionkey int"


def _rows(name: str, fetch: Callable[[Relation], Any], sql: str = _NATION, kinds: str = _KINDS) -> None:
    """What a way to fetch gives for the nations, as rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame(fetch(relation(spark, sf_dir, "nation").order("n_nationkey")), kinds)

    QUERIES[f"result_{name}"] = (run, sql)


def _con(name: str, tables: str, use: Callable[[Connection], Any], sql: str, kinds: str = "v string") -> None:
    """What is done with a connection in which tables are views: a frame, a relation, or rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = use(views(spark, sf_dir, tables))
        return out if isinstance(out, DataFrame) else out.dataframe if isinstance(out, Relation) else spark.createDataFrame(out, kinds)

    QUERIES[f"con_{name}"] = (run, sql)


def _one_by_one(fetch: Callable[[], Any]) -> list:
    return list(iter(fetch, None))


def _until_empty(fetch: Callable[[], Any]) -> list:
    out = []
    while len(part := fetch()):
        out += part if isinstance(part, list) else part.astype(object).values.tolist()
    return out


def _columns_to_rows(columns: dict) -> list:
    return [tuple(v.item() if hasattr(v, "item") else v for v in r) for r in zip(*columns.values())]


_rows("fetchone", lambda r: _one_by_one(r.fetchone))
_rows("fetchmany", lambda r: _until_empty(lambda: r.fetchmany(7)))
_rows("fetchall", lambda r: r.fetchall())
_rows("fetchnumpy", lambda r: _columns_to_rows(r.fetchnumpy()))
_rows("df", lambda r: r.df().astype(object).values.tolist())
_rows("fetch_df_chunk", lambda r: _until_empty(r.fetch_df_chunk))
_rows("to_arrow_table", lambda r: r.to_arrow_table())
_rows("to_arrow_reader", lambda r: r.to_arrow_reader(4).read_all())
_rows("arrow_stream", lambda r: __import__("pyarrow").table(r))
_rows("execute", lambda r: r.execute().fetchall())
_rows("close", lambda r: (r.execute().close(), r.fetchall())[1])
_rows("columns_types", lambda r: [(n, types.type_name(t)) for n, t in zip(r.columns, r.types)], "SELECT * FROM (VALUES ('n_nationkey', 'INTEGER'), ('n_name', 'VARCHAR'), ('n_regionkey', 'INTEGER')) v(n, t)", "n string, t string")
_rows("dtypes", lambda r: [(types.type_name(t),) for t in r.dtypes], "SELECT * FROM (VALUES ('INTEGER'), ('VARCHAR'), ('INTEGER')) v(t)", "t string")
_rows("description", lambda r: [(d[0],) for d in r.description], "SELECT * FROM (VALUES ('n_nationkey'), ('n_name'), ('n_regionkey')) v(n)", "n string")
_rows("len_shape", lambda r: [(len(r), *r.shape)], "SELECT count(*) AS n, count(*) AS rows, 3::BIGINT AS cols FROM nation", "n long, rows long, cols long")
_rows("contains", lambda r: [("n_name" in r, "x" in r)], "SELECT true AS a, false AS b", "a boolean, b boolean")
_rows("alias", lambda r: [(r.set_alias("q").alias,)], "SELECT 'q' AS v", "v string")
_rows("type", lambda r: [(r.limit(3).type,)], "SELECT 'LIMIT_RELATION' AS v", "v string")
_rows("explain", lambda r: [("Scan parquet" in r.explain(),)], "SELECT true AS v", "v boolean")
_rows("map_names", lambda r: [(C("a").get_name(), repr(C("a") > 1) != "")], "SELECT 'a' AS n, true AS r", "n string, r boolean")


def _new() -> str:
    return f"t_{uuid.uuid4().hex[:12]}"


def _made(con: Connection, make: Callable[[Relation, str], Any], source: str = "nation") -> Relation:
    """The table or view that is made of a relation under a new name."""
    name = _new()
    make(con.sql(f"SELECT * FROM {source}"), name)
    return con.table(name)


def _then(con: Connection, *statements: str, source: str = "SELECT * FROM nation") -> Relation:
    """A table after statements in which {t} is its name."""
    name = _new()
    for s in (f"CREATE TABLE {{t}} AS {source}", *statements):
        con.execute(s.replace("{t}", name))
    return con.table(name)


def _raised(kind: type, use: Callable[[], Any]) -> list:
    try:
        use()
    except kind:
        return [(True,)]
    return [(False,)]


_TRUE = "SELECT true AS v"
_con("create", "nation", lambda c: _made(c, lambda r, n: r.create(n)), _NATION)
_con("to_table", "nation", lambda c: _made(c, lambda r, n: r.to_table(n)), _NATION)
_con("create_view", "nation", lambda c: c.sql("SELECT * FROM nation").create_view(_new()), _NATION)
_con("to_view", "nation", lambda c: c.sql("SELECT n_name FROM nation").to_view(_new()), "SELECT n_name FROM nation")
_con("view", "nation", lambda c: c.view("nation"), _NATION)
_con("insert_into", "nation", lambda c: _made(c, lambda r, n: (r.create(n), r.filter("n_regionkey = 1").insert_into(n))), f"{_NATION} UNION ALL {_NATION} WHERE n_regionkey = 1")
_con("query", "nation", lambda c: c.sql("SELECT * FROM nation WHERE n_regionkey = 1").query("own_rows", "SELECT count(*) AS n, max(n_name) AS m FROM own_rows"), "SELECT count(*) AS n, max(n_name) AS m FROM nation WHERE n_regionkey = 1")
_con("unregister", "nation", lambda c: (c.register("gone", c.sql("SELECT 1").dataframe), c.unregister("gone"), _raised(Error, lambda: c.sql("SELECT * FROM gone").fetchall()))[2], _TRUE, "v boolean")
_con("get_table_names", "nation region", lambda c: [(n,) for n in c.get_table_names("WITH q AS (SELECT 1) SELECT * FROM nation, q JOIN region ON true")], "SELECT * FROM (VALUES ('nation'), ('region')) t(v)")
_con("extract_statements", "nation", lambda c: [(s.type, s.query.strip()) for s in c.extract_statements("SELECT 1; DROP TABLE x")], "SELECT * FROM (VALUES ('SELECT', 'SELECT 1'), ('DROP', 'DROP TABLE x')) t(t, q)", "t string, q string")
_con("statement", "nation", lambda c: [(s.expected_result_type[0], *sorted(s.named_parameters)) for s in c.extract_statements("SELECT * FROM nation WHERE n_name = $b AND n_regionkey = $a")], "SELECT 'QUERY_RESULT' AS t, 'a' AS a, 'b' AS b", "t string, a string, b string")
_con("statement_run", "nation", lambda c: c.sql(c.extract_statements("SELECT n_name FROM nation")[0]), "SELECT n_name FROM nation")
_con("several_statements", "nation", lambda c: c.sql("SELECT 1; SELECT n_name FROM nation"), "SELECT n_name FROM nation")
_con("cursor", "nation", lambda c: c.cursor().execute("SELECT 1 AS a UNION ALL SELECT 2").fetchall(), "SELECT * FROM (VALUES (1::INT), (2::INT)) t(a)", "a int")
_con("execute_fetchall", "nation", lambda c: c.execute("SELECT n_nationkey FROM nation WHERE n_regionkey = ?", [2]).fetchall(), "SELECT n_nationkey FROM nation WHERE n_regionkey = 2", "n_nationkey int")
_con("description", "nation", lambda c: [(d[0],) for d in c.execute("SELECT n_name AS a, n_regionkey AS b FROM nation").description], "SELECT * FROM (VALUES ('a'), ('b')) t(v)")
_con("rowcount", "nation", lambda c: [(c.execute("SELECT 1").rowcount,)], "SELECT -1::INT AS v", "v int")
_con("with_block", "nation", lambda c: [_raised(Error, lambda: (c.__enter__(), c.__exit__(None, None, None), c.execute("SELECT 1")))[0]], _TRUE, "v boolean")
_con("rollback_raises", "nation", lambda c: (c.begin().commit().checkpoint(), _raised(Error, c.rollback))[1], _TRUE, "v boolean")
_con("query_progress", "nation", lambda c: [(c.query_progress() <= 1,)], _TRUE, "v boolean")
_con("default_connection", "nation", lambda c: (set_default_connection(c), default_connection().sql("SELECT n_name FROM nation"))[1], "SELECT n_name FROM nation")
_con("module_functions", "nation", lambda c: (set_default_connection(c), tessera.sql("SELECT n_name FROM nation"))[1], "SELECT n_name FROM nation")
_con("dbapi_constants", "nation", lambda c: [(tessera.apilevel, tessera.paramstyle, tessera.threadsafety)], "SELECT '2.0' AS a, 'qmark' AS p, 1::INT AS t", "a string, p string, t int")
_con("tokenize", "nation", lambda c: sql_text.tokenize("SELECT 'a;' -- x"), "SELECT * FROM (VALUES (0::INT, 'word'), (7::INT, 'string')) t(pos, kind)", "pos int, kind string")
_con("profiling", "nation", lambda c: (c.enable_profiling(), c.execute("SELECT count(*) FROM nation").fetchall(), [("Scan" in c.get_profiling_information(),)])[2], _TRUE, "v boolean")
_con("object_columns", "nation", lambda c: c.from_df(__import__("pandas").DataFrame({"a": [1, None, "x"], "b": [True, False, None]}).astype(object)), "SELECT * FROM (VALUES ('1', true), (NULL, false), ('x', NULL)) t(a, b)")
_con("numpy", "nation", lambda c: c.from_df({"a": __import__("numpy").arange(4), "b": __import__("numpy").arange(4) / 2}), "SELECT range AS a, range / 2 AS b FROM range(4)")

# tables and views by SQL
_con("sql_create_view", "nation", lambda c: (c.execute("CREATE OR REPLACE TEMPORARY VIEW some AS SELECT n_name FROM nation WHERE n_regionkey = 3"), c.table("some"))[1], "SELECT n_name FROM nation WHERE n_regionkey = 3")
_con("sql_create_schema", "nation", lambda c: (s := f"s{uuid.uuid4().hex[:8]}", c.execute(f"CREATE SCHEMA {s}"), c.execute(f"CREATE TABLE {s}.t AS SELECT n_name FROM nation"), c.table(f"{s}.t"))[3], "SELECT n_name FROM nation")
_con("sql_alter_table", "nation", lambda c: _then(c, "ALTER TABLE {t} ADD COLUMN more INT", "INSERT INTO {t} VALUES (99, 'X', 1, 5)"), f"SELECT *, NULL::INT AS more FROM ({_NATION}) UNION ALL SELECT 99::INT, 'X', 1::INT, 5::INT")
_con("sql_drop_table", "nation", lambda c: (n := _new(), c.execute(f"CREATE TABLE {n} AS SELECT 1 AS a"), c.execute(f"DROP TABLE {n}"), _raised(Error, lambda: c.sql(f"SELECT * FROM {n}").fetchall()))[3], _TRUE, "v boolean")
_con("sql_or_replace", "nation", lambda c: _then(c, "CREATE OR REPLACE TABLE {t} (a INTEGER, b VARCHAR[])", "INSERT INTO {t} VALUES (1, ['x', 'y'])").project("a, b[2] as b"), "SELECT 1::INT AS a, 'y' AS b")
_con("sql_describe", "nation", lambda c: [(r[0], r[1]) for r in c.execute("DESCRIBE nation").fetchall()], "SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) v(n, t)", "n string, t string")
_con("sql_explain", "nation", lambda c: [("Scan" in c.execute("EXPLAIN SELECT * FROM nation").fetchone()[0],)], _TRUE, "v boolean")
_con("sql_set", "nation", lambda c: (c.execute("SET pandas_analyze_sample = 7"), c.sql("SELECT current_setting('pandas_analyze_sample') AS v"))[1], "SELECT 7::INT AS v")
_con("sql_prepare", "nation", lambda c: (c.execute("PREPARE p AS SELECT n_name FROM nation WHERE n_regionkey = ?"), c.execute("EXECUTE p(2)").fetchall())[1], "SELECT n_name AS v FROM nation WHERE n_regionkey = 2")
_con("sql_delete_all", "nation", lambda c: _then(c, "DELETE FROM {t}").aggregate("count(*) as n"), "SELECT 0::BIGINT AS n")
_con("update_default", "nation", lambda c: (n := _new(), c.sql("SELECT * FROM nation").create(n), c.table(n).update({"n_name": DefaultExpression()}, condition=C("n_regionkey") == V(1)), c.table(n))[3], "SELECT n_nationkey, CASE WHEN n_regionkey <> 1 THEN n_name END AS n_name, n_regionkey FROM nation")
_con("strict_cast_raises", "nation", lambda c: _raised(ConversionException, lambda: c.sql("SELECT CAST(n_name AS INTEGER) FROM nation").fetchall()), _TRUE, "v boolean")
_con("overflow_raises", "nation", lambda c: _raised(Error, lambda: c.sql("SELECT CAST(2147483647 AS INTEGER) + n_nationkey FROM nation").fetchall()), _TRUE, "v boolean")
_con("equal_aliases_raise", "nation", lambda c: _raised(Error, lambda: c.table("nation").set_alias("a").join(c.table("nation").set_alias("a"), "a.n_name = a.n_name").fetchall()), _TRUE, "v boolean")
_con("nan_is_greatest", "customer", lambda c: c.sql("SELECT c_custkey, CAST('NaN' AS DOUBLE) > c_acctbal AS v FROM customer"), "SELECT c_custkey, 'NaN'::DOUBLE > c_acctbal AS v FROM customer")
_con("type_factories", "nation", lambda c: [(types.type_name(t),) for t in (types.list_type("INTEGER"), types.map_type("VARCHAR", "BIGINT"), types.struct_type({"a": "INTEGER"}), types.decimal_type(9, 2))], "SELECT * FROM (VALUES ('INTEGER[]'), ('MAP(VARCHAR, BIGINT)'), ('STRUCT(a INTEGER)'), ('DECIMAL(9,2)')) t(v)")
_con("expressions", "part", lambda c: c.table("part").select(C("p_partkey"), (C("p_size") * 3).alias("m"), (C("p_size") != 7).alias("ne"), (C("p_size") >= 7).alias("ge"), (C("p_size") < 7).alias("lt"), (C("p_size") <= 7).alias("le")), "SELECT p_partkey, p_size * 3 AS m, p_size <> 7 AS ne, p_size >= 7 AS ge, p_size < 7 AS lt, p_size <= 7 AS le FROM part")
_con("expression_order", "part", lambda c: c.table("part").project("p_partkey, nullif(p_size, 1) as s").sort(C("s").asc().nulls_last(), C("p_partkey")).limit(9), "SELECT p_partkey, nullif(p_size, 1) AS s FROM part ORDER BY s ASC NULLS LAST, p_partkey LIMIT 9")
_con("connect", "nation", lambda c: [(isinstance(connect(), Connection),)], _TRUE, "v boolean")
