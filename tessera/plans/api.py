"""Queries by the connection: files written and read back, registered objects, functions, table changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.connection import Connection
from tessera.expression import ColumnExpression, ConstantExpression
from tessera.plans import Query
from tessera.plans.tables import frame, relation, views
from tessera.sources.files import work_folder


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark)
    relation(spark, sf_dir, "customer").to_csv(path, sep="|")
    return Connection(spark).read_csv(path, sep="|", header=True, dtype={"c_custkey": "BIGINT", "c_nationkey": "INTEGER", "c_acctbal": "DOUBLE"}).dataframe


def _csv_sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark)
    relation(spark, sf_dir, "nation").to_csv(path, sep=";")
    return Connection(spark).read_csv(path).project("n_nationkey, n_name, n_regionkey").dataframe


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark)
    frame(spark, sf_dir, "part").write.json(path)
    return Connection(spark).read_json(path, columns={"p_partkey": "BIGINT", "p_name": "VARCHAR", "p_size": "INTEGER", "p_retailprice": "DOUBLE"}).dataframe


def _parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark)
    relation(spark, sf_dir, "orders").to_parquet(path, partition_by=["o_orderstatus"], compression="zstd")
    return Connection(spark).read_parquet(path).filter("o_orderstatus = 'F'").project("o_orderkey, o_orderstatus").dataframe


def _row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Connection(spark).read_parquet(f"{sf_dir}/region.parquet", file_row_number=True, filename=True)
    return own.project("r_regionkey, file_row_number, filename like '%region.parquet' as named").dataframe


def _copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    con, path = views(spark, sf_dir, "supplier"), work_folder(spark)
    con.execute(f"COPY (SELECT s_suppkey, s_name FROM supplier) TO '{path}' (FORMAT parquet)")
    return con.read_parquet(path).dataframe


def _table(con: Connection, text: str) -> str:
    name = f"t_{uuid.uuid4().hex[:12]}"
    con.execute(f"CREATE TABLE {name} AS {text}")
    return name


def _insert_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    con = views(spark, sf_dir, "nation")
    name = _table(con, "SELECT * FROM nation")
    con.execute(f"INSERT INTO {name} VALUES (99, 'NOWHERE', 9)")
    con.execute(f"UPDATE {name} SET n_name = lower(n_name) WHERE n_regionkey = 1")
    con.execute(f"DELETE FROM {name} WHERE n_regionkey = 2")
    con.table(name).update({"n_regionkey": ColumnExpression("n_regionkey") + 10}, condition=ColumnExpression("n_nationkey") > 20)
    return con.table(name).dataframe


def _returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    con = views(spark, sf_dir, "region")
    name = _table(con, "SELECT * FROM region")
    return con.sql(f"INSERT INTO {name} SELECT r_regionkey + 10, r_name FROM region RETURNING r_regionkey, r_name").dataframe


def _append(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    con = views(spark, sf_dir, "region")
    name = _table(con, "SELECT * FROM region")
    con.append(name, pd.DataFrame({"r_name": ["MOON", "MARS"], "r_regionkey": [7, 8]}), by_name=True)
    con.table(name).insert((9, "SUN"))
    return con.table(name).dataframe


def _executemany(spark: SparkSession, sf_dir: str) -> DataFrame:
    con = Connection(spark.newSession())
    name = f"t_{uuid.uuid4().hex[:12]}"
    con.execute(f"CREATE TABLE {name} (a INTEGER, b VARCHAR)")
    con.executemany(f"INSERT INTO {name} VALUES (?, ?)", [(1, "x"), (2, "y"), (3, None)])
    return con.table(name).dataframe


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Connection(spark).values((1, "a"), (2, "b")).dataframe


def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    con = views(spark, sf_dir, "nation")
    con.register("wanted", pd.DataFrame({"k": [1, 3, 5]}))
    return con.sql("SELECT n_name FROM nation JOIN wanted ON n_nationkey = k").dataframe


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa

    con = views(spark, sf_dir, "nation")
    chosen_keys = pa.table({"k": [2, 4, 6]})
    assert chosen_keys.num_rows
    return con.sql("SELECT n_name FROM nation JOIN chosen_keys ON n_nationkey = k").dataframe


def _udf_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    con = views(spark, sf_dir, "part")

    def tag(size: int, brand: str) -> str:
        return f"{brand}:{size % 7}"

    con.create_function("tag", tag)
    return con.sql("SELECT p_partkey, tag(p_size, p_brand) AS v FROM part").dataframe


def _udf_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow.compute as pc

    con = views(spark, sf_dir, "part")
    con.create_function("plus", lambda a, b: pc.add(a, b), ["BIGINT", "BIGINT"], "BIGINT", type="arrow")
    return con.sql("SELECT p_partkey, plus(nullif(p_size, 1), 10) AS v FROM part").dataframe


def _udf_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    con = views(spark, sf_dir, "part")
    con.create_function("known", lambda x: -1 if x is None else x, ["INTEGER"], "INTEGER", null_handling="special")
    con.create_function("skipped", lambda x: x + 1, ["INTEGER"], "INTEGER")
    return con.sql("SELECT p_partkey, known(nullif(p_size, 1)) AS a, skipped(nullif(p_size, 1)) AS b FROM part").dataframe


def _udf_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    con = views(spark, sf_dir, "part")
    con.create_function("inverse", lambda x: 10 // (x % 3), ["INTEGER"], "INTEGER", exception_handling="return_null")
    return con.sql("SELECT p_partkey, inverse(p_size) AS v FROM part").dataframe


def _map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "part").project("p_partkey, p_size").map(lambda df: df.assign(double=df.p_size * 2)[["p_partkey", "double"]], schema={"p_partkey": "BIGINT", "double": "BIGINT"}).dataframe


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = relation(spark, sf_dir, "orders").filter(ColumnExpression("o_orderstatus") == ConstantExpression("O"))
    name = f"v_{uuid.uuid4().hex[:8]}"
    return own.query(name, f"SELECT 1 AS one, count(*) AS n FROM {name}").dataframe


def _table_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    con = Connection(spark)
    return con.table_function("range", [0, 10, 3]).dataframe.union(con.table_function("generate_series", [1, 3]).dataframe)


QUERIES: dict[str, tuple[Query, str | None]] = {
    "io_csv": (_csv, "SELECT * FROM customer"),
    "io_csv_sniffed": (_csv_sniffed, "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "io_json": (_json, "SELECT p_partkey, p_name, p_size, p_retailprice FROM part"),
    "io_parquet_partitioned": (_parquet, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'"),
    "io_file_columns": (_row_numbers, "SELECT r_regionkey, (row_number() OVER (ORDER BY r_regionkey) - 1)::BIGINT AS file_row_number, true AS named FROM region"),
    "io_copy": (_copy, "SELECT s_suppkey, s_name FROM supplier"),
    "dml_insert_update_delete": (_insert_update_delete, "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name, (n_regionkey + CASE WHEN n_nationkey > 20 THEN 10 ELSE 0 END)::INT AS n_regionkey FROM (SELECT * FROM nation UNION ALL SELECT 99, 'NOWHERE', 9) WHERE n_regionkey <> 2"),
    "dml_returning": (_returning, "SELECT (r_regionkey + 10)::INT AS r_regionkey, r_name FROM region"),
    "dml_append": (_append, "SELECT * FROM region UNION ALL SELECT * FROM (VALUES (7::INT, 'MOON'), (8::INT, 'MARS'), (9::INT, 'SUN'))"),
    "dml_executemany": (_executemany, "SELECT * FROM (VALUES (1::INT, 'x'), (2::INT, 'y'), (3::INT, NULL)) t(a, b)"),
    "values_rows": (_values, "SELECT * FROM (VALUES (1::INT, 'a'), (2::INT, 'b')) t(col0, col1)"),
    "registered_object": (_registered, "SELECT n_name FROM nation WHERE n_nationkey IN (1, 3, 5)"),
    "replacement_scan": (_replaced, "SELECT n_name FROM nation WHERE n_nationkey IN (2, 4, 6)"),
    "udf_native": (_udf_native, "SELECT p_partkey, p_brand || ':' || (p_size % 7) AS v FROM part"),
    "udf_arrow": (_udf_arrow, "SELECT p_partkey, (nullif(p_size, 1) + 10)::BIGINT AS v FROM part"),
    "udf_null_special": (_udf_nulls, "SELECT p_partkey, coalesce(nullif(p_size, 1), -1)::INT AS a, (nullif(p_size, 1) + 1)::INT AS b FROM part"),
    "udf_return_null": (_udf_errors, "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 10 ELSE 5 END AS v FROM part"),
    "map_in_pandas": (_map, "SELECT p_partkey, (p_size * 2)::BIGINT AS double FROM part"),
    "relation_query": (_view, "SELECT 1 AS one, count(*) AS n FROM orders WHERE o_orderstatus = 'O'"),
    "table_functions": (_table_functions, "SELECT range FROM range(0, 10, 3) UNION ALL SELECT * FROM generate_series(1, 3)"),
}
