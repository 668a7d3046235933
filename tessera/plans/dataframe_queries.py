"""Queries by the methods of frames, groups and columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import Query
from tessera.plans.tables import frame
from tessera.sources.files import work_folder

QUERIES: dict[str, tuple[Query, str | None]] = {}


def _df(name: str, tables: str, build: Callable[..., DataFrame], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(*[frame(spark, sf_dir, t) for t in tables.split()])

    QUERIES[f"df_{name}"] = (run, sql)


_df("select_filter", "part", lambda d: d.select("p_partkey", d.p_size, d["p_brand"]).where(d.p_size > 40), "SELECT p_partkey, p_size, p_brand FROM part WHERE p_size > 40")
_df("with_column", "part", lambda d: d.withColumn("p_size", d.p_size + 1).withColumn("twice", F.col("p_size") * 2).select("p_partkey", "p_size", "twice"), "SELECT p_partkey, p_size + 1 AS p_size, (p_size + 1) * 2 AS twice FROM part")
_df("with_columns", "part", lambda d: d.withColumns({"a": d.p_size - 1, "b": F.upper("p_name")}).select("p_partkey", "a", "b"), "SELECT p_partkey, p_size - 1 AS a, upper(p_name) AS b FROM part")
_df("renamed", "nation", lambda d: d.withColumnRenamed("n_name", "name").withColumnsRenamed({"n_nationkey": "k", "none": "x"}).drop("n_regionkey", "missing"), "SELECT n_nationkey AS k, n_name AS name FROM nation")
_df("to_df", "region", lambda d: d.toDF("k", "name"), "SELECT r_regionkey AS k, r_name AS name FROM region")
_df("transform", "part", lambda d: d.transform(lambda x, n: x.filter(F.col("p_size") > n).select("p_partkey"), 30), "SELECT p_partkey FROM part WHERE p_size > 30")
_df("sort_head", "orders", lambda d: d.sort(F.desc("o_totalprice"), "o_orderkey").limit(7), "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
_df("join_on_name", "orders customer", lambda a, b: a.withColumnRenamed("o_custkey", "k").join(b.withColumnRenamed("c_custkey", "k"), "k", "leftsemi").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
_df("join_columns", "nation region", lambda a, b: a.alias("a").join(b.alias("b"), [F.col("a.n_regionkey") == F.col("b.r_regionkey"), F.col("b.r_regionkey") > 1], "left_outer").select("n_name", "r_name"), "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 1")
_df("cross_join", "region nation", lambda a, b: a.crossJoin(b).select("r_name", "n_name"), "SELECT r_name, n_name FROM region, nation")
_df("union_by_name", "nation region", lambda a, b: a.select("n_name").unionByName(b.select(F.col("r_name").alias("n_name"), "r_regionkey"), allowMissingColumns=True), "SELECT n_name, NULL::INT AS r_regionkey FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
_df("intersect", "lineitem", lambda d: d.select("l_linenumber").intersect(d.filter("l_quantity > 45").select("l_linenumber")), "SELECT l_linenumber FROM lineitem INTERSECT SELECT l_linenumber FROM lineitem WHERE l_quantity > 45")
_df("except_all", "lineitem", lambda d: d.select("l_linestatus").exceptAll(d.filter("l_quantity > 10").select("l_linestatus")), "SELECT l_linestatus FROM lineitem EXCEPT ALL SELECT l_linestatus FROM lineitem WHERE l_quantity > 10")
_df("drop_duplicates", "orders", lambda d: d.select("o_orderstatus", "o_orderpriority").dropDuplicates(), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_df("drop_duplicates_subset", "orders", lambda d: d.dropDuplicates(["o_custkey"]).select("o_custkey"), "SELECT DISTINCT o_custkey FROM orders")
_df("group_count", "orders", lambda d: d.groupBy("o_orderstatus").count(), "SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY o_orderstatus")
_df("group_methods", "part", lambda d: d.groupby("p_brand").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.sum("p_size").alias("s"), F.round(F.mean("p_size"), 6).alias("m")), "SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi, sum(p_size)::BIGINT AS s, round(avg(p_size), 6) AS m FROM part GROUP BY p_brand")
_df("group_sum", "lineitem", lambda d: d.groupBy("l_returnflag").sum("l_linenumber").withColumnRenamed("sum(l_linenumber)", "s"), "SELECT l_returnflag, sum(l_linenumber)::BIGINT AS s FROM lineitem GROUP BY l_returnflag")
_df("columns", "part", lambda d: d.select("p_partkey", d.p_name.contains("a").alias("c"), d.p_name.rlike("[0-9]").alias("r"), d.p_brand.startswith("Brand#2").alias("s"), d.p_brand.endswith("3").alias("e"), d.p_type.like("%O%").alias("l"), d.p_type.ilike("%o%").alias("i"), d.p_size.isin(1, 2, 3).alias("n"), d.p_size.cast("string").alias("t"), d.p_size.eqNullSafe(3).alias("q")), "SELECT p_partkey, contains(p_name, 'a') AS c, regexp_matches(p_name, '[0-9]') AS r, starts_with(p_brand, 'Brand#2') AS s, suffix(p_brand, '3') AS e, p_type LIKE '%O%' AS l, p_type ILIKE '%o%' AS i, p_size IN (1, 2, 3) AS n, p_size::VARCHAR AS t, p_size IS NOT DISTINCT FROM 3 AS q FROM part")
_df("get_item", "embeddings", lambda d: d.select("vec_id", d.embedding[0].alias("x"), d.embedding.getItem(2).alias("y")), "SELECT vec_id, embedding[1] AS x, embedding[3] AS y FROM embeddings")
_df("range", "region", lambda d: d.sparkSession.range(2, 20, 4), "SELECT range AS id FROM range(2, 20, 4)")
_df("pivot", "orders", lambda d: d.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).count(), "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS F, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS O FROM orders GROUP BY o_orderpriority")


def _col(name: str, tables: str, key: str, build: Callable[[DataFrame], Column], sql: str) -> None:
    """A column operation as v beside the key."""
    _df(f"column_{name}", tables, lambda d: d.select(key, build(d).alias("v")), f"SELECT {key}, {sql} AS v FROM {tables}")


_P, _C = ("part", "p_partkey"), ("customer", "c_custkey")
_col("neg", *_P, lambda d: -d.p_size, "-p_size")
_col("getattr", *_P, lambda d: d.p_brand, "p_brand")
_col("when", *_P, lambda d: F.when(d.p_size > 40, "big").when(d.p_size > 20, "middle"), "CASE WHEN p_size > 40 THEN 'big' WHEN p_size > 20 THEN 'middle' END")
_col("otherwise", *_P, lambda d: F.when(d.p_size > 40, 1).otherwise(0), "CASE WHEN p_size > 40 THEN 1 ELSE 0 END")
_col("cast", *_P, lambda d: d.p_size.cast("string"), "p_size::VARCHAR")
_col("isin", *_P, lambda d: d.p_size.isin(1, 2, 3), "p_size IN (1, 2, 3)")
_col("ne", *_P, lambda d: d.p_size != 7, "p_size <> 7")
_col("is_null", *_P, lambda d: F.nullif(d.p_size, F.lit(7)).isNull(), "nullif(p_size, 7) IS NULL")
_col("is_not_null", *_P, lambda d: F.nullif(d.p_size, F.lit(7)).isNotNull(), "nullif(p_size, 7) IS NOT NULL")
_col("and", *_P, lambda d: (d.p_size > 5) & (d.p_size < 9), "p_size > 5 AND p_size < 9")
_col("or", *_P, lambda d: (d.p_size < 5) | (d.p_size > 45), "p_size < 5 OR p_size > 45")
_col("invert", *_P, lambda d: ~(d.p_size > 5), "NOT p_size > 5")
_col("rand", *_P, lambda d: True & (d.p_size > 5), "p_size > 5")
_col("ror", *_P, lambda d: False | (d.p_size > 5), "p_size > 5")
_col("truediv", *_P, lambda d: d.p_size / 4, "p_size / 4")
_col("mod", *_P, lambda d: d.p_size % 4, "p_size % 4")
_col("pow", *_P, lambda d: d.p_size**2, "p_size ** 2.0")
_col("radd", *_P, lambda d: 1 + d.p_size, "1 + p_size")
_col("rsub", *_P, lambda d: 100 - d.p_size, "100 - p_size")
_col("rmul", *_P, lambda d: 3 * d.p_size, "3 * p_size")
_col("rtruediv", *_P, lambda d: F.round(100 / d.p_size, 9), "round(100 / p_size, 9)")
_col("rmod", *_P, lambda d: 100 % d.p_size, "100 % p_size")
_col("rpow", *_P, lambda d: 2 ** (d.p_size % 8), "2.0 ** (p_size % 8)")
_col("lt", *_C, lambda d: d.c_acctbal < 0, "c_acctbal < 0")
_col("le", *_C, lambda d: d.c_nationkey <= 4, "c_nationkey <= 4")
_col("ge", *_C, lambda d: d.c_nationkey >= 4, "c_nationkey >= 4")
_col("like", *_P, lambda d: d.p_type.like("%a%"), "p_type LIKE '%a%'")
_col("ilike", *_P, lambda d: d.p_type.ilike("%A%"), "p_type ILIKE '%A%'")
_NULLED = "nullif(o_orderstatus, 'F')"
for _name, _order in {"asc": "ASC NULLS FIRST", "desc": "DESC NULLS LAST", "asc_nulls_first": "ASC NULLS FIRST", "asc_nulls_last": "ASC NULLS LAST", "desc_nulls_first": "DESC NULLS FIRST", "desc_nulls_last": "DESC NULLS LAST"}.items():
    _df(
        f"column_{_name}",
        "orders",
        lambda d, n=_name: d.select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s")).orderBy(getattr(F.col("s"), n)(), "o_orderkey").limit(20),
        f"SELECT o_orderkey, {_NULLED} AS s FROM orders ORDER BY {_NULLED} {_order}, o_orderkey LIMIT 20",
    )


def _made(d: DataFrame, rows: list, schema: str) -> DataFrame:
    return d.sparkSession.createDataFrame(rows, schema)


def _table(d: DataFrame, use: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """d as a table of a new name; its rows are read before the table goes."""
    name = f"t_{uuid.uuid4().hex[:10]}"
    d.write.saveAsTable(name)
    try:
        out = use(d.sparkSession, name)
        return _made(d, out.collect(), out.schema.simpleString()[7:-1]) if out.columns else out
    finally:
        d.sparkSession.sql(f"DROP TABLE {name}")


def _file(d: DataFrame, kind: str) -> DataFrame:
    spark = d.sparkSession
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    getattr(d.write, kind)(path, **({"header": True} if kind == "csv" else {}))
    return getattr(spark.read.schema(d.schema), kind)(path, **({"header": True} if kind == "csv" else {}))


_df("to_pandas", "region", lambda d: _made(d, [tuple(r) for r in d.toPandas().astype(object).itertuples(index=False)], "r_regionkey int, r_name string"), "SELECT * FROM region")
_df("to_arrow", "region", lambda d: _made(d, [tuple(r.values()) for r in d.toArrow().to_pylist()], "r_regionkey int, r_name string"), "SELECT * FROM region")
_df("head", "region", lambda d: _made(d, [d.orderBy("r_regionkey").head()], "r_regionkey int, r_name string"), "SELECT * FROM region ORDER BY r_regionkey LIMIT 1")
_df("take", "region", lambda d: _made(d, d.orderBy("r_regionkey").take(2), "r_regionkey int, r_name string"), "SELECT * FROM region ORDER BY r_regionkey LIMIT 2")
_df("collect", "region", lambda d: _made(d, d.collect(), "r_regionkey int, r_name string"), "SELECT * FROM region")
_df("count", "lineitem", lambda d: _made(d, [(d.count(),)], "n long"), "SELECT count(*) AS n FROM lineitem")
_df("columns_dtypes", "nation", lambda d: _made(d, [(n, t) for n, t in d.dtypes if n in d.columns], "n string, t string"), "SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) v(n, t)")
_df("schema", "nation", lambda d: _made(d, [(f.name, f.nullable) for f in d.schema], "n string, x boolean"), "SELECT * FROM (VALUES ('n_nationkey', true), ('n_name', true), ('n_regionkey', true)) v(n, x)")
_df("contains", "nation", lambda d: _made(d, [("n_name" in d.columns, "x" in d.columns)], "a boolean, b boolean"), "SELECT true AS a, false AS b")
_df("union", "nation region", lambda a, b: a.select("n_name").union(b.select("r_name")), "SELECT n_name FROM nation UNION ALL SELECT r_name FROM region")
_df("union_all", "nation region", lambda a, b: a.select("n_name").unionAll(b.select("r_name")), "SELECT n_name FROM nation UNION ALL SELECT r_name FROM region")
_df("intersect_all", "lineitem", lambda d: d.select("l_linenumber").intersectAll(d.filter("l_quantity > 45").select("l_linenumber")), "SELECT l_linenumber FROM lineitem INTERSECT ALL SELECT l_linenumber FROM lineitem WHERE l_quantity > 45")
_df("distinct", "orders", lambda d: d.select("o_orderpriority").distinct(), "SELECT DISTINCT o_orderpriority FROM orders")
_df("order_by", "orders", lambda d: d.orderBy("o_totalprice", ascending=False).limit(5), "SELECT * FROM orders ORDER BY o_totalprice DESC LIMIT 5")
_df("drop_duplicates_alias", "orders", lambda d: d.drop_duplicates(["o_orderstatus"]).select("o_orderstatus"), "SELECT DISTINCT o_orderstatus FROM orders")
_df("cache", "region", lambda d: d.cache(), "SELECT * FROM region")
_df("create_data_frame", "region", lambda d: _made(d, [(1, "a"), (2, None)], "k int, s string"), "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) v(k, s)")
_df("session_sql", "region", lambda d: d.sparkSession.sql("SELECT r_name FROM {t} WHERE r_regionkey > 1", t=d), "SELECT r_name FROM region WHERE r_regionkey > 1")
_df("temp_view", "region", lambda d: (d.createOrReplaceTempView("df_temp_view"), d.sparkSession.table("df_temp_view"))[1], "SELECT * FROM region")
_df("global_temp_view", "region", lambda d: (d.createOrReplaceGlobalTempView("df_global_view"), d.sparkSession.table("global_temp.df_global_view"))[1], "SELECT * FROM region")
_df("active_session", "region", lambda d: SparkSession.getActiveSession().range(3), "SELECT range AS id FROM range(3)")
_df("new_session", "region", lambda d: _made(d, [(d.sparkSession.newSession().range(4).count(),)], "n long"), "SELECT 4::BIGINT AS n")
_df("save_as_table", "nation", lambda d: _table(d, lambda s, n: s.table(n)), "SELECT * FROM nation")
_df("catalog_columns", "nation", lambda d: _table(d, lambda s, n: s.createDataFrame([(c.name, c.dataType) for c in s.catalog.listColumns(n)], "n string, t string")), "SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) v(n, t)")
_df("catalog_tables", "region", lambda d: _table(d, lambda s, n: s.createDataFrame([(sum(t.name == n for t in s.catalog.listTables()),)], "n long")), "SELECT 1::BIGINT AS n")
_df("catalog_databases", "region", lambda d: _made(d, [("default" in [x.name for x in d.sparkSession.catalog.listDatabases()],)], "x boolean"), "SELECT true AS x")
_df("catalog_functions", "region", lambda d: _made(d, [("abs" in [x.name for x in d.sparkSession.catalog.listFunctions()],)], "x boolean"), "SELECT true AS x")
_df("conf", "region", lambda d: (d.sparkSession.conf.set("tessera.x", "5"), _made(d, [(d.sparkSession.conf.get("tessera.x"), d.sparkSession.conf.isModifiable("spark.sql.shuffle.partitions"))], "a string, b boolean"), d.sparkSession.conf.unset("tessera.x"))[1], "SELECT '5' AS a, true AS b")
_df("udf_register", "part", lambda d: (d.sparkSession.udf.register("df_plus", lambda x: x + 1, "int"), d.selectExpr("p_partkey", "df_plus(p_size) AS v"))[1], "SELECT p_partkey, p_size + 1 AS v FROM part")
_df("write_parquet", "nation", lambda d: _file(d, "parquet"), "SELECT * FROM nation")
_df("write_csv", "nation", lambda d: _file(d, "csv"), "SELECT * FROM nation")
_df("write_json", "nation", lambda d: _file(d, "json"), "SELECT * FROM nation")
_df("group_mean", "part", lambda d: d.groupBy("p_brand").mean("p_size").toDF("p_brand", "m"), "SELECT p_brand, avg(p_size) AS m FROM part GROUP BY p_brand")
_df("group_avg", "part", lambda d: d.groupBy("p_brand").avg("p_size").toDF("p_brand", "m"), "SELECT p_brand, avg(p_size) AS m FROM part GROUP BY p_brand")
_df("group_max", "part", lambda d: d.groupBy("p_brand").max("p_size").toDF("p_brand", "m"), "SELECT p_brand, max(p_size) AS m FROM part GROUP BY p_brand")
_df("group_min", "part", lambda d: d.groupBy("p_brand").min("p_size").toDF("p_brand", "m"), "SELECT p_brand, min(p_size) AS m FROM part GROUP BY p_brand")
