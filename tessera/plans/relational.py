"""Queries by the relation API: projections, filters, joins, aggregates, windows, order and sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.expression import CaseExpression, CoalesceOperator, ColumnExpression, ConstantExpression, FunctionExpression, LambdaExpression, SQLExpression, StarExpression
from tessera.operators.joins import asof_join, interval_join, positional_join
from tessera.operators.skew import salted_count_distinct, top_k
from tessera.plans import Query
from tessera.plans.tables import frame, relation
from tessera.relation import Relation

C = ColumnExpression
QUERIES: dict[str, tuple[Query, str | None]] = {}


def _rel(name: str, tables: str, build: Callable[..., Relation], sql: str | None) -> None:
    """A query that builds a relation from relations of tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(*[relation(spark, sf_dir, t) for t in tables.split()]).dataframe

    QUERIES[name] = (run, sql)


# --- projection and filter
_rel("scan_region", "region", lambda r: r.select("*"), "SELECT * FROM region")
_rel("project_expr", "lineitem", lambda r: r.project("l_orderkey, l_linenumber, l_linenumber * 2 AS twice, l_linenumber // 2 AS half"), "SELECT l_orderkey, l_linenumber, l_linenumber * 2 AS twice, (l_linenumber // 2)::BIGINT AS half FROM lineitem")
_rel("project_expressions", "orders", lambda r: r.select(C("o_orderkey"), (C("o_custkey") + 1).alias("next"), (C("o_custkey") % 7).alias("rest"), (C("o_custkey") // 7).alias("whole"), (-C("o_custkey")).alias("minus")), "SELECT o_orderkey, o_custkey + 1 AS next, o_custkey % 7 AS rest, o_custkey // 7 AS whole, -o_custkey AS minus FROM orders")
_rel("arithmetic_power", "part", lambda r: r.select(C("p_partkey"), (C("p_size") ** 2).alias("square"), (C("p_size") / 4).alias("quarter"), (10 - C("p_size")).alias("less")), "SELECT p_partkey, pow(p_size, 2) AS square, p_size / 4 AS quarter, 10 - p_size AS less FROM part")
_rel("filter_and_or_not", "orders", lambda r: r.filter(((C("o_orderstatus") == ConstantExpression("F")) & (C("o_totalprice") > 100000)) | ~(C("o_custkey") > 100)), "SELECT * FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR NOT o_custkey > 100")
_rel("filter_sql", "lineitem", lambda r: r.filter("l_discount between 0.05 and 0.07 and l_quantity < 24"), "SELECT * FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
_rel("filter_in", "part", lambda r: r.filter(C("p_size").isin(1, 5, 9)), "SELECT * FROM part WHERE p_size IN (1, 5, 9)")
_rel("filter_not_in", "part", lambda r: r.filter(C("p_size").isnotin(1, 5, 9)), "SELECT * FROM part WHERE p_size NOT IN (1, 5, 9)")
_rel("filter_between", "part", lambda r: r.filter(C("p_size").between(10, 20)), "SELECT * FROM part WHERE p_size BETWEEN 10 AND 20")
_rel("filter_like", "part", lambda r: r.filter("p_type like 'S%'"), "SELECT * FROM part WHERE p_type LIKE 'S%'")
_rel("filter_ilike", "part", lambda r: r.filter("p_type ilike 's%'"), "SELECT * FROM part WHERE p_type ILIKE 's%'")
_rel("filter_function_operator", "part", lambda r: r.filter(FunctionExpression("~~", C("p_brand"), ConstantExpression("%1"))), "SELECT * FROM part WHERE p_brand LIKE '%1'")
_rel("filter_isnull", "events", lambda r: r.project("event_id, nullif(event_type, 'click') as t").filter(C("t").isnull()), "SELECT event_id, nullif(event_type, 'click') AS t FROM events WHERE nullif(event_type, 'click') IS NULL")
_rel("filter_isnotnull", "events", lambda r: r.project("event_id, nullif(event_type, 'click') as t").filter(C("t").isnotnull()), "SELECT event_id, nullif(event_type, 'click') AS t FROM events WHERE nullif(event_type, 'click') IS NOT NULL")
_rel("filter_pushdown_range", "lineitem", lambda r: r.filter("l_shipdate >= timestamp_ntz '1997-01-01' and l_shipdate < timestamp_ntz '1998-01-01'").project("l_orderkey, l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'")
_rel("select_types", "orders", lambda r: r.select_types(["BIGINT", "DOUBLE"]), "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
_rel("star_exclude", "customer", lambda r: r.select(StarExpression(exclude=["c_acctbal", "c_name"])), "SELECT * EXCLUDE (c_acctbal, c_name) FROM customer")
_rel("case_when", "orders", lambda r: r.select(C("o_orderkey"), CaseExpression(C("o_totalprice") > 200000, ConstantExpression("high")).when(C("o_totalprice") > 100000, ConstantExpression("mid")).otherwise(ConstantExpression("low")).alias("band")), "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
_rel("coalesce_null", "events", lambda r: r.select(C("event_id"), CoalesceOperator(SQLExpression("nullif(event_type, 'view')"), ConstantExpression("none")).alias("t")), "SELECT event_id, coalesce(nullif(event_type, 'view'), 'none') AS t FROM events")
_rel("cast_types", "lineitem", lambda r: r.select(C("l_orderkey").cast("INTEGER").alias("k"), C("l_quantity").cast("BIGINT").alias("q"), C("l_linenumber").cast("VARCHAR").alias("n"), C("l_discount").cast("DECIMAL(10,2)").alias("d")), "SELECT l_orderkey::INTEGER AS k, l_quantity::BIGINT AS q, l_linenumber::VARCHAR AS n, l_discount::DECIMAL(10,2) AS d FROM lineitem")
_rel("cast_sql_syntax", "lineitem", lambda r: r.project("l_orderkey::INTEGER as k, cast(l_linenumber as VARCHAR) as n"), "SELECT l_orderkey::INTEGER AS k, l_linenumber::VARCHAR AS n FROM lineitem")
_rel("collate_nocase", "part", lambda r: r.filter(C("p_type").collate("NOCASE") == ConstantExpression("economy")).project("p_partkey"), "SELECT p_partkey FROM part WHERE lower(p_type) = 'economy'")
_rel("lambda_expression", "embeddings", lambda r: r.select(C("vec_id"), FunctionExpression("list_transform", SQLExpression("embedding"), LambdaExpression("x", C("x") + 1)).alias("v")), "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE + 1) AS v FROM embeddings")
_rel("column_by_name", "orders", lambda r: r["o_orderkey"], "SELECT o_orderkey FROM orders")

# --- joins
_rel("join_inner", "nation region", lambda a, b: a.join(b, "n_regionkey = r_regionkey").project("n_name, r_name"), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_rel("join_left", "customer orders", lambda a, b: a.join(b, "c_custkey = o_custkey", "left").project("c_custkey, o_orderkey"), "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
_rel("join_right", "orders customer", lambda a, b: a.join(b, "o_custkey = c_custkey", "right").project("c_custkey, o_orderkey"), "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey")
_rel("join_outer", "supplier customer", lambda a, b: a.project("s_suppkey, s_nationkey").join(b.project("c_custkey"), "s_suppkey = c_custkey", "outer"), "SELECT s_suppkey, s_nationkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
_rel("join_semi", "customer orders", lambda a, b: a.join(b, "c_custkey = o_custkey", "semi"), "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
_rel("join_anti", "customer orders", lambda a, b: a.join(b.filter("o_totalprice > 300000"), "c_custkey = o_custkey", "anti"), "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
_rel("join_cross", "nation region", lambda a, b: a.cross(b).project("n_name, r_name"), "SELECT n_name, r_name FROM nation CROSS JOIN region")
_rel("join_using", "orders lineitem", lambda a, b: a.project("o_orderkey as k, o_custkey").join(b.project("l_orderkey as k, l_linenumber"), "k"), "SELECT o_orderkey AS k, o_custkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
_rel("join_using_list", "orders lineitem", lambda a, b: a.project("o_orderkey as k, o_custkey % 5 as m").join(b.project("l_orderkey as k, l_partkey % 5 as m, l_linenumber"), ["k", "m"]), "SELECT k, m, l_linenumber FROM (SELECT o_orderkey AS k, o_custkey % 5 AS m FROM orders) JOIN (SELECT l_orderkey AS k, l_partkey % 5 AS m, l_linenumber FROM lineitem) USING (k, m)")
_rel("join_expression", "nation region", lambda a, b: a.join(b, C("nation.n_regionkey") == C("region.r_regionkey")).project("n_nationkey, r_name"), "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_rel("join_self_alias", "nation nation", lambda a, b: a.set_alias("a").join(b.set_alias("b"), "a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey").project("a.n_name as first, b.n_name as second"), "SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_rel("join_theta_range", "nation region", lambda a, b: a.join(b, "n_nationkey between r_regionkey * 3 and r_regionkey * 3 + 4").project("n_nationkey, r_regionkey"), "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_nationkey BETWEEN r_regionkey * 3 AND r_regionkey * 3 + 4")
_rel(
    "join_star5", "lineitem orders customer nation region",
    lambda l, o, c, n, r: l.join(o, "l_orderkey = o_orderkey").set_alias("x").join(c, "o_custkey = c_custkey").set_alias("y").join(n, "c_nationkey = n_nationkey").set_alias("z").join(r, "n_regionkey = r_regionkey").aggregate("r_name, count(*) as n, round(sum(l_extendedprice), 2) as total", "r_name"),
    "SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = frame(spark, sf_dir, "events")
    clicks = events.filter("event_type = 'click'").select("user_id", "ts", "event_id")
    values = events.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return asof_join(clicks, values, "ts", ["user_id"], ["view_id"]).select("event_id", "view_id")


QUERIES["join_asof"] = (_asof, "SELECT c.event_id, v.view_id FROM (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL) v ON c.user_id = v.user_id AND c.ts >= v.ts")


def _interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = frame(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    left = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("s").alias("at"))
    right = events.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view"), F.col("s").alias("lo"), (F.col("s") + 3_600_000_000).alias("hi"))
    return interval_join(left, right, "at", "lo", "hi", ["user_id"], 3.6e9).select("click", "view")


QUERIES["join_interval"] = (_interval, "SELECT a.event_id AS click, b.event_id AS view FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND b.ts <= a.ts AND a.ts < b.ts + INTERVAL 1 HOUR")
QUERIES["join_positional"] = (
    lambda spark, sf_dir: positional_join(frame(spark, sf_dir, "nation").select("n_nationkey"), frame(spark, sf_dir, "supplier").select("s_suppkey"), "n_nationkey", "s_suppkey"),
    "SELECT n_nationkey, s_suppkey FROM (SELECT n_nationkey FROM nation ORDER BY 1) POSITIONAL JOIN (SELECT s_suppkey FROM supplier ORDER BY 1)",
)

# --- aggregates: groups
_rel("agg_global", "lineitem", lambda r: r.aggregate("count(*) as n, round(sum(l_quantity), 2) as q, max(l_shipdate) as last"), "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, max(l_shipdate) AS last FROM lineitem")
_rel("agg_groupby", "lineitem", lambda r: r.aggregate("l_returnflag, l_linestatus, count(*) as n, round(sum(l_extendedprice), 2) as total", "l_returnflag, l_linestatus"), "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY ALL")
_rel("agg_group_all", "orders", lambda r: r.aggregate("o_orderstatus, o_orderpriority, count(*) as n"), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
_rel("agg_expressions", "orders", lambda r: r.aggregate([C("o_orderstatus"), FunctionExpression("max", C("o_totalprice")).alias("top"), FunctionExpression("count", C("o_orderkey")).alias("n")]), "SELECT o_orderstatus, max(o_totalprice) AS top, count(o_orderkey) AS n FROM orders GROUP BY o_orderstatus")
_rel("agg_select_groups", "orders", lambda r: r.select("o_orderstatus, sum(o_custkey) as s", groups="o_orderstatus"), "SELECT o_orderstatus, sum(o_custkey)::BIGINT AS s FROM orders GROUP BY o_orderstatus")
_rel("agg_distinct", "lineitem", lambda r: r.aggregate("l_returnflag, count(distinct l_partkey) as parts", "l_returnflag"), "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
_rel("agg_filter_clause", "orders", lambda r: r.aggregate("o_orderpriority, count(*) filter (where o_orderstatus = 'F') as f, count(*) as n", "o_orderpriority"), "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) AS n FROM orders GROUP BY o_orderpriority")
_rel("agg_having", "lineitem", lambda r: r.aggregate("l_suppkey, count(*) as n", "l_suppkey").filter("n > 100"), "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 100")
_rel("agg_cube", "orders", lambda r: r.aggregate("o_orderstatus, o_orderpriority, count(*) as n", "cube(o_orderstatus, o_orderpriority)"), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_rel("agg_rollup", "orders", lambda r: r.aggregate("o_orderstatus, o_orderpriority, count(*) as n", "rollup(o_orderstatus, o_orderpriority)"), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_rel("agg_grouping_sets", "orders", lambda r: r.aggregate("o_orderstatus, o_orderpriority, count(*) as n", "grouping sets ((o_orderstatus), (o_orderpriority), ())"), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_rel("agg_apply", "lineitem", lambda r: r.apply("max", "l_quantity, l_linenumber", "l_returnflag", "", "l_returnflag").project("l_returnflag, `max(l_quantity)` as q, `max(l_linenumber)` as n"), "SELECT l_returnflag, max(l_quantity) AS q, max(l_linenumber) AS n FROM lineitem GROUP BY l_returnflag")
QUERIES["agg_salted_distinct"] = (lambda spark, sf_dir: salted_count_distinct(frame(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_orderkey"), "SELECT l_returnflag, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_returnflag")


def _agg(name: str, column: str, sql: str, table: str = "lineitem", key: str = "l_returnflag", post: str = "{}", method: str | None = None, args: tuple = (), **more) -> None:
    """One aggregate method by groups; post is Spark SQL around its value."""

    def build(r: Relation) -> Relation:
        out = getattr(r, method or name)(column, *args, groups=key, projected_columns=key, **more)
        value = "`" + out.columns[-1] + "`"
        return out.project(f"{key}, {post.format(value)} as v")

    _rel(f"agg_{name}", table, build, f"SELECT {key}, {sql} AS v FROM {table} GROUP BY {key}")


_agg("any_value", "n_regionkey", "any_value(n_regionkey)", "nation", "n_regionkey")
_agg("arg_max", "l_orderkey", "arg_max(l_orderkey, l_extendedprice * 1000 + l_orderkey % 7)", args=("l_extendedprice * 1000 + l_orderkey % 7",))
_agg("arg_min", "l_orderkey", "arg_min(l_orderkey, l_orderkey * 10 + l_linenumber)", args=("l_orderkey * 10 + l_linenumber",))
_agg("avg", "l_quantity", "round(avg(l_quantity), 6)", post="round({}, 6)")
_agg("mean", "l_discount", "round(avg(l_discount), 6)", post="round({}, 6)")
_agg("bit_and", "l_linenumber", "bit_and(l_linenumber)")
_agg("bit_or", "l_orderkey", "bit_or(l_orderkey)")
_agg("bit_xor", "l_orderkey", "bit_xor(l_orderkey)")
_agg("bitstring", "l_linenumber", "bitstring_agg(l_linenumber, 1, 7)::VARCHAR", method="bitstring_agg", min=1, max=7)
_agg("bool_and", "l_quantity > 0", "bool_and(l_quantity > 0)")
_agg("bool_or", "l_quantity > 49", "bool_or(l_quantity > 49)")
_agg("count", "nullif(l_linenumber, 1)", "count(nullif(l_linenumber, 1))")
_agg("favg", "l_quantity", "round(favg(l_quantity), 6)", post="round({}, 6)")
_agg("fsum", "l_quantity", "round(fsum(l_quantity), 2)", post="round({}, 2)")
_agg("geomean", "l_quantity", "round(geomean(l_quantity), 6)", post="round({}, 6)")
_agg("histogram", "o_orderpriority", "histogram(o_orderpriority)::VARCHAR", "orders", "o_orderstatus", post="concat('{{', array_join(transform(map_entries({}), e -> concat(e.key, '=', e.value)), ', '), '}}')")
_agg("list", "nullif(n_nationkey, 3)", "list(nullif(n_nationkey, 3) ORDER BY nullif(n_nationkey, 3) NULLS LAST)", "nation", "n_regionkey", post="array_sort({})")
_agg("max", "l_shipdate", "max(l_shipdate)")
_agg("min", "l_shipdate", "min(l_shipdate)")
_agg("product", "1 + c_nationkey / 1000", "round(product(1 + c_nationkey / 1000), 4)", "customer", "c_mktsegment", post="round({}, 4)")
_agg("string_agg", "n_name", "string_agg(n_name, '/' ORDER BY n_name)", "nation", "n_regionkey", post="array_join(array_sort(split({}, '/')), '/')", args=("/",))
_agg("sum", "l_linenumber", "sum(l_linenumber)::BIGINT")
_agg("median", "l_quantity", "median(l_quantity)")
_agg("mode", "l_linenumber % 2", "CASE WHEN count(*) FILTER (WHERE l_linenumber % 2 = 1) > count(*) FILTER (WHERE l_linenumber % 2 = 0) THEN 1 ELSE 0 END")
_agg("quantile_cont", "l_extendedprice", "round(quantile_cont(l_extendedprice, 0.3), 4)", post="round({}, 4)", args=(0.3,))
_agg("quantile_disc", "l_partkey", "quantile_disc(l_partkey, 0.3)", args=(0.3,))
_agg("quantile_list", "l_partkey", "quantile_disc(l_partkey, [0.25, 0.75])", method="quantile", args=([0.25, 0.75],))
_agg("stddev_pop", "l_quantity", "round(stddev_pop(l_quantity), 6)", post="round({}, 6)")
_agg("stddev_samp", "l_quantity", "round(stddev_samp(l_quantity), 6)", post="round({}, 6)")
_agg("stddev", "l_tax", "round(stddev(l_tax), 6)", post="round({}, 6)")
_agg("var_pop", "l_quantity", "round(var_pop(l_quantity), 5)", post="round({}, 5)")
_agg("var_samp", "l_quantity", "round(var_samp(l_quantity), 5)", post="round({}, 5)")
_agg("variance", "l_tax", "round(variance(l_tax), 6)", post="round({}, 6)")
_rel("agg_first", "nation", lambda r: r.project("n_regionkey, n_name, n_nationkey").aggregate("n_regionkey, min_by(n_name, n_nationkey) as v", "n_regionkey"), "SELECT n_regionkey, first(n_name ORDER BY n_nationkey) AS v FROM nation GROUP BY n_regionkey")
_rel("agg_last", "nation", lambda r: r.project("n_regionkey, n_name, n_nationkey").aggregate("n_regionkey, max_by(n_name, n_nationkey) as v", "n_regionkey"), "SELECT n_regionkey, last(n_name ORDER BY n_nationkey) AS v FROM nation GROUP BY n_regionkey")
for _name in ("first", "last", "any_value"):  # of equal values: which row comes first isn't said
    _rel(f"agg_{_name}_of_equal", "nation", lambda r, n=_name: getattr(r.project("n_regionkey, n_regionkey * 2 as v"), n)("v", "n_regionkey", projected_columns="n_regionkey").project(f"n_regionkey, `{n}(v)` as v"), "SELECT n_regionkey, n_regionkey * 2 AS v FROM nation GROUP BY n_regionkey")
_rel("agg_value_counts", "orders", lambda r: r.project("nullif(o_orderstatus, 'P') as s").value_counts("s").project("s, `count(s)` as n"), "SELECT s, count(s) AS n FROM (SELECT nullif(o_orderstatus, 'P') AS s FROM orders) GROUP BY s")
_rel("agg_unique", "orders", lambda r: r.unique("o_orderstatus, o_orderpriority"), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_rel("agg_corr", "lineitem", lambda r: r.aggregate("round(corr(l_quantity, l_extendedprice), 6) as c, round(covar_pop(l_quantity, l_tax), 6) as p, round(covar_samp(l_quantity, l_tax), 6) as s"), "SELECT round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_tax), 6) AS p, round(covar_samp(l_quantity, l_tax), 6) AS s FROM lineitem")
_rel("describe", "part", lambda r: r.project("p_size, p_brand").describe().project("aggr, round(p_size, 6) as p_size, p_brand"), """
WITH s AS (SELECT count(p_size)::DOUBLE AS count, avg(p_size) AS mean, stddev(p_size) AS stddev, min(p_size)::DOUBLE AS min, max(p_size)::DOUBLE AS max, median(p_size)::DOUBLE AS median, count(p_brand)::VARCHAR AS bc, min(p_brand) AS b0, max(p_brand) AS b1 FROM part)
SELECT 'count' AS aggr, round(count, 6) AS p_size, bc AS p_brand FROM s UNION ALL SELECT 'mean', round(mean, 6), NULL FROM s UNION ALL SELECT 'stddev', round(stddev, 6), NULL FROM s UNION ALL SELECT 'min', min, b0 FROM s UNION ALL SELECT 'max', max, b1 FROM s UNION ALL SELECT 'median', median, NULL FROM s""")


# --- windows
def _win(name: str, call: Callable[[Relation, str], Relation], sql: str, over: str = "(partition by o_custkey order by o_orderdate, o_orderkey)", post: str = "{}") -> None:
    def build(r: Relation) -> Relation:
        out = call(r, f"over {over}")
        value = "`" + out.columns[-1] + "`"
        return out.project(f"o_orderkey, {post.format(value)} as v")

    _rel(f"win_{name}", "orders", build, f"SELECT o_orderkey, {sql.format(f'OVER {over}')} AS v FROM orders")


_K = "o_orderkey"
_win("row_number", lambda r, w: r.row_number(w, _K), "(row_number() {})::INT")
_win("rank", lambda r, w: r.rank(w, _K), "(rank() {})::INT", "(partition by o_orderpriority order by o_orderstatus)")
_win("dense_rank", lambda r, w: r.dense_rank(w, _K), "(dense_rank() {})::INT", "(partition by o_orderpriority order by o_orderstatus)")
_win("percent_rank", lambda r, w: r.percent_rank(w, _K), "round(percent_rank() {}, 6)", "(partition by o_orderpriority order by o_custkey)", "round({}, 6)")
_win("cume_dist", lambda r, w: r.cume_dist(w, _K), "round(cume_dist() {}, 6)", "(partition by o_orderpriority order by o_custkey)", "round({}, 6)")
_win("ntile", lambda r, w: r.n_tile(w, 4, _K), "(ntile(4) {})::INT")
_win("lag", lambda r, w: r.lag("o_orderkey", w, 1, "-1", projected_columns=_K), "lag(o_orderkey, 1, -1) {}")
_win("lead", lambda r, w: r.lead("o_orderkey", w, 2, "-1", projected_columns=_K), "lead(o_orderkey, 2, -1) {}")
_win("lag_ignore_nulls", lambda r, w: r.lag("nullif(o_orderstatus, 'F')", w, 1, "NULL", True, _K), "lag(nullif(o_orderstatus, 'F'), 1 IGNORE NULLS) {}")
_win("first_value", lambda r, w: r.first_value("o_orderkey", w, _K), "first_value(o_orderkey) {}")
_win("last_value", lambda r, w: r.last_value("o_orderkey", w, _K), "last_value(o_orderkey) {}", "(partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following)")
_win("nth_value", lambda r, w: r.nth_value("o_orderkey", w, 2, False, _K), "nth_value(o_orderkey, 2) {}")
_win("running_sum", lambda r, w: r.sum("o_custkey", window_spec=w, projected_columns=_K), "(sum(o_custkey) {})::BIGINT", "(partition by o_orderstatus order by o_orderkey rows between unbounded preceding and current row)")
_win("moving_avg", lambda r, w: r.avg("o_totalprice", window_spec=w, projected_columns=_K), "round(avg(o_totalprice) {}, 4)", "(partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row)", "round({}, 4)")
_win("range_frame", lambda r, w: r.count("o_orderkey", window_spec=w, projected_columns=_K), "count(o_orderkey) {}", "(partition by o_orderpriority order by o_custkey range between 2 preceding and 2 following)")
_win("nulls_last", lambda r, w: r.row_number(w, _K), "(row_number() {})::INT", "(partition by o_custkey order by nullif(o_orderstatus, 'F'), o_orderkey)")
_win("framed_median", lambda r, w: r.median("o_totalprice", window_spec=w, projected_columns=_K), "median(o_totalprice) {}", "(partition by o_custkey order by o_orderkey rows between 3 preceding and current row)")
_win("max_partition", lambda r, w: r.max("o_totalprice", window_spec=w, projected_columns=_K), "max(o_totalprice) {}", "(partition by o_custkey)")
_win("bool_or", lambda r, w: r.bool_or("o_orderstatus = 'F'", window_spec=w, projected_columns=_K), "bool_or(o_orderstatus = 'F') {}")
_win("list", lambda r, w: r.list("o_orderkey", window_spec=w, projected_columns=_K), "list(o_orderkey) {}", "(partition by o_custkey order by o_orderkey rows between 2 preceding and current row)")
QUERIES["win_topk"] = (
    lambda spark, sf_dir: top_k(frame(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3),
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3",
)

# --- order, limit, sets
_rel("sort_nulls", "part", lambda r: r.project("p_partkey, nullif(p_size, 1) as s").sort(C("s").desc().nulls_first(), C("p_partkey")).limit(50), "SELECT p_partkey, nullif(p_size, 1) AS s FROM part ORDER BY s DESC NULLS FIRST, p_partkey LIMIT 50")
_rel("order_default_nulls", "part", lambda r: r.project("p_partkey, nullif(p_size, 1) as s").order("s, p_partkey").limit(40), "SELECT p_partkey, nullif(p_size, 1) AS s FROM part ORDER BY s NULLS LAST, p_partkey LIMIT 40")
_rel("order_ordinal", "part", lambda r: r.project("p_brand, p_partkey").order("#1 desc, #2").limit(30), "SELECT p_brand, p_partkey FROM part ORDER BY 1 DESC, 2 LIMIT 30")
_rel("order_all", "nation", lambda r: r.order("all").limit(10), "SELECT * FROM nation ORDER BY ALL LIMIT 10")
_rel("topk", "orders", lambda r: r.order("o_totalprice desc, o_orderkey").limit(20), "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_rel("limit_offset", "customer", lambda r: r.order("c_custkey").limit(10, 25), "SELECT * FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 25")
_rel("distinct", "lineitem", lambda r: r.project("l_returnflag, l_linestatus").distinct(), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_rel("union_all", "nation", lambda r: r.project("n_name").union(r.project("n_name")), "SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation")
_rel("union_distinct", "nation region", lambda a, b: a.project("n_regionkey as k").union(b.project("r_regionkey as k")).distinct(), "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
_rel("except_all", "lineitem", lambda r: r.project("l_returnflag as f").except_(r.filter("l_linenumber > 1").project("l_returnflag as f")), "SELECT l_returnflag AS f FROM lineitem EXCEPT ALL SELECT l_returnflag FROM lineitem WHERE l_linenumber > 1")
_rel("intersect_all", "lineitem", lambda r: r.project("l_linenumber as n").intersect(r.filter("l_returnflag = 'R'").project("l_linenumber as n")), "SELECT l_linenumber AS n FROM lineitem INTERSECT ALL SELECT l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
