"""Queries by SQL text of the dialect, TPC-H-like ones too, and H2O-style groupings and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import Query
from tessera.plans.tables import views

QUERIES: dict[str, tuple[Query, str | None]] = {}


def _sql(name: str, tables: str, text: str, oracle: str | None = None, params: object = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        con = views(spark, sf_dir, tables)
        con.settings["python_enable_replacements"] = False
        return con.sql(text, params=params).dataframe

    QUERIES[name] = (run, oracle or text)


_sql("sql_cte", "orders", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), n AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY ALL) SELECT * FROM n WHERE n > 1")
_sql("sql_cte_shadow", "region", "WITH region AS (SELECT r_name FROM region WHERE r_regionkey > 2) SELECT * FROM region", "SELECT r_name FROM region WHERE r_regionkey > 2")
_sql("sql_recursive", "nation", "WITH RECURSIVE c(k) AS (SELECT 0 UNION ALL SELECT k + 5 FROM c WHERE k < 20) SELECT k, n_name FROM c JOIN nation ON n_nationkey = k")
_sql("sql_scalar_subquery", "part", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
_sql("sql_exists", "customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
_sql("sql_correlated", "orders", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
_sql("sql_from_first", "region", "FROM region")
_sql("sql_exclude", "nation", "SELECT * EXCLUDE (n_regionkey) FROM nation")
_sql("sql_qualify", "orders", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
_sql("sql_pivot", "orders", "PIVOT (SELECT o_orderstatus, o_orderpriority, o_custkey FROM orders) ON o_orderstatus IN ('F', 'O', 'P') USING sum(o_custkey) GROUP BY o_orderpriority", "SELECT o_orderpriority, sum(o_custkey) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS F, sum(o_custkey) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS O, sum(o_custkey) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS P FROM orders GROUP BY o_orderpriority")
_sql("sql_unpivot", "part", "SELECT p_partkey, field, v FROM (SELECT p_partkey, p_name, p_brand FROM part) UNPIVOT (v FOR field IN (p_name, p_brand))", "SELECT p_partkey, 'p_name' AS field, p_name AS v FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part")
_sql("sql_lateral", "customer orders", "SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)")
_sql("sql_values", "region", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(x, y)")
_sql("sql_range", "region", "SELECT id AS range FROM range(0, 20, 3)", "SELECT range FROM range(0, 20, 3)")
_sql("sql_unnest", "embeddings", "SELECT vec_id, unnest(embedding) AS x FROM embeddings")
_sql("sql_slice", "embeddings", "SELECT vec_id, unnest(embedding[2:5]) AS x, embedding[1] AS first, embedding[-1] AS last FROM embeddings")
_sql("sql_list_literal", "part", "SELECT p_partkey, array_to_string([p_brand, p_type, 'x'], '-') AS joined, list_contains([1, 2, 3], p_size) AS low FROM part")
_sql("sql_list_transform", "embeddings", "SELECT vec_id, round(list_reduce(list_transform(embedding, lambda x: x * x), lambda a, b: a + b), 4) AS norm FROM embeddings", "SELECT vec_id, round(list_reduce(list_transform(embedding, lambda x: x * x), lambda a, b: a + b), 4) AS norm FROM embeddings")
_sql("sql_list_filter", "embeddings", "SELECT vec_id, CAST(len(array_to_string(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: 'p'), '')) AS BIGINT) AS positive FROM embeddings")
_sql("sql_list_keeps_nulls", "orders", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, array_to_string(list_transform(list(nullif(o_orderpriority, '1-URGENT')), lambda x: coalesce('', 'v')), '') AS e, list_unique(list(nullif(o_orderpriority, '1-URGENT'))) AS kinds FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n, '' AS e, list_unique(list(nullif(o_orderpriority, '1-URGENT')))::BIGINT AS kinds FROM orders GROUP BY o_orderstatus")
_sql("sql_list_length", "orders", "SELECT o_orderstatus, length(array_to_string(list_transform(list(nullif(o_orderpriority, '1-URGENT')), lambda x: 'v'), '')) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*)::INT AS n FROM orders GROUP BY o_orderstatus")
_sql("sql_regexp_replace", "part", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS first, regexp_replace(p_name, '[AEIOU]', '_', 'gi') AS every FROM part")
_sql("sql_string_split", "part", "SELECT p_partkey, unnest(string_split(concat(p_brand, '.', p_type), '.')) AS part FROM part")
_sql("sql_modulo", "part", "SELECT p_partkey, p_partkey % (p_size - p_size) AS zero, p_size % 7 AS seven, (p_partkey + 1) % p_size AS size FROM part", "SELECT p_partkey, p_partkey % nullif(p_size - p_size, 0) AS zero, p_size % 7 AS seven, (p_partkey + 1) % p_size AS size FROM part")
_sql("sql_dates", "orders", "SELECT o_orderkey, CAST(dayofweek(o_orderdate) AS BIGINT) AS d, CAST(isodow(o_orderdate) AS BIGINT) AS i, date_diff('day', TIMESTAMP '1995-01-01 12:00:00', o_orderdate) AS days, date_diff('month', TIMESTAMP '1995-01-15 00:00:00', o_orderdate) AS months, date_diff('year', o_orderdate, TIMESTAMP '2000-06-01 00:00:00') AS years, strftime(o_orderdate, '%Y/%m/%dT%H:%M') AS text FROM orders")
_sql("sql_hours", "events", "SELECT event_id, date_diff('hour', TIMESTAMP '2024-01-01 00:30:00', ts) AS h, date_diff('minute', TIMESTAMP '2024-01-01 00:30:00', ts) AS m FROM events")
_sql("sql_numbers", "customer", "SELECT c_custkey, trunc(c_acctbal) AS t, isinf(c_acctbal) AS i, xor(c_nationkey, 5) AS x, sha256(c_name) AS s FROM customer")
_sql("sql_current_setting", "region", "SELECT r_name, current_setting('python_enable_replacements') AS s FROM region", "SELECT r_name, false AS s FROM region")
_sql("sql_group_all_order_all", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY ALL")
_sql("sql_is_distinct", "events", "SELECT event_id FROM events WHERE nullif(event_type, 'click') IS NOT DISTINCT FROM NULL")
_sql("sql_interval", "events", "SELECT event_id, ts + INTERVAL 2 DAY AS later FROM events")
_sql("sql_case_in", "part", "SELECT p_partkey, CASE WHEN p_size IN (1, 2) THEN 'tiny' WHEN p_size BETWEEN 3 AND 10 THEN 'small' ELSE 'other' END AS s FROM part")
_sql("sql_params_question", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = ? AND o_totalprice > ?", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000", ["F", 150000])
_sql("sql_params_named", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = $s AND o_totalprice > $p", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 250000", {"s": "O", "p": 250000})
_sql("sql_union_by_name", "nation region", "SELECT n_name AS name, n_regionkey AS k FROM nation UNION ALL BY NAME SELECT r_regionkey AS k, r_name AS name, 1 AS more FROM region")
_sql("sql_union_by_name_distinct", "nation region", "SELECT n_regionkey AS k, 'x' AS x FROM nation UNION BY NAME SELECT 'x' AS x, r_regionkey AS k FROM region")
_sql("sql_except", "lineitem", "SELECT DISTINCT l_orderkey FROM lineitem EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
_sql("sql_intersect", "lineitem", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
_sql("sql_filter_window", "orders", "SELECT o_orderkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f FROM orders", "SELECT o_orderkey, (sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT AS f FROM orders")
_sql("sql_struct", "part", "SELECT p_partkey, struct_pack(b := p_brand, s := p_size).s AS s FROM part")
_sql("sql_conversations", "conversations", "SELECT conv_id, count(*) AS turns, max(length(text)) AS longest FROM conversations GROUP BY conv_id", "SELECT conv_id, count(*) AS turns, max(length(text))::INT AS longest FROM conversations GROUP BY conv_id")
_sql("sql_documents_by_lang", "documents", "SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY lang", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")

# TPC-H-like, over the columns that are there
_sql("tpch_q1", "lineitem", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
_sql("tpch_q3", "customer orders lineitem", """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1997-03-15' AND l_shipdate > DATE '1997-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
_sql("tpch_q4", "orders lineitem", """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-07-01'
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority ORDER BY o_orderpriority""")
_sql("tpch_q5", "customer orders lineitem supplier nation region", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_nationkey = s_nationkey GROUP BY n_name ORDER BY revenue DESC""")
_sql("tpch_q6", "lineitem", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
_sql("tpch_q10", "customer orders lineitem nation", """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
_sql("tpch_q12", "orders lineitem", """SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= DATE '1997-01-01' GROUP BY l_linestatus""", """SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS high, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS low
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= DATE '1997-01-01' GROUP BY l_linestatus""")
_sql("tpch_q14", "lineitem part", "SELECT round(100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 4) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey")
_sql("tpch_q18", "customer orders lineitem", """SELECT c_name, o_orderkey, round(sum(l_quantity), 2) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY c_name, o_orderkey""")

# grouping and joining benchmarks
_sql("h2o_g1", "lineitem", "SELECT l_returnflag, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY l_returnflag")
_sql("h2o_g2", "lineitem", "SELECT l_returnflag, l_linenumber, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY l_returnflag, l_linenumber")
_sql("h2o_g3", "lineitem", "SELECT l_partkey, round(sum(l_quantity), 2) AS v1, round(avg(l_discount), 6) AS v3 FROM lineitem GROUP BY l_partkey")
_sql("h2o_g6", "lineitem", "SELECT l_linenumber, l_linestatus, median(l_extendedprice) AS med, round(stddev(l_extendedprice), 4) AS sd FROM lineitem GROUP BY l_linenumber, l_linestatus")
_sql("h2o_g7", "lineitem", "SELECT l_suppkey, max(l_linenumber) - min(l_linenumber) AS spread FROM lineitem GROUP BY l_suppkey")
_sql("h2o_g8", "lineitem", "SELECT l_suppkey, l_extendedprice FROM (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey) AS n FROM lineitem) WHERE n <= 2")
_sql("h2o_g9", "lineitem", "SELECT l_returnflag, l_linenumber, round(pow(corr(l_quantity, l_extendedprice), 2), 6) AS r2 FROM lineitem GROUP BY l_returnflag, l_linenumber")
_sql("h2o_g10", "lineitem", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(sum(l_quantity), 2) AS v, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber")
_sql("h2o_j1", "lineitem nation supplier", "SELECT l_orderkey, l_linenumber, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
_sql("h2o_j2", "lineitem part", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
_sql("h2o_j3", "lineitem orders", "SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F'")
