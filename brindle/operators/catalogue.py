"""Operators by name: a statement of the dialect, and DuckDB SQL for the same rows (None: the same text)."""

from __future__ import annotations

Q: dict[str, tuple[str, str, str | None]] = {}


def op(name: str, tables: str, dialect: str, duck: str | None = None) -> None:
    Q[name] = (tables, dialect, duck)


# Scans and sources
op("S01_scan", "nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation", "SELECT n_nationkey::BIGINT n_nationkey, n_name, n_regionkey::BIGINT n_regionkey FROM nation")
op("S02_point_range_lookup", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900 OR o_orderkey = 5000")
op("S03_index_range", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 42 AND l_linenumber < 4", "SELECT l_orderkey, l_linenumber::BIGINT l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 42 AND l_linenumber < 4")
op("S04_multi_index_or", "customer", "SELECT c_custkey FROM customer WHERE c_custkey = 17 OR c_nationkey = 3")
op("S05_in_list_probe", "supplier", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (1, 5, 9, 77, 100000)")
op("S06_column_pruning", "lineitem", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
op("S07_hash_join_index", "orders customer", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders, customer WHERE o_custkey = c_custkey AND c_mktsegment = 'BUILDING'")
op("S08_values", "", "SELECT column1, column2 FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL))", "SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, 'b'), (3, NULL)) v(column1, column2)")
op("S09_no_from", "", "SELECT 1 + 1 AS two, 'x' AS x", "SELECT 2::BIGINT two, 'x' x")
op("S10_derived_table", "orders", "SELECT a.k, a.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) a WHERE a.n > 10")

# Projection, filters, expressions
op("P01_projection", "supplier", "SELECT s.*, s_suppkey * 2 AS twice FROM supplier s", "SELECT s_suppkey, s_name, s_nationkey::BIGINT s_nationkey, s_acctbal, s_suppkey * 2 AS twice FROM supplier s")

op("P02_filter", "lineitem", "SELECT count(*) AS n FROM lineitem WHERE l_discount < 0.05 AND l_quantity", "SELECT count(*) AS n FROM lineitem WHERE l_discount < 0.05 AND l_quantity <> 0")
op("P03_column_resolution", "nation region", "SELECT n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS r FROM nation")
op("P04_quoted_fallback", "region", 'SELECT r_name, "not a column" AS s FROM region', "SELECT r_name, 'not a column' AS s FROM region")
op("P05_alias_anywhere", "part", "SELECT p_size + 1 AS x, count(*) AS n FROM part WHERE x > 10 GROUP BY x HAVING n > 3 ORDER BY x", "SELECT (p_size + 1)::BIGINT AS x, count(*) AS n FROM part WHERE p_size + 1 > 10 GROUP BY 1 HAVING count(*) > 3 ORDER BY 1")
op("P06_add_subtract_multiply", "part", "SELECT p_partkey, p_partkey + p_size AS a, p_partkey - p_size AS s, p_partkey * p_size AS m, 9223372036854775807 + 1 AS big FROM part", "SELECT p_partkey, p_partkey + p_size AS a, p_partkey - p_size AS s, p_partkey * p_size AS m, 9223372036854775808::DOUBLE AS big FROM part")
op("P07_divide", "part", "SELECT p_partkey, p_partkey / p_size AS q, p_partkey / (p_size - p_size) AS z, p_retailprice / 7 AS r FROM part", "SELECT p_partkey, p_partkey // p_size AS q, NULL::BIGINT AS z, p_retailprice / 7 AS r FROM part")
op("P08_modulo", "part", "SELECT p_partkey, p_partkey % p_size AS m, p_retailprice % 7 AS r, p_partkey % (p_size - p_size) AS z FROM part", "SELECT p_partkey, p_partkey % p_size AS m, (trunc(p_retailprice)::BIGINT % 7)::DOUBLE AS r, NULL::BIGINT AS z FROM part")
op("P09_unary", "customer", "SELECT c_custkey, -c_custkey AS neg, +c_acctbal AS pos, -c_acctbal AS negbal FROM customer")
op("P10_concat", "customer", "SELECT c_custkey, c_name || '/' || c_custkey AS s, c_name || NULL AS n FROM customer", "SELECT c_custkey, c_name || '/' || c_custkey::VARCHAR AS s, NULL::VARCHAR AS n FROM customer")
op("P11_comparisons", "part", "SELECT p_partkey, p_size = 10 AS eq, p_size == '10' AS eqt, p_size <> 10 AS ne, p_size < 'a' AS lt, p_brand >= 'Brand#3' AS ge, p_partkey + 9007199254740992 = p_partkey + 9007199254740992.0 AS big, p_partkey + 9007199254740992 < p_partkey + 9007199254740992.0 AS lb FROM part", "SELECT p_partkey, (p_size = 10)::BIGINT AS eq, (p_size = 10)::BIGINT AS eqt, (p_size <> 10)::BIGINT AS ne, 1::BIGINT AS lt, (p_brand >= 'Brand#3')::BIGINT AS ge, (p_partkey + 9007199254740992 = (p_partkey::DOUBLE + 9007199254740992::DOUBLE)::BIGINT)::BIGINT AS big, (p_partkey + 9007199254740992 < (p_partkey::DOUBLE + 9007199254740992::DOUBLE)::BIGINT)::BIGINT AS lb FROM part")
NUL = "CASE WHEN p_size > 25 THEN NULL ELSE p_size END"
op("P12_three_valued_logic", "part", f"SELECT p_partkey, ({NUL} > 10) AND p_size < 40 AS a, ({NUL} > 10) OR p_size < 5 AS o, NOT ({NUL} > 10) AS n FROM part", f"SELECT p_partkey, (({NUL} > 10) AND p_size < 40)::BIGINT AS a, (({NUL} > 10) OR p_size < 5)::BIGINT AS o, (NOT ({NUL} > 10))::BIGINT AS n FROM part")
op("P13_null_tests", "part", f"SELECT p_partkey, {NUL} IS NULL AS a, {NUL} NOTNULL AS b, {NUL} ISNULL AS c, {NUL} NOT NULL AS d FROM part", f"SELECT p_partkey, ({NUL} IS NULL)::BIGINT AS a, ({NUL} IS NOT NULL)::BIGINT AS b, ({NUL} IS NULL)::BIGINT AS c, ({NUL} IS NOT NULL)::BIGINT AS d FROM part")
op("P14_is", "part", f"SELECT p_partkey, {NUL} IS p_size AS a, {NUL} IS NOT p_size AS b, {NUL} IS DISTINCT FROM 7 AS c FROM part", f"SELECT p_partkey, ({NUL} IS NOT DISTINCT FROM p_size)::BIGINT AS a, ({NUL} IS DISTINCT FROM p_size)::BIGINT AS b, ({NUL} IS DISTINCT FROM 7)::BIGINT AS c FROM part")
op("P15_between", "lineitem", "SELECT count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount NOT BETWEEN 0.02 AND 0.04")
op("P16_in_list", "part", f"SELECT p_partkey, p_size IN (1, 2, 3) AS a, {NUL} IN (1, NULL) AS b, p_size NOT IN (5, 6) AS c, p_size IN () AS d FROM part", f"SELECT p_partkey, (p_size IN (1, 2, 3))::BIGINT AS a, ({NUL} IN (1, NULL))::BIGINT AS b, (p_size NOT IN (5, 6))::BIGINT AS c, 0::BIGINT AS d FROM part")
op("P17_like", "part", "SELECT p_partkey, p_type LIKE '%brass' AS a, p_name LIKE 'a_%' AS b, p_brand LIKE 'brand#1_' AS c, p_type LIKE 'x%' ESCAPE 'x' AS d FROM part", "SELECT p_partkey, (p_type ILIKE '%brass')::BIGINT AS a, (p_name ILIKE 'a_%')::BIGINT AS b, (p_brand ILIKE 'brand#1_')::BIGINT AS c, (p_type = '%')::BIGINT AS d FROM part")
op("P18_glob", "part", "SELECT p_partkey, p_type GLOB '*BRASS' AS a, p_brand GLOB 'Brand#[1-3]?' AS b, p_name GLOB '[^a-m]*' AS c, p_brand GLOB substr(p_brand, 1, 6) || '*' AS d FROM part", "SELECT p_partkey, (p_type GLOB '*BRASS')::BIGINT AS a, regexp_matches(p_brand, '^Brand#[1-3].$')::BIGINT AS b, regexp_matches(p_name, '^[^a-m]')::BIGINT AS c, 1::BIGINT AS d FROM part")
op("P19_case", "orders", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS a, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS b, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2.5 END AS c FROM orders", "SELECT o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END)::BIGINT AS a, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS b, CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '2.5' END AS c FROM orders")
op("P20_truth", "part", "SELECT count(*) AS n, sum(CASE WHEN p_name THEN 1 ELSE 0 END) AS t, sum(CASE WHEN '3x' THEN 1 ELSE 0 END) AS u FROM part WHERE p_size - 7", "SELECT count(*) AS n, 0::BIGINT AS t, count(*) AS u FROM part WHERE p_size <> 7")
op("P21_cast", "part", "SELECT p_partkey, CAST(p_retailprice AS INTEGER) AS i, CAST(p_size AS REAL) AS r, CAST(p_size AS TEXT) AS t, CAST(substr(p_brand, 7) || 'x' AS INTEGER) AS b FROM part", "SELECT p_partkey, trunc(p_retailprice)::BIGINT AS i, p_size::DOUBLE AS r, p_size::VARCHAR AS t, substr(p_brand, 7)::BIGINT AS b FROM part")
op("P22_bits", "part", "SELECT p_partkey, p_partkey & 7 AS a, p_partkey | 8 AS o, ~p_partkey AS n, p_partkey << 3 AS l, p_partkey >> 1 AS r, p_partkey << 64 AS z, p_partkey << -1 AS m FROM part", "SELECT p_partkey, p_partkey & 7 AS a, p_partkey | 8 AS o, ~p_partkey AS n, p_partkey << 3 AS l, p_partkey >> 1 AS r, 0::BIGINT AS z, p_partkey >> 1 AS m FROM part")
op("P23_collate", "orders", "SELECT count(*) AS n FROM orders WHERE o_orderpriority = '1-urgent' COLLATE NOCASE", "SELECT count(*) AS n FROM orders WHERE lower(o_orderpriority) = '1-urgent'")
op("P24_precedence", "part", "SELECT p_partkey, 1 + p_size * 2 % 7 - 3 AS a, NOT p_size = 3 OR p_size < 2 AS b, p_size & 3 + 1 AS c FROM part", "SELECT p_partkey, (1 + ((p_size * 2) % 7) - 3)::BIGINT AS a, ((NOT (p_size = 3)) OR p_size < 2)::BIGINT AS b, (p_size & 4)::BIGINT AS c FROM part")
op("P25_literals", "", "SELECT 42 AS i, 0x1F AS h, 1.5e3 AS r, .5 AS d, 'it''s' AS s, TRUE AS t, FALSE AS f, hex(X'00ff') AS b", "SELECT 42::BIGINT i, 31::BIGINT h, 1500.0::DOUBLE r, 0.5::DOUBLE d, 'it''s' s, 1::BIGINT t, 0::BIGINT f, '00FF' b")
op("P26_in_table", "nation customer", "WITH k AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) SELECT count(*) AS n FROM customer WHERE c_nationkey IN k", "SELECT count(*) AS n FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
op("C01_binary_collation", "part", "SELECT count(*) AS n FROM part WHERE p_type = lower(p_type)")
op("C02_nocase", "part", "SELECT lower(p_type) AS t, count(*) AS n FROM part GROUP BY p_type COLLATE NOCASE", "SELECT lower(p_type) AS t, count(*) AS n FROM part GROUP BY 1")
op("C03_rtrim", "region", "SELECT r_regionkey, r_name || '  ' = r_name COLLATE RTRIM AS a, '  ' || r_name = r_name COLLATE RTRIM AS b FROM region", "SELECT r_regionkey::BIGINT r_regionkey, 1::BIGINT AS a, 0::BIGINT AS b FROM region")

# Joins
op("J01_inner", "orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000")
op("J02_cross", "nation region", "SELECT n_name, r_name FROM nation, region CROSS JOIN (SELECT 1 AS one) x", "SELECT n_name, r_name FROM nation, region")
op("J03_left", "customer orders", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY c_custkey")
op("J04_right", "orders customer", "SELECT c_custkey, count(o_orderkey) AS n FROM orders RIGHT OUTER JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
op("J05_full", "supplier customer", "SELECT a.k, a.n, b.m FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS m FROM customer WHERE c_nationkey > 5 GROUP BY 1) b ON a.k = b.k", "SELECT a.k::BIGINT k, a.n, b.m FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS m FROM customer WHERE c_nationkey > 5 GROUP BY 1) b ON a.k = b.k")
op("J06_natural", "nation", "SELECT * FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) NATURAL JOIN (SELECT n_nationkey AS k, n_regionkey AS b FROM nation)", "SELECT n_nationkey::BIGINT k, n_name a, n_regionkey::BIGINT b FROM nation")
op("J07_using", "supplier customer", "SELECT k, n, m FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS m FROM customer WHERE c_nationkey > 5 GROUP BY 1) b USING (k)", "SELECT k::BIGINT k, n, m FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS m FROM customer WHERE c_nationkey > 5 GROUP BY 1) b USING (k)")
op("J08_star_order", "nation region", "SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) JOIN (SELECT r_regionkey AS k, r_name FROM region) USING (k) ORDER BY k, n_name", "SELECT n_regionkey::BIGINT k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
op("J09_multi_way", "region nation customer orders", "SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY r_name")
op("J10_semi", "customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
op("J11_anti", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
op("J12_null_aware_anti", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
op("J13_theta", "supplier part", "SELECT count(*) AS n FROM supplier JOIN part ON p_size BETWEEN s_nationkey AND s_nationkey + 2")
op("J14_null_safe", "part", f"SELECT count(*) AS n FROM (SELECT DISTINCT {NUL} AS a FROM part) x JOIN (SELECT DISTINCT {NUL} AS b FROM part) y ON x.a IS y.b", f"SELECT count(*) AS n FROM (SELECT DISTINCT {NUL} AS a FROM part) x JOIN (SELECT DISTINCT {NUL} AS b FROM part) y ON x.a IS NOT DISTINCT FROM y.b")

# Subqueries
op("Q01_scalar", "orders", "SELECT (SELECT max(o_totalprice) FROM orders) AS top, (SELECT o_orderkey FROM orders WHERE o_orderkey < 0) AS none, (SELECT o_orderkey FROM orders ORDER BY o_orderkey) AS first", "SELECT (SELECT max(o_totalprice) FROM orders) AS top, NULL::BIGINT AS none, (SELECT min(o_orderkey) FROM orders) AS first")
op("Q02_correlated_scalar", "customer orders", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS best FROM customer", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS best FROM customer")
op("Q03_exists_value", "customer orders", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS e, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS n FROM customer", "SELECT c_custkey, (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P'))::BIGINT AS e, (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey))::BIGINT AS n FROM customer")
op("Q04_in_subquery", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) AND c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -950)")
op("Q05_in_subquery_value", "part", f"SELECT p_partkey, {NUL} IN (SELECT p_size FROM part WHERE p_size < 20) AS a, p_size IN (SELECT {NUL} FROM part) AS b, p_size NOT IN (SELECT {NUL} FROM part WHERE p_size < 10 OR p_size > 30) AS c, p_size IN (SELECT p_size FROM part WHERE p_size < 0) AS d FROM part", f"SELECT p_partkey, ({NUL} IN (SELECT p_size FROM part WHERE p_size < 20))::BIGINT AS a, (p_size IN (SELECT {NUL} FROM part))::BIGINT AS b, (p_size NOT IN (SELECT {NUL} FROM part WHERE p_size < 10 OR p_size > 30))::BIGINT AS c, 0::BIGINT AS d FROM part")
op("Q06_correlated_with_group", "orders customer", "SELECT o_custkey, count(*) AS n, (SELECT c_name FROM customer WHERE c_custkey = o_custkey) AS name FROM orders GROUP BY o_custkey")
op("Q07_outer_aggregate", "orders", "SELECT o_orderstatus, (SELECT sum(orders.o_custkey)) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, sum(o_custkey)::BIGINT AS s FROM orders GROUP BY o_orderstatus")
op("Q08_correlated_order_having", "orders customer", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT c_nationkey FROM customer WHERE c_custkey = o_custkey) ORDER BY (SELECT c_acctbal FROM customer WHERE c_custkey = o_custkey), o_custkey", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT c_nationkey FROM customer WHERE c_custkey = o_custkey)")
op("Q09_multi_level", "region nation customer", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900))")
op("Q10_limit_subquery", "orders region", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT (SELECT count(*) FROM region) OFFSET 2", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 2")

# Aggregates
op("A01_group_by", "orders", "SELECT substr(o_orderdate, 1, 7) AS month, count(*) AS n FROM orders GROUP BY month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
op("A02_no_group", "lineitem", "SELECT count(*) AS n, sum(l_quantity) AS q, min(l_shipdate) AS d FROM lineitem WHERE l_quantity > 1000", "SELECT count(*) AS n, sum(l_quantity) AS q, min(strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')) AS d FROM lineitem WHERE l_quantity > 1000")
op("A03_having", "lineitem", "SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey HAVING q > 200")
op("A04_count", "part", f"SELECT count(*) AS a, count({NUL}) AS b FROM part")
op("A05_sum", "lineitem", "SELECT l_linestatus, sum(l_orderkey) AS i, sum(l_quantity) AS q FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, sum(l_orderkey)::BIGINT AS i, sum(l_quantity) AS q FROM lineitem GROUP BY l_linestatus")
op("A07_total", "part", "SELECT total(p_size) AS a, total(NULL) AS b, total(p_size) FILTER (WHERE p_size < 0) AS c FROM part", "SELECT sum(p_size)::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS c FROM part")
op("A08_avg", "part", "SELECT p_brand, round(avg(p_size), 6) AS a FROM part GROUP BY p_brand")
op("A09_min_max", "part", "SELECT p_brand, min(p_name) AS a, max(p_retailprice) AS b, min(p_size) AS c FROM part GROUP BY p_brand", "SELECT p_brand, min(p_name) AS a, max(p_retailprice) AS b, min(p_size)::BIGINT AS c FROM part GROUP BY p_brand")
op("A10_group_concat", "nation", "SELECT n_regionkey, group_concat(n_name ORDER BY n_name) AS a, string_agg(n_name, ' / ' ORDER BY n_name DESC) AS b FROM nation GROUP BY n_regionkey", "SELECT n_regionkey::BIGINT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS a, string_agg(n_name, ' / ' ORDER BY n_name DESC) AS b FROM nation GROUP BY n_regionkey")
op("A11_distinct", "lineitem", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, sum(DISTINCT l_quantity) AS s FROM lineitem GROUP BY l_returnflag")
op("A12_filter", "orders", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS m FROM orders GROUP BY o_orderpriority")
op("A13_ordered_aggregate", "supplier", "SELECT s_nationkey, group_concat(s_suppkey, '-' ORDER BY s_acctbal DESC, s_suppkey) AS l FROM supplier GROUP BY s_nationkey", "SELECT s_nationkey::BIGINT s_nationkey, string_agg(s_suppkey::VARCHAR, '-' ORDER BY s_acctbal DESC, s_suppkey) AS l FROM supplier GROUP BY s_nationkey")
op("A14_bare_columns", "orders", "SELECT o_custkey, max(o_totalprice) AS m, o_orderkey FROM orders GROUP BY o_custkey", "SELECT o_custkey, max(o_totalprice) AS m, arg_max(o_orderkey, o_totalprice) AS o_orderkey FROM orders GROUP BY o_custkey")
op("A15_distinct_rows", "part", "SELECT DISTINCT p_brand, p_size FROM part", "SELECT DISTINCT p_brand, p_size::BIGINT p_size FROM part")
op("A16_group_order", "part", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY p_brand")

# Windows
W = "PARTITION BY user_id ORDER BY ts, event_id"
op("W01_row_number", "events", f"SELECT event_id, row_number() OVER ({W}) AS n FROM events")
op("W02_rank", "part", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part")
op("W03_dense_rank", "part", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part")
op("W04_percent_rank", "part", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS r FROM part")
op("W05_cume_dist", "part", "SELECT p_partkey, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS r FROM part")
op("W06_ntile", "part", "SELECT p_partkey, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS a FROM part")
op("W07_lag", "events", f"SELECT event_id, lag(value) OVER ({W}) AS a, lag(event_id, 2, -1) OVER ({W}) AS b FROM events")
op("W08_lead", "events", f"SELECT event_id, lead(value) OVER ({W}) AS a, lead(event_id, 2, -1) OVER ({W}) AS b FROM events")
op("W09_first_value", "events", f"SELECT event_id, first_value(value) OVER ({W}) AS a FROM events")
op("W10_last_value", "events", f"SELECT event_id, last_value(value) OVER ({W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS a FROM events")
op("W11_nth_value", "events", f"SELECT event_id, nth_value(event_id, 3) OVER ({W}) AS a FROM events")
op("W12_window_aggregates", "lineitem", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS s, count(*) OVER (PARTITION BY l_orderkey) AS n, max(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS m FROM lineitem", "SELECT l_orderkey, l_linenumber::BIGINT l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS s, count(*) OVER (PARTITION BY l_orderkey) AS n, max(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS m FROM lineitem")
op("W13_window_concat", "nation", "SELECT n_name, group_concat(n_name, ',') OVER (PARTITION BY n_regionkey ORDER BY n_name) AS l FROM nation", "SELECT n_name, string_agg(n_name, ',') OVER (PARTITION BY n_regionkey ORDER BY n_name) AS l FROM nation")
op("W14_collated_order", "part", "SELECT p_partkey, row_number() OVER (PARTITION BY p_type COLLATE NOCASE ORDER BY p_name COLLATE NOCASE DESC NULLS LAST, p_partkey) AS n FROM part", "SELECT p_partkey, row_number() OVER (PARTITION BY lower(p_type) ORDER BY lower(p_name) DESC NULLS LAST, p_partkey) AS n FROM part")
op("W15_default_frame", "part", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS n FROM part")
op("W16_rows_frame", "events", f"SELECT event_id, count(*) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS n, max(value) OVER ({W} ROWS 2 PRECEDING) AS m FROM events")
op("W17_range_frame", "part", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM part")
op("W18_groups_frame", "part", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS 2 PRECEDING) AS s FROM part", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n, (sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS 2 PRECEDING))::BIGINT AS s FROM part")
op("W19_exclude", "part", "SELECT p_partkey, " + ", ".join(f"sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN 4 PRECEDING AND 2 FOLLOWING EXCLUDE {x}) AS {n}" for n, x in (("a", "CURRENT ROW"), ("b", "GROUP"), ("c", "TIES"))) + " FROM (SELECT p_partkey, p_brand, p_partkey * 1000 + p_size AS p_size FROM part)", "SELECT p_partkey, " + ", ".join(f"(sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN 4 PRECEDING AND 2 FOLLOWING EXCLUDE {x}))::BIGINT AS {n}" for n, x in (("a", "CURRENT ROW"), ("b", "GROUP"), ("c", "TIES"))) + " FROM (SELECT p_partkey, p_brand, p_partkey * 1000 + p_size AS p_size FROM part)")
op("W20_window_filter", "events", f"SELECT event_id, count(*) FILTER (WHERE event_type = 'click') OVER ({W}) AS n, max(value) FILTER (WHERE event_type <> 'view') OVER ({W}) AS m FROM events")
op("W21_named_windows", "events", "SELECT event_id, row_number() OVER w AS n, count(*) OVER (w ROWS 1 PRECEDING) AS c FROM events WINDOW p AS (PARTITION BY user_id), w AS (p ORDER BY ts, event_id)", f"SELECT event_id, row_number() OVER ({W}) AS n, count(*) OVER ({W} ROWS 1 PRECEDING) AS c FROM events")
op("W22_window_over_groups", "orders", "SELECT o_custkey % 40 AS k, count(*) AS n, sum(count(*)) OVER (ORDER BY o_custkey % 40) AS running, sum(count(*)) OVER (ORDER BY o_custkey % 40 ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS beside, count(*) OVER (ORDER BY count(*) / 10 GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS g, max(min(o_orderkey)) OVER (PARTITION BY o_custkey % 40 % 3 ORDER BY count(*) / 20 GROUPS BETWEEN CURRENT ROW AND 2 FOLLOWING EXCLUDE GROUP) AS m FROM orders GROUP BY k HAVING n > 1 ORDER BY n, k", "SELECT o_custkey % 40 AS k, count(*) AS n, (sum(count(*)) OVER (ORDER BY o_custkey % 40))::BIGINT AS running, (sum(count(*)) OVER (ORDER BY o_custkey % 40 ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW))::BIGINT AS beside, count(*) OVER (ORDER BY count(*) // 10 GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS g, max(min(o_orderkey)) OVER (PARTITION BY o_custkey % 40 % 3 ORDER BY count(*) // 20 GROUPS BETWEEN CURRENT ROW AND 2 FOLLOWING EXCLUDE GROUP) AS m FROM orders GROUP BY o_custkey % 40 HAVING count(*) > 1")

# Order, limits, set operations
op("O01_order_by", "supplier", "SELECT s_name, s_acctbal FROM supplier ORDER BY 2 DESC, s_name")
op("O02_nulls_order", "part", f"SELECT p_partkey, {NUL} AS x FROM part ORDER BY x DESC NULLS FIRST, p_partkey", f"SELECT p_partkey, ({NUL})::BIGINT AS x FROM part ORDER BY x DESC NULLS FIRST, p_partkey")
op("O03_collated_order", "part", "SELECT p_partkey, p_name FROM part ORDER BY p_name COLLATE NOCASE, p_partkey", "SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey")
op("O04_limit_offset", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
op("O05_top_k", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
op("O06_top_k_per_group", "orders", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
op("U01_union_all", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", "SELECT c_nationkey::BIGINT AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
op("U02_union", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey FROM supplier")
op("U03_intersect", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", "SELECT c_nationkey::BIGINT AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
op("U04_except", "nation supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000", "SELECT n_nationkey::BIGINT AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
op("U05_left_associative", "nation supplier customer", "SELECT n_nationkey AS k FROM nation UNION SELECT 100 INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT 3", "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) AND n_nationkey <> 3")
op("U06_compound_order", "customer supplier", "SELECT c_name AS n FROM customer UNION SELECT s_name FROM supplier ORDER BY n DESC LIMIT 20")
op("U07_compound_classes", "supplier", "SELECT s_suppkey AS x FROM supplier UNION ALL SELECT s_acctbal FROM supplier", "SELECT s_suppkey::VARCHAR AS x FROM supplier UNION ALL SELECT s_acctbal::VARCHAR FROM supplier")

# Common table expressions
op("R01_with", "orders customer", "WITH a(k, n) AS (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey), b AS (SELECT k FROM a WHERE n > 12) SELECT c_name FROM customer JOIN b ON c_custkey = k", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT k FROM a WHERE n > 12) SELECT c_name FROM customer JOIN b ON c_custkey = k")
op("R02_materialized", "orders", "WITH a AS MATERIALIZED (SELECT o_custkey FROM orders), b AS NOT MATERIALIZED (SELECT DISTINCT o_custkey FROM a) SELECT count(*) AS n FROM b", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
op("R03_shared_cte", "orders", "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT count(*) AS n FROM a x JOIN a y ON x.k = y.k AND x.t >= y.t", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
op("R04_recursive_union_all", "", "WITH RECURSIVE f(n, a, b) AS (SELECT 1, 0, 1 UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 20) SELECT n, a FROM f", "WITH RECURSIVE f(n, a, b) AS (SELECT 1::BIGINT, 0::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 20) SELECT n, a FROM f")
op("R05_recursive_union", "nation", "WITH RECURSIVE g(x) AS (SELECT 1 UNION SELECT (x * 3) % 25 FROM g) SELECT x, n_name FROM g JOIN nation ON n_nationkey = x", "WITH RECURSIVE g(x) AS (SELECT 1::BIGINT UNION SELECT (x * 3) % 25 FROM g) SELECT x, n_name FROM g JOIN nation ON n_nationkey = x")
op("R06_recursive_order", "", "WITH RECURSIVE t(id, d) AS (SELECT 1, 0 UNION ALL SELECT id * 2, d + 1 FROM t WHERE d < 3 UNION ALL SELECT id * 2 + 1, d + 1 FROM t WHERE d < 3 ORDER BY 2 DESC, 1) SELECT id, d FROM t", "WITH RECURSIVE t(id, d) AS (SELECT 1::BIGINT, 0::BIGINT UNION ALL SELECT id * 2 + k, d + 1 FROM t, (VALUES (0::BIGINT), (1::BIGINT)) v(k) WHERE d < 3) SELECT id, d FROM t")
op("R07_recursive_limit", "", "WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x * 2 FROM c LIMIT 12) SELECT x FROM c", "SELECT (1::BIGINT << i) AS x FROM range(12) r(i)")
op("R08_several_arms", "", "WITH RECURSIVE s(n) AS (SELECT 1 UNION SELECT n + 3 FROM s WHERE n < 30 UNION SELECT n + 5 FROM s WHERE n < 30) SELECT n FROM s", "WITH RECURSIVE s(n) AS (SELECT 1::BIGINT UNION SELECT n + k FROM s, (VALUES (3::BIGINT), (5::BIGINT)) v(k) WHERE n < 30) SELECT n FROM s")
op("R09_several_anchors", "", "WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT 100 UNION ALL SELECT n + 1 FROM s WHERE n % 10 < 5) SELECT n FROM s", "WITH RECURSIVE s(n) AS (SELECT * FROM (VALUES (1::BIGINT), (100::BIGINT)) v(n) UNION ALL SELECT n + 1 FROM s WHERE n % 10 < 5) SELECT n FROM s")
op("R10_deep_recursion", "", "WITH RECURSIVE c(x) AS (VALUES (1) UNION ALL SELECT x + 1 FROM c WHERE x < 100000) SELECT count(*) AS n, sum(x) AS s FROM c", "SELECT 100000::BIGINT AS n, 5000050000::BIGINT AS s")

# Scalar functions
C, P = "customer", "part"
op("F01_typeof", P, f"SELECT p_partkey, typeof(p_size) AS a, typeof(p_name) AS b, typeof(p_retailprice) AS c, typeof({NUL}) AS d, typeof(X'00') AS e FROM part", f"SELECT p_partkey, 'integer' AS a, 'text' AS b, 'real' AS c, CASE WHEN {NUL} IS NULL THEN 'null' ELSE 'integer' END AS d, 'blob' AS e FROM part")
op("F02_abs", C, "SELECT c_custkey, abs(c_acctbal) AS a, abs(-c_custkey) AS b FROM customer")
op("F03_char", P, "SELECT p_partkey, char(65 + p_size % 26, 8364, 128512) AS c FROM part", "SELECT p_partkey, chr((65 + p_size % 26)::INTEGER) || chr(8364) || chr(128512) AS c FROM part")
op("F04_coalesce", P, f"SELECT p_partkey, coalesce(NULL, {NUL}, -1) AS a, ifnull({NUL}, 0) AS b, coalesce({NUL}, 0.5) AS c, typeof(coalesce({NUL}, 0.5)) AS t FROM part", f"SELECT p_partkey, coalesce({NUL}, -1)::BIGINT AS a, ifnull({NUL}, 0)::BIGINT AS b, coalesce(({NUL})::VARCHAR, '0.5') AS c, CASE WHEN {NUL} IS NULL THEN 'real' ELSE 'integer' END AS t FROM part")
op("F05_concat", P, f"SELECT p_partkey, concat(p_brand, NULL, {NUL}) AS c FROM part")
op("F06_concat_ws", P, f"SELECT p_partkey, concat_ws('-', p_brand, {NUL}, p_size) AS c, concat_ws(NULL, 'a') AS n FROM part", f"SELECT p_partkey, concat_ws('-', p_brand, {NUL}, p_size) AS c, NULL::VARCHAR AS n FROM part")
op("F07_printf", P, "SELECT p_partkey, printf('%05d|%-6d|%x|%s|%.2f|%%', p_size, p_size, p_partkey, p_brand, p_retailprice) AS s FROM part", "SELECT p_partkey, printf('%05d|%-6d|%x|%s|%.2f|%%', p_size, p_size, p_partkey, p_brand, p_retailprice) AS s FROM part")
op("F08_glob", P, "SELECT p_partkey, glob('*BRASS', p_type) AS g FROM part", "SELECT p_partkey, (p_type GLOB '*BRASS')::BIGINT AS g FROM part")
op("F09_like", P, "SELECT p_partkey, like('%steel', p_type) AS g FROM part", "SELECT p_partkey, (p_type ILIKE '%steel')::BIGINT AS g FROM part")
op("F10_hex", P, "SELECT p_partkey, hex(p_brand) AS a, hex(p_size) AS b, hex(NULL) AS c FROM part", "SELECT p_partkey, hex(p_brand) AS a, hex(p_size::VARCHAR) AS b, '' AS c FROM part")
op("F11_unhex", P, "SELECT p_partkey, CAST(unhex(hex(p_brand)) AS TEXT) AS a, unhex('4') IS NULL AS b, hex(unhex('41-42', '-')) AS c FROM part", "SELECT p_partkey, p_brand AS a, 1::BIGINT AS b, '4142' AS c FROM part")
op("F12_instr", P, "SELECT p_partkey, instr(p_name, 'a') AS i, instr(p_name, '') AS e FROM part", "SELECT p_partkey, instr(p_name, 'a')::BIGINT AS i, 1::BIGINT AS e FROM part")
op("F13_length", P, "SELECT p_partkey, length(p_name) AS l, length(p_size) AS n, length('é€') AS u FROM part", "SELECT p_partkey, length(p_name)::BIGINT AS l, length(p_size::VARCHAR)::BIGINT AS n, 2::BIGINT AS u FROM part")
op("F14_octet_length", P, "SELECT p_partkey, octet_length(p_name || 'é') AS l FROM part", "SELECT p_partkey, strlen(p_name || 'é')::BIGINT AS l FROM part")
op("F15_likelihood", P, "SELECT p_partkey, likelihood(p_size, 0.5) AS a, likely(p_size) AS b, unlikely(p_name) AS c FROM part", "SELECT p_partkey, p_size::BIGINT AS a, p_size::BIGINT AS b, p_name AS c FROM part")
op("F16_lower_upper", P, "SELECT p_partkey, lower(p_type || 'É') AS a, upper(p_name || 'é') AS b FROM part", "SELECT p_partkey, lower(p_type) || 'É' AS a, upper(p_name) || 'é' AS b FROM part")
op("F17_trim", P, "SELECT p_partkey, trim('  ' || p_name || ' ') AS a, ltrim(p_brand, 'Brand#') AS b, rtrim(p_type, 'SEL') AS c, trim(p_name, 'aeiou') AS d FROM part")
op("F18_scalar_min_max", P, f"SELECT p_partkey, max(p_size, 20, p_partkey % 50) AS a, min(p_size, 20) AS b, max(p_size, {NUL}) AS c, min(p_brand, 'Brand#3') AS d FROM part", f"SELECT p_partkey, greatest(p_size, 20, p_partkey % 50)::BIGINT AS a, least(p_size, 20)::BIGINT AS b, (CASE WHEN {NUL} IS NULL THEN NULL ELSE p_size END)::BIGINT AS c, least(p_brand, 'Brand#3') AS d FROM part")
op("F19_nullif", P, "SELECT p_partkey, nullif(p_size, 10) AS a, nullif(p_brand, 'Brand#11') AS b FROM part", "SELECT p_partkey, nullif(p_size, 10)::BIGINT AS a, nullif(p_brand, 'Brand#11') AS b FROM part")
op("F20_quote", P, f"SELECT p_partkey, quote(p_name || '''s') AS a, quote({NUL}) AS b FROM part", f"SELECT p_partkey, '''' || p_name || '''''s''' AS a, coalesce(({NUL})::VARCHAR, 'NULL') AS b FROM part")
op("F21_replace", P, "SELECT p_partkey, replace(p_type, 'STEEL', 'x') AS a, replace(p_type, '', 'x') AS b FROM part", "SELECT p_partkey, replace(p_type, 'STEEL', 'x') AS a, p_type AS b FROM part")
op("F22_round", C, "SELECT c_custkey, round(c_acctbal) AS a, round(c_acctbal, 1) AS b, round(c_custkey, -2) AS c FROM customer", "SELECT c_custkey, round(c_acctbal) AS a, round(c_acctbal, 1) AS b, c_custkey::DOUBLE AS c FROM customer")
op("F23_sign", C, "SELECT c_custkey, sign(c_acctbal) AS a, sign('abc') AS b FROM customer", "SELECT c_custkey, sign(c_acctbal)::BIGINT AS a, NULL::BIGINT AS b FROM customer")
op("F24_substr", P, "SELECT p_partkey, substr(p_name, 2, 3) AS a, substr(p_name, -4) AS b, substr(p_name, 0, 2) AS c, substr(p_name, 3, -2) AS d FROM part", "SELECT p_partkey, substr(p_name, 2, 3) AS a, right(p_name, 4) AS b, left(p_name, 1) AS c, left(p_name, 2) AS d FROM part")
op("F25_unicode", P, "SELECT p_partkey, unicode(p_name) AS a, unicode('€') AS b FROM part", "SELECT p_partkey, unicode(p_name)::BIGINT AS a, 8364::BIGINT AS b FROM part")
op("F26_zeroblob", P, "SELECT p_partkey, hex(zeroblob(p_size % 4)) AS z FROM part", "SELECT p_partkey, repeat('00', p_size % 4) AS z FROM part")
op("F27_iif", P, "SELECT p_partkey, iif(p_size > 25, 'big', 'small') AS a, if(p_size > 25, 1) AS b, iif(p_size > 25, p_size, -0.5) AS c FROM part", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS a, (CASE WHEN p_size > 25 THEN 1 END)::BIGINT AS b, CASE WHEN p_size > 25 THEN p_size::VARCHAR ELSE '-0.5' END AS c FROM part")
op("F30_trigonometry", P, "SELECT p_partkey, " + ", ".join(f"round({f}(p_size / 100.0), 9) AS {f}_" for f in ("sin", "cos", "tan", "asin", "acos", "atan")) + ", asin(p_size + 2) AS n FROM part", "SELECT p_partkey, " + ", ".join(f"round({f}(p_size / 100.0), 9) AS {f}_" for f in ("sin", "cos", "tan", "asin", "acos", "atan")) + ", NULL::DOUBLE AS n FROM part")
op("F31_hyperbolic", P, "SELECT p_partkey, " + ", ".join(f"round({f}(p_size / 100.0{' + 1' if f == 'acosh' else ''}), 9) AS {f}_" for f in ("sinh", "cosh", "tanh", "asinh", "acosh", "atanh")) + " FROM part")
op("F32_atan2", P, "SELECT p_partkey, round(atan2(p_size, 7), 9) AS a FROM part")
op("F33_powers", P, "SELECT p_partkey, round(exp(p_size / 50.0), 9) AS a, round(sqrt(p_size), 9) AS b, pow(p_size, 2) AS c, sqrt(-p_size) AS d FROM part", "SELECT p_partkey, round(exp(p_size / 50.0), 9) AS a, round(sqrt(p_size), 9) AS b, pow(p_size, 2) AS c, NULL::DOUBLE AS d FROM part")
op("F34_ln_log", P, "SELECT p_partkey, round(ln(p_size), 9) AS a, round(log10(p_size), 9) AS b, round(log2(p_size), 9) AS c, ln(-p_size) AS d FROM part", "SELECT p_partkey, round(ln(p_size), 9) AS a, round(log10(p_size), 9) AS b, round(log2(p_size), 9) AS c, NULL::DOUBLE AS d FROM part")
op("F35_log", P, "SELECT p_partkey, round(log(p_size), 9) AS a, round(log(2, p_size), 9) AS b FROM part", "SELECT p_partkey, round(log10(p_size), 9) AS a, round(ln(p_size) / ln(2), 9) AS b FROM part")
op("F36_mod", P, "SELECT p_partkey, mod(p_partkey, 7) AS a, mod(p_size + 0.5, 3) AS b FROM part", "SELECT p_partkey, (p_partkey % 7)::DOUBLE AS a, fmod(p_size + 0.5::DOUBLE, 3) AS b FROM part")
op("F37_rounding", C, "SELECT c_custkey, ceil(c_acctbal) AS a, floor(c_acctbal) AS b, trunc(c_acctbal) AS c, ceiling(c_custkey) AS d FROM customer", "SELECT c_custkey, ceil(c_acctbal) AS a, floor(c_acctbal) AS b, trunc(c_acctbal) AS c, c_custkey AS d FROM customer")
op("F38_pi_degrees", P, "SELECT p_partkey, round(pi(), 9) AS a, round(degrees(p_size), 9) AS b, round(radians(p_size), 9) AS c FROM part")

# Dates
T0 = "strftime(o_orderdate, '%Y-%m-%d')"
O = "orders"
op("F40_date", O, "SELECT o_orderkey, date(o_orderdate) AS a, date('2023-02-29') AS b FROM orders", f"SELECT o_orderkey, {T0} AS a, '2023-03-01' AS b FROM orders")
op("F41_time", "events", "SELECT event_id, time(ts) AS t FROM events", "SELECT event_id, strftime(ts, '%H:%M:%S') AS t FROM events")
op("F42_datetime", "events", "SELECT event_id, datetime(ts) AS t FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events")
op("F43_julianday", O, "SELECT o_orderkey, julianday(o_orderdate) AS j FROM orders", "SELECT o_orderkey, epoch(o_orderdate) / 86400.0 + 2440587.5 AS j FROM orders")
op("F44_unixepoch", "events", "SELECT event_id, unixepoch(ts) AS u FROM events", "SELECT event_id, floor(epoch(ts))::BIGINT AS u FROM events")
op("F45_strftime", O, "SELECT o_orderkey, strftime('%Y/%m/%d %H:%M:%S day %j week %W dow %w %%', o_orderdate) AS s, strftime('%u %V %G', o_orderdate) AS iso FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S day %j week %W dow %w %%') AS s, strftime(o_orderdate, '%u %V %G') AS iso FROM orders")
op("F46_timediff", O, "SELECT o_orderkey, timediff(date(o_orderdate, '+3 days'), date(o_orderdate)) AS d FROM orders", "SELECT o_orderkey, '+0000-00-03 00:00:00.000' AS d FROM orders")
op("F47_time_values", O, "SELECT o_orderkey, datetime(date(o_orderdate) || 'T10:20') AS a, datetime(date(o_orderdate) || ' 23:30:00+02:00') AS b, date(julianday(o_orderdate)) AS c, date('nonsense') AS d FROM orders", f"SELECT o_orderkey, {T0} || ' 10:20:00' AS a, {T0} || ' 21:30:00' AS b, {T0} AS c, NULL::VARCHAR AS d FROM orders")
op("F48_modifiers", O, "SELECT o_orderkey, date(o_orderdate, '+10 days', '-3 hours') AS a, datetime(o_orderdate, '+90 minutes', '+5 seconds') AS b, date(o_orderdate, 'start of month', '+1 month') AS c, date(o_orderdate, '+1 year', 'start of year') AS d, datetime(o_orderdate, '+01:30') AS e FROM orders", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 10 DAY - INTERVAL 3 HOUR, '%Y-%m-%d') AS a, strftime(o_orderdate + INTERVAL 90 MINUTE + INTERVAL 5 SECOND, '%Y-%m-%d %H:%M:%S') AS b, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS c, strftime(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR, '%Y-%m-%d') AS d, strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS e FROM orders")
op("F49_start_of", "events", "SELECT event_id, datetime(ts, 'start of day') AS a, date(ts, 'start of month') AS b, date(ts, 'start of year') AS c, date(ts, 'weekday 0') AS d FROM events", "SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS a, strftime(date_trunc('month', ts), '%Y-%m-%d') AS b, strftime(date_trunc('year', ts), '%Y-%m-%d') AS c, strftime(date_trunc('day', ts) + to_days(((7 - dayofweek(ts)) % 7)::INTEGER), '%Y-%m-%d') AS d FROM events")
op("F50_time_sources", "events", "SELECT event_id, datetime(unixepoch(ts), 'unixepoch') AS a, datetime(julianday(ts), 'julianday') AS b, date(event_id, 'auto') AS c, date('2024-01-31', '+1 month', 'floor') AS d, date('2024-01-31', '+1 month', 'ceiling') AS e FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%Y-%m-%d %H:%M:%S') AS b, CASE WHEN event_id < 0 THEN '' ELSE strftime(TIMESTAMP '1970-01-01' + to_days((event_id - 2440588)::INTEGER) + INTERVAL 12 HOUR, '%Y-%m-%d') END AS c, '2024-02-29' AS d, '2024-03-02' AS e FROM events")
op("F59_real_text", C, "SELECT c_custkey, (c_custkey * 0.5) || '' AS a, (c_custkey * 10000000.0) || '' AS b, (c_custkey * 1e16) || '' AS c FROM customer WHERE c_custkey > 0", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey // 2)::VARCHAR || '.0' ELSE (c_custkey // 2)::VARCHAR || '.5' END AS a, (c_custkey * 10000000)::VARCHAR || '.0' AS b, CASE WHEN rtrim(c_custkey::VARCHAR, '0') = left(c_custkey::VARCHAR, 1) THEN left(c_custkey::VARCHAR, 1) || '.0' ELSE left(c_custkey::VARCHAR, 1) || '.' || substr(rtrim(c_custkey::VARCHAR, '0'), 2) END || 'e+' || (15 + length(c_custkey::VARCHAR))::VARCHAR AS c FROM customer WHERE c_custkey > 0")
