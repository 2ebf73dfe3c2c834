"""Operators that change tables or read the catalog: scripts ending in a query."""

from __future__ import annotations

#: name -> (input tables, script, DuckDB SQL of the last statement's rows)
SCRIPTS: dict[str, tuple[str, str, str]] = {
    "S11_view": ("orders", "CREATE VIEW v(k, n) AS SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey; SELECT k, n FROM v WHERE n > 5", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5"),
    "S12_schema_table": ("", "CREATE TABLE a(x INTEGER PRIMARY KEY, y TEXT UNIQUE); CREATE INDEX i ON a(y); CREATE VIEW w AS SELECT x FROM a; SELECT type, name, tbl_name FROM sqlite_schema", "SELECT * FROM (VALUES ('table', 'a', 'a'), ('index', 'sqlite_autoindex_a_1', 'a'), ('index', 'i', 'a'), ('view', 'w', 'w')) v(type, name, tbl_name)"),
    "J15_rowid_join": ("nation", "CREATE TABLE t(n TEXT); INSERT INTO t SELECT n_name FROM nation ORDER BY n_nationkey; SELECT n_name, t.rowid AS r FROM nation JOIN t ON t.rowid = n_nationkey + 1", "SELECT n_name, (n_nationkey + 1)::BIGINT AS r FROM nation"),
    "D01_insert_values": ("", "CREATE TABLE t(a INTEGER, b REAL, c TEXT); INSERT INTO t VALUES (1, 2, 3), ('4', '5.5', 6.5); SELECT a, b, c FROM t", "SELECT * FROM (VALUES (1::BIGINT, 2.0::DOUBLE, '3'), (4::BIGINT, 5.5::DOUBLE, '6.5')) v(a, b, c)"),
    "D02_insert_select": ("customer", "CREATE TABLE t(id INTEGER PRIMARY KEY, n TEXT, b REAL); INSERT INTO t SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 5; SELECT id, n, b FROM t", "SELECT c_custkey AS id, c_name AS n, c_acctbal AS b FROM customer WHERE c_nationkey = 5"),
    "D03_defaults": ("", "CREATE TABLE t(id INTEGER PRIMARY KEY, n TEXT DEFAULT 'x', q INTEGER DEFAULT (2 + 3)); INSERT INTO t DEFAULT VALUES; INSERT INTO t(q) VALUES (9); SELECT id, n, q FROM t", "SELECT * FROM (VALUES (1::BIGINT, 'x', 5::BIGINT), (2, 'x', 9)) v(id, n, q)"),
    "D04_replace": ("nation", "CREATE TABLE t(k INTEGER PRIMARY KEY, n TEXT); INSERT INTO t SELECT n_nationkey, n_name FROM nation; REPLACE INTO t VALUES (3, 'three'), (99, 'new'); SELECT k, n FROM t", "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey = 3 THEN 'three' ELSE n_name END AS n FROM nation UNION ALL SELECT 99, 'new'"),
    "D05_conflict_clauses": ("nation", "CREATE TABLE t(k INTEGER PRIMARY KEY, n TEXT); INSERT INTO t SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10; INSERT OR IGNORE INTO t SELECT n_nationkey, 'again' FROM nation; SELECT k, n FROM t", "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey < 10 THEN n_name ELSE 'again' END AS n FROM nation"),
    "D06_upsert": ("nation", "CREATE TABLE t(r INTEGER PRIMARY KEY, c INTEGER DEFAULT 1, l TEXT); INSERT INTO t(r, l) SELECT n_regionkey, n_name FROM nation WHERE TRUE ORDER BY n_nationkey ON CONFLICT(r) DO UPDATE SET c = c + 1, l = max(l, excluded.l); SELECT r, c, l FROM t", "SELECT n_regionkey::BIGINT AS r, count(*) AS c, max(n_name) AS l FROM nation GROUP BY n_regionkey"),
    "D07_update": ("supplier", "CREATE TABLE t(k INTEGER PRIMARY KEY, b REAL); INSERT INTO t SELECT s_suppkey, s_acctbal FROM supplier; UPDATE t SET b = b * 2, k = k + 1000 WHERE b < 0; UPDATE t SET k = k + 1; SELECT k, b FROM t", "SELECT CASE WHEN s_acctbal < 0 THEN s_suppkey + 1000 ELSE s_suppkey END AS k, CASE WHEN s_acctbal < 0 THEN s_acctbal * 2 ELSE s_acctbal END AS b FROM supplier"),
    "D08_delete": ("supplier nation", "CREATE TABLE t(k INTEGER PRIMARY KEY, n INTEGER); INSERT INTO t SELECT s_suppkey, s_nationkey FROM supplier; DELETE FROM t WHERE n IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2); SELECT k, n FROM t", "SELECT s_suppkey AS k, s_nationkey::BIGINT AS n FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    "D09_returning": ("supplier", "CREATE TABLE t(k INTEGER PRIMARY KEY, b REAL); INSERT INTO t SELECT s_suppkey, s_acctbal FROM supplier; UPDATE t SET b = 0 WHERE b < 0 RETURNING k, b + 1 AS c", "SELECT s_suppkey AS k, 1.0::DOUBLE AS c FROM supplier WHERE s_acctbal < 0"),
    "D10_constraints": ("", "CREATE TABLE t(a INTEGER NOT NULL, b TEXT UNIQUE, CHECK (a > 0)); INSERT INTO t VALUES (1, 'x'); INSERT INTO t VALUES (NULL, 'y'); INSERT INTO t VALUES (-1, 'z'); INSERT INTO t VALUES (2, 'x'); INSERT INTO t VALUES (3, NULL), (4, NULL); SELECT a, b FROM t", "SELECT * FROM (VALUES (1::BIGINT, 'x'), (3, NULL), (4, NULL)) v(a, b)"),
    "D11_constraint_conflicts": ("", "CREATE TABLE t(a INTEGER UNIQUE ON CONFLICT REPLACE, b TEXT); INSERT INTO t VALUES (1, 'x'), (2, 'y'); INSERT INTO t VALUES (1, 'z'); SELECT a, b FROM t", "SELECT * FROM (VALUES (1::BIGINT, 'z'), (2, 'y')) v(a, b)"),
    "D12_rowids": ("", "CREATE TABLE t(id INTEGER PRIMARY KEY AUTOINCREMENT, v TEXT); INSERT INTO t(v) VALUES ('a'), ('b'), ('c'); DELETE FROM t WHERE id = 3; INSERT INTO t(v) VALUES ('d'); SELECT id, v, last_insert_rowid() AS l FROM t", "SELECT * FROM (VALUES (1::BIGINT, 'a', 4::BIGINT), (2, 'b', 4), (4, 'd', 4)) v(id, v, l)"),
    "D13_atomic_statements": ("", "CREATE TABLE t(a INTEGER PRIMARY KEY); INSERT INTO t VALUES (1), (2); INSERT INTO t VALUES (3), (1); UPDATE t SET a = a + 10; SELECT a, changes() AS c, total_changes() AS n FROM t", "SELECT * FROM (VALUES (11::BIGINT, 2::BIGINT, 4::BIGINT), (12, 2, 4)) v(a, c, n)"),
    "D14_create_drop": ("region", "CREATE TABLE a AS SELECT r_regionkey AS k, r_name AS n FROM region; CREATE TABLE IF NOT EXISTS a(x); CREATE TABLE b(x); DROP TABLE b; DROP TABLE IF EXISTS b; SELECT k, n FROM a", "SELECT r_regionkey::BIGINT AS k, r_name AS n FROM region"),
    "D15_unique_index": ("", "CREATE TABLE t(a INTEGER, b TEXT); CREATE UNIQUE INDEX i ON t(lower(b)) WHERE a > 0; INSERT INTO t VALUES (1, 'x'); INSERT INTO t VALUES (2, 'X'); INSERT INTO t VALUES (-1, 'X'); DROP INDEX i; INSERT INTO t VALUES (3, 'x'); SELECT a, b FROM t", "SELECT * FROM (VALUES (1::BIGINT, 'x'), (-1, 'X'), (3, 'x')) v(a, b)"),
    "D16_views": ("nation", "CREATE VIEW v AS SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1; CREATE VIEW w(k) AS SELECT r FROM v WHERE n > 4; DROP VIEW IF EXISTS nothing; SELECT k FROM w", "SELECT n_regionkey::BIGINT AS k FROM nation GROUP BY 1 HAVING count(*) > 4"),
    "D17_alter": ("region", "CREATE TABLE t(a INTEGER, b TEXT); INSERT INTO t SELECT r_regionkey, r_name FROM region; ALTER TABLE t RENAME TO u; ALTER TABLE u RENAME COLUMN a TO k; ALTER TABLE u ADD COLUMN c INTEGER DEFAULT 7; ALTER TABLE u DROP COLUMN b; SELECT k, c FROM u", "SELECT r_regionkey::BIGINT AS k, 7::BIGINT AS c FROM region"),
    "D18_transactions": ("", "CREATE TABLE t(a INTEGER); INSERT INTO t VALUES (1); BEGIN; INSERT INTO t VALUES (2); ROLLBACK; BEGIN; INSERT INTO t VALUES (3); COMMIT; SELECT a FROM t", "SELECT * FROM (VALUES (1::BIGINT), (3)) v(a)"),
    "D19_savepoints": ("", "CREATE TABLE t(a INTEGER); BEGIN; INSERT INTO t VALUES (1); SAVEPOINT s; INSERT INTO t VALUES (2); ROLLBACK TO s; INSERT INTO t VALUES (3); RELEASE s; COMMIT; SELECT a FROM t", "SELECT * FROM (VALUES (1::BIGINT), (3)) v(a)"),
    "D20_rollback_schema": ("", "CREATE TABLE t(a INTEGER); BEGIN; DROP TABLE t; CREATE TABLE u(b); ROLLBACK; INSERT INTO t VALUES (5); SELECT a FROM t", "SELECT 5::BIGINT AS a"),
    "R12_cte_before_changes": ("nation", "CREATE TABLE t(k INTEGER PRIMARY KEY, n TEXT); WITH s AS (SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_regionkey = 1) INSERT INTO t SELECT k, n FROM s; WITH d AS (SELECT 1 AS k UNION SELECT 2) DELETE FROM t WHERE k IN (SELECT k FROM d); SELECT k, n FROM t", "SELECT n_nationkey::BIGINT AS k, n_name AS n FROM nation WHERE n_regionkey = 1 AND n_nationkey NOT IN (1, 2)"),
    "F28_change_counters": ("", "CREATE TABLE t(a INTEGER); INSERT INTO t VALUES (1), (2), (3); DELETE FROM t WHERE a > 1; SELECT changes() AS c, total_changes() AS t, last_insert_rowid() AS l", "SELECT 2::BIGINT AS c, 5::BIGINT AS t, 3::BIGINT AS l"),
    "A06_compensated_sum": ("", "CREATE TABLE t(v REAL); INSERT INTO t VALUES (1e100), (1.0), (-1e100); SELECT sum(v) AS s, total(v) AS t, avg(v) AS a FROM t", "SELECT 1.0::DOUBLE AS s, 1.0::DOUBLE AS t, 1::DOUBLE / 3 AS a"),
}

#: Statements that must fail; the query lists them with whether they did.
ERRORS: dict[str, tuple[str, list[str]]] = {
    "A17_aggregate_misuse": ("part", ["SELECT sum(sum(p_size)) FROM part", "SELECT p_size FROM part WHERE count(*) > 1", "SELECT count(DISTINCT p_size, p_brand) FROM part", "SELECT p_brand FROM part HAVING p_size > 1"]),
    "W23_window_offsets": ("part", ["SELECT ntile(0) OVER (ORDER BY p_size) FROM part", "SELECT nth_value(p_size, 0) OVER (ORDER BY p_size) FROM part", "SELECT sum(p_size) OVER (ORDER BY p_size ROWS -1 PRECEDING) FROM part"]),
    "W24_window_arguments": ("part", ["SELECT count(DISTINCT p_size) OVER () FROM part", "SELECT group_concat(p_name ORDER BY p_size) OVER () FROM part", "SELECT upper(p_name) OVER () FROM part"]),
    "U08_column_counts": ("part", ["SELECT p_size, p_brand FROM part UNION SELECT p_size FROM part", "SELECT 1 EXCEPT SELECT 1, 2"]),
    "R11_recursion_errors": ("", ["WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT max(x) FROM c) SELECT * FROM c", "WITH RECURSIVE c(x) AS (SELECT x FROM c UNION ALL SELECT 1) SELECT * FROM c", "WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT a.x FROM c a, c b) SELECT * FROM c"]),
}
