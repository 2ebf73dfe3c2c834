"""queries() and oracle_sql() of the dialect's operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from brindle.plans.lexer import split_script
from brindle.plans.session import Session

from .catalogue import Q
from .changes import ERRORS, SCRIPTS

Query = Callable[[SparkSession, str], DataFrame]


def session(spark: SparkSession, sf_dir: str, tables: str, **options) -> Session:
    s = Session(spark, **options)
    s.register_folder(sf_dir, *tables.split())
    return s


def run_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, text, _ = Q[name]
    return session(spark, sf_dir, tables).sql(text)


def run_script(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statements but the last; then the last's rows. Statements may fail: that is what some are for."""
    tables, text, _ = SCRIPTS[name]
    s = session(spark, sf_dir, tables)
    *before, last = split_script(text)
    for statement in before:
        try:
            s.run(statement)
        except Exception:  # noqa: BLE001  a failing statement leaves nothing behind
            continue
    if last.lstrip().upper().startswith("SELECT"):
        return s.sql(last)
    columns, rows = s.run(last)
    kinds = {"INT": "long", "REAL": "double", "TEXT": "string", "BLOB": "binary", "NULL": "string", "ANY": "string"}
    return spark.createDataFrame(rows, ", ".join(f"`{c.name}` {kinds[c.cls]}" for c in columns))


def run_errors(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, statements = ERRORS[name]
    s = session(spark, sf_dir, tables)
    out = []
    for i, statement in enumerate(statements):
        try:
            s.sql(statement)
            out.append((i, 0))
        except Exception:  # noqa: BLE001
            out.append((i, 1))
    return spark.createDataFrame(out, "i long, failed long")


def s13_read_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database file written from the nation and region tables, read back and joined."""
    from brindle.sources.dbfile import open_database, save_database

    path = os.path.join(tempfile.mkdtemp(), "s13.db")
    s = session(spark, sf_dir, "nation region")
    for statement in split_script("CREATE TABLE n(k INTEGER PRIMARY KEY, name TEXT, r INTEGER); INSERT INTO n SELECT n_nationkey, n_name, n_regionkey FROM nation; CREATE TABLE r(k INTEGER PRIMARY KEY, name TEXT); INSERT INTO r SELECT r_regionkey, r_name FROM region; CREATE VIEW v AS SELECT n.name AS n, r.name AS r FROM n JOIN r ON n.r = r.k"):
        s.run(statement)
    save_database(s, path)
    return open_database(spark, path).sql("SELECT n, r FROM v")


def s14_write_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the customer table in a file, changed there by a second session and saved again."""
    from brindle.sources.dbfile import open_database, save_database

    path = os.path.join(tempfile.mkdtemp(), "s14.db")
    s = session(spark, sf_dir, "customer")
    for statement in ("CREATE TABLE c(k INTEGER PRIMARY KEY, b REAL)", "INSERT INTO c SELECT c_custkey, c_acctbal FROM customer"):
        s.run(statement)
    save_database(s, path)
    t = open_database(spark, path)
    t.run("DELETE FROM c WHERE b < 0")
    save_database(t, path)
    return open_database(spark, path).sql("SELECT k, b FROM c")


def s15_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script's output lines."""
    text = Session(spark).script("CREATE TABLE t(a, b TEXT); INSERT INTO t VALUES (1, 'x'), (2, NULL); SELECT a, b FROM t ORDER BY a; SELECT nope; SELECT 'a;b' -- ; no end\n;")
    return spark.createDataFrame([(i, line.split(":")[0]) for i, line in enumerate(text.splitlines())], "i long, line string")


def s16_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = Session(spark).script("SELECT 1, 1.0, 1e16, 1.5e-7, -0.0, 'x', X'00ff', NULL, 123456789.125, 9e999;")
    return spark.createDataFrame([(i, v) for i, v in enumerate(text.strip().split("|"))], "i long, v string")


def a18_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the dialect: cube over two keys."""
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


def p06_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers of columns that overflow turn into reals, row by row."""
    return session(spark, sf_dir, "part", wide=True).sql("SELECT p_partkey, iif(typeof(p_partkey * 9223372036854775) = 'integer', p_partkey * 9223372036854775, NULL) AS m, typeof(p_partkey * 9223372036854775) AS t, typeof(p_partkey + 9223372036854775000) AS a, typeof(-2 - p_partkey * 1000) AS s FROM part")


def x02_user_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the dialect: a scalar, an aggregate and a table function of the user's."""
    s = session(spark, sf_dir, "part")
    s.create_function("initials", 1, lambda v: v.str.slice(0, 3))
    s.create_aggregate("spread", lambda v: float(v.max() - v.min()))
    s.create_table_function("sizes", "low int, high int", lambda n: ((i, i + 9) for i in range(1, n, 10)), 50)
    return s.sql("SELECT low, initials(p_type) AS i, spread(p_size) AS d, count(*) AS n FROM part JOIN sizes ON p_size BETWEEN low AND high GROUP BY low, initials(p_type)")


def x01_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the dialect: ten-minute windows over the event stream, run as a stream to its end."""
    from brindle.streaming.events import windowed_counts

    return windowed_counts(spark, sf_dir)


SPECIAL: dict[str, tuple[Query, str]] = {
    "S13_read_database_file": (s13_read_file, "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "S14_write_database_file": (s14_write_file, "SELECT c_custkey AS k, c_acctbal AS b FROM customer WHERE c_acctbal >= 0"),
    "S15_script": (s15_script, "SELECT * FROM (VALUES (0::BIGINT, '1|x'), (1, '2|NULL'), (2, 'Error'), (3, 'a;b')) v(i, line)"),
    "S16_formats": (s16_formats, "SELECT * FROM (VALUES (0::BIGINT, '1'), (1, '1.0'), (2, '1.0e+16'), (3, '1.5e-07'), (4, '0.0'), (5, 'x'), (6, 'X''00FF'''), (7, 'NULL'), (8, '123456789.125'), (9, 'Inf')) t(i, v)"),
    "A18_cube": (a18_grouping_sets, "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "P06_overflow": (p06_overflow, "SELECT p_partkey, CASE WHEN p_partkey <= 1000 THEN (p_partkey * 9223372036854775)::VARCHAR ELSE NULL END AS m, CASE WHEN p_partkey <= 1000 THEN 'integer' ELSE 'real' END AS t, CASE WHEN p_partkey <= 807 THEN 'integer' ELSE 'real' END AS a, 'integer' AS s FROM part"),
    "X02_user_functions": (x02_user_functions, "SELECT low::BIGINT AS low, p_type[1:3] AS i, (max(p_size) - min(p_size))::DOUBLE AS d, count(*) AS n FROM part JOIN (SELECT i * 10 + 1 AS low FROM range(5) r(i)) ON p_size BETWEEN low AND low + 9 GROUP BY 1, 2"),
    "X01_event_windows": (x01_event_windows, "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {n: partial(run_query, n) for n in Q}
    out |= {n: partial(run_script, n) for n in SCRIPTS}
    out |= {n: partial(run_errors, n) for n in ERRORS}
    return out | {n: f for n, (f, _) in SPECIAL.items()}


def oracle_sql() -> dict[str, str]:
    out = {n: duck or text for n, (_, text, duck) in Q.items()}
    out |= {n: duck for n, (_, _, duck) in SCRIPTS.items()}
    out |= {n: "SELECT i::BIGINT AS i, 1::BIGINT AS failed FROM range(" + str(len(s)) + ") r(i)" for n, (_, s) in ERRORS.items()}
    return out | {n: sql for n, (_, sql) in SPECIAL.items()}
