"""The dialect over Spark: tables, statements, transactions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import formats
from brindle.functions.values import ANY_TYPE, E, affinity, any_of, fits, constant_stored, ident, known_collation, literal, stored, text, truth, value

from . import ast as A
from .errors import DialectError, Unsupported
from .lexer import split_script
from .lower import Lowering, Out, Rel, Scope
from .parser import parse
from .recursive import Recursion

CLASS_OF = {"INTEGER": "INT", "REAL": "REAL", "TEXT": "TEXT", "BLOB": "BLOB", "NUMERIC": "REAL"}
SPARK_OF = {"INT": "BIGINT", "REAL": "DOUBLE", "TEXT": "STRING", "BLOB": "BINARY", "NULL": "STRING", "BOOL": "BIGINT", "ANY": ANY_TYPE}


def input_column(f: T.StructField) -> tuple[str, E]:
    """How the dialect sees a column of a Spark table; \\0 stands for the table's alias."""
    x, t = f"\0.{ident(f.name)}", f.dataType
    if isinstance(t, T.LongType):
        return f.name, E(x, "INT", "INTEGER")
    if isinstance(t, T.IntegralType | T.BooleanType):
        return f.name, E(f"CAST({x} AS BIGINT)", "INT", "INTEGER")
    if isinstance(t, T.DoubleType):
        return f.name, E(x, "REAL", "REAL")
    if isinstance(t, T.FloatType | T.DecimalType):
        return f.name, E(f"CAST({x} AS DOUBLE)", "REAL", "REAL")
    if isinstance(t, T.BinaryType):
        return f.name, E(x, "BLOB", "BLOB")
    if isinstance(t, T.TimestampNTZType | T.TimestampType):
        return f.name, E(f"date_format({x}, 'yyyy-MM-dd HH:mm:ss')", "TEXT", "TEXT", ts=x if isinstance(t, T.TimestampNTZType) else f"CAST({x} AS TIMESTAMP_NTZ)")
    if isinstance(t, T.DateType):
        return f.name, E(f"CAST({x} AS STRING)", "TEXT", "TEXT")
    if isinstance(t, T.StringType):
        return f.name, E(x, "TEXT", "TEXT")
    return f.name, E(f"to_json({x})", "TEXT", "TEXT")


ANY_STRUCT = T.StructType([T.StructField("c", T.ByteType()), T.StructField("d", T.DoubleType()), T.StructField("lo", T.LongType()), T.StructField("t", T.StringType()), T.StructField("b", T.BinaryType()), T.StructField("k", T.ByteType())])


def plain(v):
    """A collected value as a Python value of its class."""
    if isinstance(v, bytearray):
        return bytes(v)
    if isinstance(v, Row):
        return v.t if v.c == 2 else bytes(v.b) if v.c == 3 else int(v.d) + v.lo if v.k == 0 else v.d
    return v


@dataclass
class TableColumn:
    name: str
    declared: str = ""
    aff: str = "BLOB"
    cls: str = "NULL"  # the class of its values; NULL until there is one
    not_null: str | None = None
    default: object | None = None
    collation: str = "BINARY"


@dataclass
class Unique:
    columns: tuple  # expressions
    conflict: str
    name: str
    primary: bool = False
    where: object | None = None


@dataclass
class Table:
    name: str
    columns: list[TableColumn]
    data: DataFrame | None = None  # _rowid_ and c0, c1, ...
    uniques: list[Unique] = field(default_factory=list)
    checks: list = field(default_factory=list)
    rowid_alias: int | None = None
    autoincrement: bool = False
    sequence: int = 0
    sql: str = ""
    view: str = ""  # Spark's name of the data
    rows: int = 0


@dataclass
class Catalog:
    tables: dict = field(default_factory=dict)
    views: dict = field(default_factory=dict)  # name -> (name, columns, query, sql)
    indexes: dict = field(default_factory=dict)  # name -> (name, table, unique, keys, where, sql)
    inputs: dict = field(default_factory=dict)  # Spark tables, read only

    def copy(self) -> Catalog:
        """Tables are replaced as a whole when they change, so a snapshot is a copy of the dictionaries."""
        return Catalog(dict(self.tables), dict(self.views), dict(self.indexes), dict(self.inputs))


class Session:
    """Runs statements of the dialect. Queries over input tables stay lazy DataFrames; DML makes new table versions.

    Integer arithmetic on columns is 64-bit and in generated code; where it overflows, run() lowers the statement once
    more with results that may be integers or reals by row. ``wide`` lowers so from the start, for lazy frames.
    """

    def __init__(self, spark: SparkSession, wide: bool = False):
        self.spark, self.wide = spark, wide
        formats.register(spark)
        self.functions: dict = {}  # of the user: name -> what lowers a call
        self.aggregates: dict = {}  # name -> (Spark's name, class)
        self.catalog = Catalog()
        self.saved: Catalog | None = None  # at BEGIN
        self.savepoints: list[tuple[str, Catalog]] = []
        self.implicit = False
        self.counters = {"changes": 0, "total_changes": 0, "last_insert_rowid": 0}
        self.dirty = False
        self.holding: list[DataFrame] = []

    # Inputs

    def register(self, name: str, df: DataFrame) -> None:
        """An input table, read only."""
        view = f"brindle_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        self.catalog.inputs[name.lower()] = (name, view, [input_column(f) for f in df.schema.fields])

    def register_folder(self, sf_dir: str, *names: str) -> None:
        for n in names:
            self.register(n, self.spark.read.parquet(f"{sf_dir}/{n}.parquet"))

    # Functions

    def create_function(self, name: str, arguments: int, function, returns: str = "TEXT") -> None:
        """A scalar function of the user's, over Arrow batches: ``function`` gets pandas Series and returns one.

        Values come as their text, number or bytes; one whose class varies by row comes as text. ``returns`` is INT, REAL,
        TEXT or BLOB.
        """
        from pyspark.sql.functions import pandas_udf

        spark_name = f"brindle_{uuid.uuid4().hex}"
        self.spark.udf.register(spark_name, pandas_udf(function, SPARK_OF[returns].lower()))

        def call(args: list[E]) -> E:
            if arguments >= 0 and len(args) != arguments:
                raise DialectError(f"wrong number of arguments to function {name}()")
            return E(f"{spark_name}({', '.join(text(a) if a.cls == 'ANY' else value(a).sql for a in args)})", returns)

        self.functions[name.lower()] = call

    def create_aggregate(self, name: str, function, returns: str = "REAL") -> None:
        """An aggregate of the user's over one value: ``function`` gets a group's values, without NULLs, as a pandas Series.

        A group without values gives NULL. A group's values come together in one row, so it is for groups that fit there;
        built-in aggregates are reduced first.
        """
        import pandas as pd
        from pyspark.sql.functions import pandas_udf

        spark_name = f"brindle_{uuid.uuid4().hex}"

        def rows(groups: pd.Series) -> pd.Series:
            return pd.Series([function(pd.Series(v)) if len(v) else None for v in groups], dtype=object)

        rows.__annotations__ = {"groups": pd.Series, "return": pd.Series}
        self.spark.udf.register(spark_name, pandas_udf(rows, SPARK_OF[returns].lower()))
        self.aggregates[name.lower()] = (spark_name, returns)

    def create_table_function(self, name: str, columns: str, function, *arguments) -> None:
        """The rows that ``function(*arguments)`` yields, of ``columns`` (names and Spark types), as an input table."""
        from pyspark.sql.functions import udtf

        class Rows:
            def eval(self, *given):
                yield from function(*given)

        self.register(name, udtf(Rows, returnType=columns)(*[F.lit(a) for a in arguments]))

    # Names

    def lookup(self, name: str, lowering: Lowering):
        low = name.lower()
        c = self.catalog
        if low in c.tables:
            return self.table_source(c.tables[low])
        if low in c.views:
            _, names, query, _ = c.views[low]
            rel = lowering.query(query, None)
            outs = lowering.renamed(rel.columns, names, name)
            return f"({rel.sql})", [(o.name, E(f"\0.k{i}", o.cls, o.aff, o.coll)) for i, o in enumerate(outs)]
        if low in c.inputs:
            _, view, columns = c.inputs[low]
            return view, columns
        if low in ("sqlite_schema", "sqlite_master"):
            return self.schema_source()
        if low == "sqlite_sequence" and any(t.autoincrement for t in c.tables.values()):
            rows = [f"('{t.name}', {t.sequence}L)" for t in c.tables.values() if t.autoincrement and t.sequence]
            sql = f"(SELECT * FROM VALUES {', '.join(rows)} AS v(name, seq))" if rows else "(SELECT '' AS name, 0L AS seq WHERE FALSE)"
            return sql, [("name", E("\0.name", "TEXT")), ("seq", E("\0.seq", "INT"))]
        return None

    def table_source(self, t: Table):
        columns = []
        for i, c in enumerate(t.columns):
            sql = "\0._rowid_" if i == t.rowid_alias else f"\0.c{i}"
            columns.append((c.name, E(sql, c.cls, c.aff if c.aff != "BLOB" else None, c.collation)))
        columns.append(("_rowid_", E("\0._rowid_", "INT", "INTEGER")))
        return t.view, columns

    def schema_rows(self) -> list[tuple]:
        c, out = self.catalog, []
        for t in c.tables.values():
            out.append(("table", t.name, t.name, t.sql))
            n = 0
            for u in t.uniques:
                if u.name.startswith("sqlite_autoindex_"):
                    n += 1
                    out.append(("index", u.name, t.name, None))
        if any(t.autoincrement for t in c.tables.values()):
            out.append(("table", "sqlite_sequence", "sqlite_sequence", "CREATE TABLE sqlite_sequence(name,seq)"))
        out += [("index", i[0], i[1], i[5]) for i in c.indexes.values()]
        return out + [("view", v[0], v[0], v[3]) for v in c.views.values()]

    def schema_source(self):
        names = ("type", "name", "tbl_name", "sql")
        rows = self.schema_rows()
        view = f"brindle_{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, "type string, name string, tbl_name string, sql string").createOrReplaceTempView(view)
        return view, [(n, E(f"\0.{n}", "TEXT")) for n in names] + [("rootpage", E("CAST(0 AS BIGINT)", "INT"))]

    # Queries

    def lowering(self) -> Lowering:
        return Lowering(self.lookup, self.counters, Recursion(self.spark), self.evaluate, self.wide, self.functions, self.aggregates)

    def evaluate(self, sql: str):
        """A constant expression's value, for limits and frames that aren't literals."""
        return self.spark.sql(f"SELECT {sql} AS v").first()[0]

    def lower(self, text: str) -> Rel:
        q = parse(text)
        if not isinstance(q, A.Query):
            raise DialectError("not a query")
        return self.lowering().query(q)

    def sql(self, text: str) -> DataFrame:
        """The rows of a query as a lazy DataFrame; column names are the dialect's."""
        return self.frame(self.lower(text))

    def frame(self, rel: Rel) -> DataFrame:
        """Columns of one class as they are; one whose class varies by row as text, as a script prints it (blobs as X'..')."""
        df = self.spark.sql(rel.sql).toDF(*[f"k{i}" for i in range(len(rel.columns))])
        shown = [F.expr(f"CASE WHEN k{i}.c = 3 THEN concat('X\\'', hex(k{i}.b), '\\'') ELSE {text(E(f'k{i}', 'ANY'))} END").alias(f"k{i}") if o.cls == "ANY" else F.col(f"k{i}") for i, o in enumerate(rel.columns)]
        return df.select(*shown).toDF(*[o.name for o in rel.columns])

    # Statements

    def run(self, text: str) -> tuple[list[Out], list[tuple]] | None:
        """Run one statement; (columns, rows) if it returns rows. A failing statement leaves nothing behind."""
        s = parse(text)
        try:
            return self._run(s)
        except Exception as e:
            if self.wide or "ARITHMETIC_OVERFLOW" not in str(e):
                raise
            self.wide = True
            try:
                return self._run(s)
            finally:
                self.wide = False

    def held(self, df: DataFrame) -> DataFrame:
        """Rows that a statement reads several times, until the next one begins."""
        self.holding.append(df.cache())
        return self.holding[-1]

    def _run(self, s):
        while self.holding:
            self.holding.pop().unpersist()
        if isinstance(s, A.Query):
            rel = self.lowering().query(s)
            return rel.columns, self.collect(rel)
        before, counters = self.catalog.copy(), dict(self.counters)
        try:
            return getattr(self, "do_" + s.kind.replace(" ", "_"))(s)
        except Exception:
            if s.kind not in ("begin", "commit", "rollback", "savepoint", "release") and not getattr(self, "keep", False):
                self.catalog, self.counters = before, counters
            raise
        finally:
            self.keep = False

    def collect(self, rel: Rel) -> list[tuple]:
        return [tuple(plain(v) for v in r) for r in self.spark.sql(rel.sql).collect()]

    def script(self, text: str) -> str:
        """Run a script and render its rows: values joined by |, and a line for each error."""
        from .render import line

        out = []
        for statement in split_script(text):
            try:
                got = self.run(statement)
                if got is not None:
                    out += [line(r) for r in got[1]]
            except Exception as e:  # noqa: BLE001  a failing statement doesn't stop the script
                first = (str(e).splitlines() or [""])[0]
                out.append(f"Error: {first}")
        if self.saved is not None:
            self.catalog, self.saved, self.savepoints = self.saved, None, []
        return "".join(x + "\n" for x in out)

    # Transactions

    def do_begin(self, s):
        if self.saved is not None:
            raise DialectError("cannot start a transaction within a transaction")
        self.saved, self.implicit = self.catalog.copy(), False

    def do_commit(self, s):
        if self.saved is None:
            raise DialectError("cannot commit - no transaction is active")
        self.saved, self.savepoints = None, []

    def do_rollback(self, s):
        if s.to is not None:
            i = self.point(s.to)
            self.catalog = self.savepoints[i][1].copy()
            del self.savepoints[i + 1 :]
            return
        if self.saved is None:
            raise DialectError("cannot rollback - no transaction is active")
        self.catalog, self.saved, self.savepoints = self.saved, None, []

    def point(self, name: str) -> int:
        for i in range(len(self.savepoints) - 1, -1, -1):
            if self.savepoints[i][0].lower() == name.lower():
                return i
        raise DialectError(f"no such savepoint: {name}")

    def do_savepoint(self, s):
        if self.saved is None:
            self.saved, self.implicit = self.catalog.copy(), True
        self.savepoints.append((s.name, self.catalog.copy()))

    def do_release(self, s):
        i = self.point(s.name)
        del self.savepoints[i:]
        if not self.savepoints and self.implicit:
            self.saved = None

    # Definitions

    def taken(self, name: str) -> str | None:
        low, c = name.lower(), self.catalog
        return "table" if low in c.tables or low in c.inputs else "view" if low in c.views else "index" if low in c.indexes else None

    def do_create_table(self, s):
        if kind := self.taken(s.name):
            if s.quiet and kind != "index":
                return
            raise DialectError(f"{kind} {s.name} already exists")
        if s.name.lower().startswith("sqlite_"):
            raise DialectError(f"object name reserved for internal use: {s.name}")
        if s.query is not None:
            rel = self.lowering().query(s.query)
            columns = [TableColumn(o.name, {"INTEGER": "INT", "REAL": "REAL", "TEXT": "TEXT", "NUMERIC": "NUM"}.get(o.aff, ""), o.aff or "BLOB", o.cls) for o in rel.columns]
            seen: dict[str, int] = {}
            for c in columns:
                n = seen.get(c.name.lower(), 0)
                seen[c.name.lower()] = n + 1
                if n:
                    c.name = f"{c.name}:{n}"
            t = Table(s.name, columns, sql=f'CREATE TABLE {s.name}({",".join(f"{c.name} {c.declared}".strip() for c in columns)})')
            data = self.spark.sql(rel.sql)
            data = self.numbered(data, 0).select("_rowid_", *[F.col(f"k{i}").alias(f"c{i}") for i in range(len(columns))])
            self.put(t, data)
            self.dirty = True
            return
        columns, uniques, checks, alias, auto = [], [], [], None, False
        for i, d in enumerate(s.columns):
            if any(c.name.lower() == d.name.lower() for c in columns):
                raise DialectError(f"duplicate column name: {d.name}")
            aff = affinity(d.type)
            columns.append(TableColumn(d.name, d.type, aff, CLASS_OF[aff] if aff not in ("BLOB", "NUMERIC") else "NULL", d.not_null, d.default, known_collation(d.collation)))
            checks += d.checks
            for names, conflict, primary in d.uniques:
                if primary and d.type.upper() == "INTEGER":
                    alias, auto = i, d.autoincrement
                elif primary and d.autoincrement:
                    raise DialectError("AUTOINCREMENT is only allowed on an INTEGER PRIMARY KEY")
                else:
                    uniques.append((names, conflict, primary))
        for c in s.constraints:
            if c[0] == "check":
                checks.append(c[1])
            elif c[0] == "unique":
                _, names, conflict, primary, inner_auto = c
                at = [k for k, d in enumerate(columns) if d.name.lower() == names[0].lower()]
                if primary and len(names) == 1 and at and columns[at[0]].declared.upper() == "INTEGER":
                    alias, auto = at[0], inner_auto
                else:
                    uniques.append((names, conflict, primary))
        if sum(1 for d in s.columns if d.primary_key) + sum(1 for c in s.constraints if c[0] == "unique" and c[3]) > 1:
            raise DialectError(f'table "{s.name}" has more than one primary key')
        t = Table(s.name, columns, rowid_alias=alias, autoincrement=auto, checks=checks, sql=s.sql)
        for names, conflict, primary in uniques:
            for n in names:
                self.column_index(t, n)
            key = tuple(n.lower() for n in names)
            if not any(tuple(x.column.lower() for x in u.columns) == key for u in t.uniques):
                t.uniques.append(Unique(tuple(A.Name(None, n) for n in names), conflict, f"sqlite_autoindex_{s.name}_{len(t.uniques) + 1}", primary))
        self.put(t, None)
        self.dirty = True

    @staticmethod
    def column_index(t: Table, name: str) -> int:
        for i, c in enumerate(t.columns):
            if c.name.lower() == name.lower():
                return i
        raise DialectError(f"no such column: {name}")

    def put(self, t: Table, data: DataFrame | None) -> None:
        """A table's new version: written out or, if small, held as local rows, so that lineage doesn't grow."""
        schema = T.StructType([T.StructField("_rowid_", T.LongType())] + [T.StructField(f"c{i}", {"INT": T.LongType(), "REAL": T.DoubleType(), "TEXT": T.StringType(), "BLOB": T.BinaryType(), "ANY": ANY_STRUCT}.get(c.cls, T.StringType())) for i, c in enumerate(t.columns)])
        if data is None:
            data, t.rows = self.spark.createDataFrame([], schema), 0
        else:
            data, t.rows = self.kept(data, schema)
        t.data, t.view = data, f"brindle_{uuid.uuid4().hex}"
        data.createOrReplaceTempView(t.view)
        self.catalog.tables[t.name.lower()] = t

    def kept(self, data: DataFrame, schema: T.StructType) -> tuple[DataFrame, int]:
        """The rows as a table of their own, and how many. The plan runs once: it is written where it may be large."""
        known = data._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        if int(str(known)) <= LOCAL_BYTES:
            head = data.limit(LOCAL_ROWS + 1).collect()
            if len(head) <= LOCAL_ROWS:
                return self.spark.createDataFrame(sorted((tuple(r) for r in head), key=lambda r: r[0]), schema), len(head)
        base = self.spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
        path = f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"
        data.write.parquet(path)
        data = self.spark.read.schema(data.schema).parquet(path)
        return data, data.count()

    def do_create_view(self, s):
        if kind := self.taken(s.name):
            if s.quiet and kind != "index":
                return
            raise DialectError(f"{kind} {s.name} already exists")
        self.catalog.views[s.name.lower()] = (s.name, s.columns, s.query, s.sql)
        self.dirty = True

    def do_create_index(self, s):
        if kind := self.taken(s.name):
            if s.quiet and kind == "index":
                return
            raise DialectError(f"{'there is already a' if kind != 'index' else 'index'} {kind if kind != 'index' else s.name} {'named ' + s.name if kind != 'index' else 'already exists'}")
        t = self.writable(s.table)
        if s.unique:
            u = Unique(s.keys, "ABORT", s.name, where=s.where)
            self.check_unique(t, u, t.data)
            t = self.changed(t)
            t.uniques.append(u)
            self.catalog.tables[t.name.lower()] = t
        else:
            for k in s.keys:
                self.lowering().expr(k, self.row_scope(t, "t"))
        self.catalog.indexes[s.name.lower()] = (s.name, t.name, s.unique, s.keys, s.where, s.sql)
        self.dirty = True

    def changed(self, t: Table) -> Table:
        return replace(t, columns=[replace(c) for c in t.columns], uniques=list(t.uniques), checks=list(t.checks))

    def do_drop(self, s):
        low, c = s.name.lower(), self.catalog
        home = {"table": c.tables, "view": c.views, "index": c.indexes}[s.object]
        if low not in home:
            if s.quiet:
                return
            raise DialectError(f"no such {s.object}: {s.name}")
        gone = home.pop(low)
        if s.object == "table":
            c.indexes = {k: v for k, v in c.indexes.items() if v[1].lower() != low}
        if s.object == "index" and gone[1].lower() in c.tables:
            t = self.changed(c.tables[gone[1].lower()])
            t.uniques = [u for u in t.uniques if u.name.lower() != low]
            c.tables[t.name.lower()] = t
        self.dirty = True

    def do_alter(self, s):
        t = self.changed(self.writable(s.table))
        c = self.catalog
        if s.action == "rename":
            if self.taken(s.to):
                raise DialectError(f"there is already another table or index with this name: {s.to}")
            del c.tables[t.name.lower()]
            old, t.name = t.name, s.to
            for u in t.uniques:
                u_name = u.name.replace(f"sqlite_autoindex_{old}_", f"sqlite_autoindex_{s.to}_")
                t.uniques[t.uniques.index(u)] = replace(u, name=u_name)
            c.tables[s.to.lower()] = t
            c.indexes = {k: (v[0], s.to, *v[2:]) if v[1].lower() == old.lower() else v for k, v in c.indexes.items()}
            c.views = {k: (v[0], v[1], rename_table(v[2], old, s.to), v[3]) for k, v in c.views.items()}
        elif s.action == "rename column":
            i = self.column_index(t, s.column)
            if any(x.name.lower() == s.to.lower() and k != i for k, x in enumerate(t.columns)):
                raise DialectError(f"duplicate column name: {s.to}")
            old, t.columns[i].name = t.columns[i].name, s.to
            t.checks = [rename_column(x, old, s.to) for x in t.checks]
            t.uniques = [replace(u, columns=tuple(rename_column(x, old, s.to) for x in u.columns), where=rename_column(u.where, old, s.to)) for u in t.uniques]
            c.tables[t.name.lower()] = t
            c.indexes = {k: (*v[:3], tuple(rename_column(x, old, s.to) for x in v[3]), rename_column(v[4], old, s.to), v[5]) if v[1].lower() == t.name.lower() else v for k, v in c.indexes.items()}
            c.views = {k: (v[0], v[1], rename_column(v[2], old, s.to), v[3]) for k, v in c.views.items()}
        elif s.action == "add":
            d = s.column
            if any(x.name.lower() == d.name.lower() for x in t.columns):
                raise DialectError(f"duplicate column name: {d.name}")
            if d.primary_key or any(not p for _, _, p in d.uniques):
                raise DialectError("Cannot add a PRIMARY KEY or UNIQUE column")
            if d.not_null and t.rows and (d.default is None or d.default == A.Lit(None)):
                raise DialectError("Cannot add a NOT NULL column with default value NULL")
            aff = affinity(d.type)
            col = TableColumn(d.name, d.type, aff, CLASS_OF[aff] if aff not in ("BLOB", "NUMERIC") else "NULL", d.not_null, d.default, known_collation(d.collation))
            e = self.lowering().expr(d.default, Scope()) if d.default is not None else literal(None)
            if col.cls == "NULL" and e.cls != "NULL":
                col.cls = "INT" if e.cls == "BOOL" else e.cls
            t.columns.append(col)
            t.checks += d.checks
            self.put(t, t.data.withColumn(f"c{len(t.columns) - 1}", F.expr(stored(e, aff, col.cls))))
        else:
            i = self.column_index(t, s.column)
            if len(t.columns) == 1:
                raise DialectError(f'cannot drop column "{s.column}": no other columns exist')
            if i == t.rowid_alias or any(u.primary and any(x.column.lower() == s.column.lower() for x in u.columns) for u in t.uniques if all(isinstance(x, A.Name) for x in u.columns)):
                raise DialectError(f'cannot drop PRIMARY KEY column: "{s.column}"')
            low = self.lowering()
            used = [n.column.lower() for x in [*t.checks, *(e for u in t.uniques for e in u.columns), *(e for v in c.indexes.values() if v[1].lower() == t.name.lower() for e in (*v[3], *((v[4],) if v[4] is not None else ())))] for n in low.names(x)]
            if s.column.lower() in used:
                raise DialectError(f'error in table {t.name} after drop column: no such column: {s.column}')
            keep = [k for k in range(len(t.columns)) if k != i]
            data = t.data.select("_rowid_", *[F.col(f"c{k}").alias(f"c{n}") for n, k in enumerate(keep)])
            t.columns = [t.columns[k] for k in keep]
            if t.rowid_alias is not None and t.rowid_alias > i:
                t.rowid_alias -= 1
            self.put(t, data)
        self.dirty = True

    # Changes of data

    def writable(self, name: str) -> Table:
        low = name.lower()
        if low in self.catalog.tables:
            return self.catalog.tables[low]
        if low in self.catalog.views:
            raise DialectError(f"cannot modify {name} because it is a view")
        if low in self.catalog.inputs:
            raise DialectError(f"table {name} may not be modified")
        raise DialectError(f"no such table: {name}")

    def numbered(self, df: DataFrame, base: int) -> DataFrame:
        """Rows with _rowid_ from base + 1 on, in their order."""
        return counted(self.settled(df.withColumn("_order_", F.monotonically_increasing_id())), "_rowid_", base).drop("_order_")

    def row_scope(self, t: Table, alias: str, extra: list | None = None, ctes: dict | None = None) -> Scope:
        from .lower import Column

        columns = []
        for i, c in enumerate(t.columns):
            sql = f"{alias}._rowid_" if i == t.rowid_alias else f"{alias}.c{i}"
            columns.append(Column(c.name, E(sql, c.cls, c.aff if c.aff != "BLOB" else None, c.collation), t.name))
        columns.append(Column("_rowid_", E(f"{alias}._rowid_", "INT", "INTEGER"), t.name, hidden=True))
        return Scope(columns + (extra or []), ctes=ctes or {})

    def widen(self, t: Table, i: int, e: E) -> None:
        """A column without a class yet takes that of its first values; one that can't hold a value becomes ANY."""
        c = t.columns[i]
        cls = constant_stored(e, c.aff).cls
        cls = "INT" if cls == "BOOL" else cls
        if c.cls != "NULL" and not fits(e, c.aff, c.cls):
            if t.data is not None:
                t.data = t.data.withColumn(f"c{i}", F.expr(any_of(E(f"c{i}", c.cls))))
            c.cls = "ANY"
            return
        if c.cls == "NULL" and cls != "NULL":
            c.cls = cls
            if t.data is not None:
                t.data = t.data.withColumn(f"c{i}", F.expr(f"CAST(NULL AS {SPARK_OF[cls]})"))

    def scope_of(self, s) -> tuple[Lowering, Scope]:
        low = self.lowering()
        scope = Scope()
        for c in s.ctes:
            low.declare(c, scope, s.recursive)
        return low, scope

    def do_insert(self, s):
        old = self.writable(s.table)
        t = self.changed(old)
        low, with_scope = self.scope_of(s)
        names = s.columns
        if s.query is None and names is not None:
            raise DialectError(f"0 values for {len(names)} columns")
        targets = [self.target(t, n) for n in names] if names is not None else list(range(len(t.columns)))
        if s.query is not None:
            rel = self.given_rows(low, t, targets, s, with_scope) or low.query(s.query, with_scope)
            if len(rel.columns) != len(targets):
                raise DialectError(f"{len(rel.columns)} values for {len(targets)} columns" if names is not None else f"table {t.name} has {len(t.columns)} columns but {len(rel.columns)} values were supplied")
            src = self.spark.sql(rel.sql)
        else:
            rel, targets = Rel("", []), []
            src = self.spark.range(1).select()
        for i, o in zip(targets, rel.columns, strict=True):
            if i >= 0 and i != t.rowid_alias:
                self.widen(t, i, E("x", o.cls, o.aff))
        given = {i: E(f"src.k{k}", o.cls, o.aff) for k, (i, o) in enumerate(zip(targets, rel.columns, strict=True))}
        src = src.withColumn("_order_", F.monotonically_increasing_id()).alias("src")
        rid = given.get(t.rowid_alias if t.rowid_alias is not None else -1) or given.get(-1)
        columns = [F.col("_order_"), F.expr(stored(replace(rid, aff=None), "INTEGER", "INT") if rid else "CAST(NULL AS BIGINT)").alias("_given_")]
        for i, c in enumerate(t.columns):
            if i == t.rowid_alias:
                columns.append(F.lit(None).cast("string" if c.cls == "NULL" else "long").alias(f"c{i}"))
                continue
            e = given.get(i)
            if e is None:
                e = low.expr(c.default, Scope()) if c.default is not None else literal(None)
                self.widen(t, i, e)
            columns.append(F.expr(stored(e, c.aff, c.cls)).alias(f"c{i}"))
        # Rows are numbered once: a plan that runs again may number them in another order.
        rows = self.place_rowids(t, self.settled(src.select(*columns)))
        self.apply_insert(t, rows, s, with_scope)
        return self.returned(t, s, with_scope)

    def given_rows(self, low: Lowering, t: Table, targets: list[int], s, with_scope: Scope) -> Rel | None:
        """VALUES rows, each value by its column's affinity, so that rows may give one column several classes."""
        q = s.query
        if not isinstance(q.body, A.Values) or q.limit is not None or len(q.body.rows[0]) != len(targets):
            return None
        rows = [[low.expr(x, Scope(ctes=with_scope.ctes)) for x in r] for r in q.body.rows]
        kinds = []
        for k, i in enumerate(targets):
            if i < 0 or i == t.rowid_alias:
                kinds.append(("INTEGER", "INT"))
                continue
            for r in rows:
                self.widen(t, i, r[k])
            kinds.append((t.columns[i].aff, t.columns[i].cls))
        sqls = [[stored(e, aff, cls) for e, (aff, cls) in zip(r, kinds, strict=True)] for r in rows]
        outs = [Out(f"column{k + 1}", cls) for k, (_, cls) in enumerate(kinds)]
        if all(e.is_const for r in rows for e in r) and all(cls != "ANY" for _, cls in kinds):
            return Rel(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(r) + ')' for r in sqls)} AS v({', '.join(f'k{k}' for k in range(len(outs)))})", outs)
        return Rel(" UNION ALL ".join(f"(SELECT {', '.join(f'{x} AS k{k}' for k, x in enumerate(r))})" for r in sqls), outs)

    def settled(self, df: DataFrame) -> DataFrame:
        """The rows without their lineage."""
        return Recursion(self.spark).cut(df)[0]

    def target(self, t: Table, name: str) -> int:
        if name.lower() in ("rowid", "oid", "_rowid_") and not any(c.name.lower() == name.lower() for c in t.columns):
            return t.rowid_alias if t.rowid_alias is not None else -1
        try:
            return self.column_index(t, name)
        except DialectError:
            raise DialectError(f"table {t.name} has no column named {name}") from None

    def place_rowids(self, t: Table, rows: DataFrame) -> DataFrame:
        """Rowids: as given, else one more than the largest before."""
        from pyspark.sql import Window

        top = t.data.agg(F.max("_rowid_")).first()[0] or 0
        if t.autoincrement:
            top = max(top, t.sequence)
        if top >= 2**63 - 1:
            raise DialectError("database or disk is full")
        given, rest = rows.agg(F.count("_given_"), F.count_if(F.col("_given_").isNull())).first()
        if not rest:
            return rows.withColumn("_rowid_", F.col("_given_"))
        if not given:
            return counted(rows, "_rowid_", top)
        # Between given ids, others count on from the largest so far. Rows of a part of the order are looked at together,
        # after what the parts before have brought.
        rows = rows.withColumn("_part_", F.shiftright("_order_", 33))
        largest = rows.groupBy("_part_").agg(F.max("_given_").alias("_most_"))
        largest = largest.select("_part_", F.max("_most_").over(Window.orderBy("_part_").rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier_"))
        rows = rows.join(largest, "_part_")
        w = Window.partitionBy("_part_").orderBy("_order_").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_seen_", F.greatest(F.lit(top), F.coalesce("_earlier_", F.lit(top)), F.coalesce(F.max("_given_").over(w), F.lit(top))))
        # Of the rows since the same largest id: those of earlier parts, then those before in the same part.
        here = F.count(F.when(F.col("_given_").isNull(), 1)).over(Window.partitionBy("_seen_", "_part_").orderBy("_order_"))
        sums = rows.groupBy("_seen_", "_part_").agg(F.count_if(F.col("_given_").isNull()).alias("_n_"))
        sums = sums.select("_seen_", "_part_", F.coalesce(F.sum("_n_").over(Window.partitionBy("_seen_").orderBy("_part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base_"))
        rows = rows.withColumn("_nth_", here).join(sums, ["_seen_", "_part_"])
        return rows.withColumn("_rowid_", F.coalesce("_given_", F.col("_seen_") + F.col("_base_") + F.col("_nth_"))).drop("_seen_", "_nth_", "_base_", "_part_", "_earlier_")

    def keys(self, t: Table, u: Unique) -> tuple[list[str], str | None]:
        """SQL of a unique key over a row of alias x, and the condition under which it holds."""
        from brindle.functions.values import key

        low, scope = self.lowering(), self.row_scope(t, "x")
        sqls = [key(low.expr(e, scope)) for e in u.columns]
        return sqls, truth(low.expr(u.where, scope)) if u.where is not None else None

    def key_frame(self, t: Table, u: Unique | None, df: DataFrame) -> DataFrame:
        """Rows that take part in a unique key, with q0, q1, ..."""
        x = df.alias("x")
        if u is None:
            return x.withColumn("q0", F.col("_rowid_"))
        sqls, cond = self.keys(t, u)
        for i, s in enumerate(sqls):
            x = x.withColumn(f"q{i}", F.expr(s))
        x = x.filter(" AND ".join(f"q{i} IS NOT NULL" for i in range(len(sqls))))
        return x.filter(F.expr(cond)) if cond else x

    def check_unique(self, t: Table, u: Unique, df: DataFrame) -> None:
        n = len(u.columns)
        if self.key_frame(t, u, df).groupBy(*[f"q{i}" for i in range(n)]).count().filter("count > 1").limit(1).count():
            names = ", ".join(f"{t.name}.{x.column}" if isinstance(x, A.Name) else "expression" for x in u.columns)
            raise DialectError(f"UNIQUE constraint failed: {names}")

    def validate(self, t: Table, rows: DataFrame, conflict: str | None) -> DataFrame:
        """NOT NULL and CHECK of new or changed rows; with IGNORE failing rows go, with REPLACE nulls become defaults."""
        low = self.lowering()
        for i, c in enumerate(t.columns):
            if c.not_null and i != t.rowid_alias:
                rule = conflict or c.not_null
                if rule == "IGNORE":
                    rows = rows.filter(F.col(f"c{i}").isNotNull())
                    continue
                if rule == "REPLACE" and c.default is not None:
                    rows = rows.withColumn(f"c{i}", F.coalesce(f"c{i}", F.expr(stored(low.expr(c.default, Scope()), c.aff, c.cls))))
                if rows.filter(F.col(f"c{i}").isNull()).limit(1).count():
                    raise DialectError(f"NOT NULL constraint failed: {t.name}.{c.name}")
        for e in t.checks:
            ok = F.coalesce(F.expr(truth(low.expr(e, self.row_scope(t, "x")))), F.lit(True))
            x = rows.alias("x")
            if conflict == "IGNORE":
                rows = x.filter(ok)
            elif x.filter(~ok).limit(1).count():
                raise DialectError(f"CHECK constraint failed: {t.name}")
        return rows

    def apply_insert(self, t: Table, rows: DataFrame, s, with_scope: Scope) -> None:
        from pyspark.sql import Window

        names = ["_rowid_"] + [f"c{i}" for i in range(len(t.columns))]
        rows = self.validate(t, rows, s.conflict)
        data, count = t.data, None
        constraints = [(None, s.conflict or "ABORT")] + [(u, s.conflict or u.conflict) for u in t.uniques]
        handlers = {self.upsert_target(t, up): up for up in s.upserts}
        updated = None
        for u, rule in constraints:
            n = 1 if u is None else len(u.columns)
            q = [f"q{i}" for i in range(n)]
            up = handlers.get(u.name if u is not None else "rowid", handlers.get(None))
            new = self.key_frame(t, u, rows)
            if up is not None and up[2] is None:
                rule = "IGNORE"
            if up is not None and up[2] is not None:
                data, rows, touched = self.upsert(t, u, data, rows, up, with_scope)
                updated = touched if updated is None else updated.unionByName(touched)
                continue
            if rule in ("ABORT", "FAIL", "ROLLBACK"):
                both = self.key_frame(t, u, data).select(*q).unionByName(new.select(*q))
                if both.groupBy(*q).count().filter("count > 1").limit(1).count():
                    if rule == "ROLLBACK" and self.saved is not None:
                        self.catalog, self.saved, self.savepoints = self.saved, None, []
                        self.keep = True
                    what = "rowid" if u is None and t.rowid_alias is None else t.columns[t.rowid_alias].name if u is None else ", ".join(f"{t.name}.{x.column}" if isinstance(x, A.Name) else "expression" for x in u.columns)
                    if rule == "FAIL":
                        self.keep_before(t, u, data, rows, names, q)
                    raise DialectError(f"UNIQUE constraint failed: {what if u is not None else t.name + '.' + what}")
            elif rule == "IGNORE":
                ranked = new.withColumn("_n_", F.row_number().over(Window.partitionBy(*q).orderBy("_order_")))
                bad = ranked.filter("_n_ > 1").select("_order_").unionByName(new.join(self.key_frame(t, u, data).select(*q), q, "left_semi").select("_order_"))
                rows = rows.join(bad, "_order_", "left_anti")
            else:  # REPLACE
                ranked = new.withColumn("_n_", F.row_number().over(Window.partitionBy(*q).orderBy(F.desc("_order_"))))
                bad = ranked.filter("_n_ > 1").select("_order_")
                gone = self.key_frame(t, u, data).join(new.select(*q), q, "left_semi").select("_rowid_")
                count = rows.count() if count is None else count
                rows, data = rows.join(bad, "_order_", "left_anti"), data.join(gone, "_rowid_", "left_anti")
        if any(rule == "IGNORE" for _, rule in constraints) or s.upserts:
            # Rows left out take no rowid.
            rows = self.place_rowids(t, rows.drop("_rowid_"))
        fresh = self.held(rows)
        inserted = fresh.count() if count is None else count
        changed = 0 if updated is None else updated.count()
        last = fresh.orderBy(F.desc("_order_")).limit(1).select("_rowid_").collect()
        self.affected = fresh.orderBy("_order_").select(*names) if updated is None else fresh.select(*names).unionByName(updated.select(*names))
        self.finish(t, data.select(*names).unionByName(fresh.select(*names)), inserted + changed)
        if last:
            self.counters["last_insert_rowid"] = last[0][0]
            if t.autoincrement:
                t.sequence = max(t.sequence, last[0][0])

    def keep_before(self, t: Table, u, data: DataFrame, rows: DataFrame, names: list, q: list) -> None:
        """OR FAIL keeps the rows before the first that fails."""
        from pyspark.sql import Window

        new = self.key_frame(t, u, rows)
        ranked = new.withColumn("_n_", F.row_number().over(Window.partitionBy(*q).orderBy("_order_")))
        bad = ranked.filter("_n_ > 1").select("_order_").unionByName(new.join(self.key_frame(t, u, data).select(*q), q, "left_semi").select("_order_"))
        first = bad.agg(F.min("_order_")).first()[0]
        kept = rows.filter(F.col("_order_") < first)
        self.finish(t, data.select(*names).unionByName(kept.select(*names)), kept.count())
        self.keep = True

    def finish(self, t: Table, data: DataFrame, n: int) -> None:
        self.put(t, data)
        self.counters["changes"] = n
        self.counters["total_changes"] += n
        self.dirty = True

    def upsert_target(self, t: Table, up) -> str | None:
        target = up[0]
        if target is None:
            return None
        names = {x.column.lower() if isinstance(x, A.Name) else repr(x) for x in target}
        if t.rowid_alias is not None and names == {t.columns[t.rowid_alias].name.lower()} or names <= {"rowid", "oid", "_rowid_"}:
            return "rowid"
        for u in t.uniques:
            if {x.column.lower() if isinstance(x, A.Name) else repr(x) for x in u.columns} == names and (u.where is None or u.where == up[1]):
                return u.name
        raise DialectError("ON CONFLICT clause does not match any PRIMARY KEY or UNIQUE constraint")

    def upsert(self, t: Table, u, data: DataFrame, rows: DataFrame, up, with_scope: Scope):
        """DO UPDATE in rounds: each takes one new row of every key, inserts it or changes the row in its way."""
        from pyspark.sql import Window

        from .lower import Column

        n = 1 if u is None else len(u.columns)
        q = [f"q{i}" for i in range(n)]
        names = ["_rowid_"] + [f"c{i}" for i in range(len(t.columns))]
        new = self.key_frame(t, u, rows)
        ranked = self.held(new.withColumn("_n_", F.row_number().over(Window.partitionBy(*q).orderBy("_order_"))))
        plain = rows.join(ranked.select("_order_"), "_order_", "left_anti").select("_order_", "_given_", *names)
        touched_all, kept_new = None, plain
        rounds = ranked.agg(F.max("_n_")).first()[0] or 0
        low = self.lowering()
        for r in range(1, rounds + 1):
            turn = ranked.filter(F.col("_n_") == r)
            current = self.key_frame(t, u, data.select(*names).unionByName(kept_new.select(*names)))
            hit = turn.select(*q, *[F.col(c).alias(f"n{c}") for c in names]).join(current.select(*q, *names), q)
            scope = self.row_scope(t, "h", [Column(c.name, E("h.n_rowid_" if i == t.rowid_alias else f"h.nc{i}", c.cls, c.aff if c.aff != "BLOB" else None, c.collation), "excluded") for i, c in enumerate(t.columns)], with_scope.ctes)
            for c in scope.columns[len(t.columns) + 1 :]:
                c.hidden = True
            h = hit.withColumnRenamed("n_rowid_", "n_rowid_").alias("h")
            cond = F.coalesce(F.expr(truth(low.expr(up[3], scope))), F.lit(False)) if up[3] is not None else F.lit(True)
            change = h.filter(cond)
            touched = self.held(change.select(*self.assignments(t, low, scope, up[2], "h")))
            touched = self.validate(t, touched, None)
            missed = turn.join(hit.select(*q), q, "left_anti")
            data = data.join(touched.select("_rowid_"), "_rowid_", "left_anti").select(*names).unionByName(touched.select(*names))
            inside = kept_new.join(touched.select("_rowid_"), "_rowid_", "left_semi").select("_order_", "_rowid_")
            data = data.join(inside.select("_rowid_"), "_rowid_", "left_anti").select(*names).unionByName(touched.join(inside.select("_rowid_"), "_rowid_", "left_semi").select(*names)) if r > 1 else data
            kept_new = kept_new.join(inside.select("_order_"), "_order_", "left_anti").select("_order_", "_given_", *names).unionByName(missed.select("_order_", "_given_", *names))
            touched_all = touched if touched_all is None else touched_all.unionByName(touched)
            data, kept_new, touched_all = self.settled(data), self.settled(kept_new), self.settled(touched_all)
        if touched_all is None:
            touched_all = data.limit(0).select(*names)
        return data, kept_new, touched_all

    def assignments(self, t: Table, low: Lowering, scope: Scope, sets, alias: str) -> list:
        """Columns of a row after SET, in terms of the row before."""
        new: dict[int, E] = {}
        for names, e in sets:
            exprs = e.args if isinstance(e, A.Call) and e.name == "row" else (e,)
            if len(names) != len(exprs):
                raise DialectError(f"{len(names)} columns assigned {len(exprs)} values")
            for n, x in zip(names, exprs, strict=True):
                try:
                    i = self.target(t, n)
                except DialectError:
                    raise DialectError(f"no such column: {n}") from None
                new[i] = low.expr(x, scope)
        rid = new.get(t.rowid_alias if t.rowid_alias is not None else -1)
        out = [F.expr(stored(replace(rid, aff=None), "INTEGER", "INT") if rid is not None else f"{alias}._rowid_").alias("_rowid_")]
        for i, c in enumerate(t.columns):
            if i == t.rowid_alias or i not in new:
                out.append(F.col(f"{alias}.c{i}").alias(f"c{i}"))
            else:
                out.append(F.expr(stored(new[i], c.aff, c.cls)).alias(f"c{i}"))
        return out

    def view_of(self, df: DataFrame) -> str:
        name = f"brindle_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        return name

    def do_update(self, s):
        from pyspark.sql import Window

        t = self.changed(self.writable(s.table))
        low, with_scope = self.scope_of(s)
        scope = self.row_scope(t, "u", ctes=with_scope.ctes)
        for c in scope.columns:
            c.table = s.alias or t.name
        names = ["_rowid_"] + [f"c{i}" for i in range(len(t.columns))]
        where = f" WHERE {low.condition(s.where, scope)}" if s.where is not None else ""
        self.widen_for(t, low, scope, s.sets)
        scope = self.row_scope(t, "u", ctes=with_scope.ctes)
        for c in scope.columns:
            c.table = s.alias or t.name
        view = self.view_of(t.data)
        texts = self.assignment_sql(t, low, scope, s.sets)
        hit = self.spark.sql(f"SELECT u._rowid_ AS old_, {', '.join(f'{x} AS {n}' for n, x in zip(names, texts, strict=True))} FROM {view} u{where}")
        hit = self.held(self.validate(t, hit, s.conflict))
        rest = t.data.join(hit.select(F.col("old_").alias("_rowid_")), "_rowid_", "left_anti")
        for u, rule in [(None, s.conflict or "ABORT")] + [(u, s.conflict or u.conflict) for u in t.uniques]:
            q = [f"q{i}" for i in range(1 if u is None else len(u.columns))]
            new, others = self.key_frame(t, u, hit), self.key_frame(t, u, rest)
            if rule == "REPLACE":
                gone = others.join(new.select(*q), q, "left_semi").select("_rowid_")
                last = new.withColumn("_n_", F.row_number().over(Window.partitionBy(*q).orderBy(F.desc("old_")))).filter("_n_ > 1").select("old_")
                rest, hit = rest.join(gone, "_rowid_", "left_anti"), hit.join(last, "old_", "left_anti")
            elif rule == "IGNORE":
                dup = new.withColumn("_n_", F.row_number().over(Window.partitionBy(*q).orderBy("old_"))).filter("_n_ > 1").select("old_")
                bad = dup.unionByName(new.join(others.select(*q), q, "left_semi").select("old_"))
                rest = rest.unionByName(t.data.join(bad.select(F.col("old_").alias("_rowid_")).distinct(), "_rowid_", "left_semi"))
                hit = hit.join(bad, "old_", "left_anti")
            else:
                both = new.select(*q).unionByName(others.select(*q))
                clash = both.groupBy(*q).count().filter("count > 1").limit(1).count()
                if not clash and self.sets_key(t, u, s.sets):
                    # Rows change one after another: a new key must not be one that a later row still has.
                    before = self.key_frame(t, u, t.data.join(hit.select(F.col("old_").alias("_rowid_")), "_rowid_", "left_semi")).select(F.col("_rowid_").alias("later_"), *q)
                    clash = new.join(before, q).filter("later_ > old_").limit(1).count()
                if clash:
                    raise DialectError(f"UNIQUE constraint failed: {t.name}.{'rowid' if u is None else u.columns[0].column if isinstance(u.columns[0], A.Name) else 'expression'}")
        n = hit.count()
        self.affected = hit.orderBy("old_").select(*names)
        self.finish(t, rest.select(*names).unionByName(hit.select(*names)), n)
        return self.returned(t, s, with_scope)

    def sets_key(self, t: Table, u: Unique | None, sets) -> bool:
        """Whether an UPDATE assigns a column of a key."""
        names = {self.target(t, n) for some, _ in sets for n in some}
        if u is None:
            return -1 in names or t.rowid_alias in names
        return any(not isinstance(x, A.Name) or self.column_index(t, x.column) in names for x in u.columns)

    def widen_for(self, t: Table, low: Lowering, scope: Scope, sets) -> None:
        for names, e in sets:
            exprs = e.args if isinstance(e, A.Call) and e.name == "row" else (e,)
            if len(names) != len(exprs):
                raise DialectError(f"{len(names)} columns assigned {len(exprs)} values")
            for n, x in zip(names, exprs, strict=True):
                try:
                    i = self.target(t, n)
                except DialectError:
                    raise DialectError(f"no such column: {n}") from None
                if i >= 0:
                    self.widen(t, i, low.expr(x, scope))

    def assignment_sql(self, t: Table, low: Lowering, scope: Scope, sets) -> list[str]:
        new: dict[int, E] = {}
        for names, e in sets:
            exprs = e.args if isinstance(e, A.Call) and e.name == "row" else (e,)
            for n, x in zip(names, exprs, strict=True):
                new[self.target(t, n)] = low.expr(x, scope)
        rid = new.get(t.rowid_alias if t.rowid_alias is not None else -1)
        out = [stored(replace(rid, aff=None), "INTEGER", "INT") if rid is not None else "u._rowid_"]
        for i, c in enumerate(t.columns):
            out.append(stored(new[i], c.aff, c.cls) if i in new and i != t.rowid_alias else f"u.c{i}")
        return out

    def do_delete(self, s):
        t = self.changed(self.writable(s.table))
        low, with_scope = self.scope_of(s)
        scope = self.row_scope(t, "u", ctes=with_scope.ctes)
        for c in scope.columns:
            c.table = s.alias or t.name
        where = f" WHERE {low.condition(s.where, scope)}" if s.where is not None else ""
        gone = self.held(self.spark.sql(f"SELECT u.* FROM {self.view_of(t.data)} u{where}"))
        n = gone.count()
        self.affected = gone.orderBy("_rowid_")
        self.finish(t, t.data.join(gone.select("_rowid_"), "_rowid_", "left_anti"), n)
        return self.returned(t, s, with_scope)

    def returned(self, t: Table, s, with_scope: Scope):
        if s.returning is None:
            return None
        view = self.view_of(self.affected)
        found = self.lookup

        def lookup(name, lowering):
            if name == "\0changed":
                return view, self.table_source(t)[1]
            return found(name, lowering)

        low = Lowering(lookup, self.counters, Recursion(self.spark), self.evaluate, self.wide, self.functions, self.aggregates)
        rel = low.query(A.Query(A.Core(tuple(s.returning), A.TableRef("\0changed", s.alias or t.name))))
        return rel.columns, self.collect(rel)


#: Rows of a table that stay local to the driver; a larger version is written to the shared folder.
LOCAL_ROWS = 20_000
#: Estimated bytes of a plan's rows up to which it is worth a look whether these are few.
LOCAL_BYTES = 4 << 20


def counted(rows: DataFrame, name: str, base: int) -> DataFrame:
    """Rows numbered from base + 1 on by _order_, a monotonically_increasing_id() that is settled.

    Its upper bits are a partition's number: rows are numbered inside a partition's, after the counts of those before.
    """
    from pyspark.sql import Window

    part = F.shiftright("_order_", 33)
    own = F.row_number().over(Window.partitionBy("_part_").orderBy("_order_"))
    sizes = rows.groupBy(part.alias("_part_")).agg(F.count("*").alias("_n_"))
    bases = sizes.select("_part_", F.coalesce(F.sum("_n_").over(Window.orderBy("_part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base_"))
    out = rows.withColumn("_part_", part).withColumn("_own_", own).join(F.broadcast(bases), "_part_")
    return out.withColumn(name, (F.col("_base_") + F.col("_own_") + F.lit(base)).cast("long")).drop("_part_", "_own_", "_base_")


def rename_column(node, old: str, new: str):
    return _renamed(node, lambda n: replace(n, column=new) if isinstance(n, A.Name) and n.column.lower() == old.lower() else n)


def rename_table(node, old: str, new: str):
    def change(n):
        if isinstance(n, A.TableRef) and n.name.lower() == old.lower():
            return replace(n, name=new)
        if isinstance(n, A.Name) and n.table is not None and n.table.lower() == old.lower():
            return replace(n, table=new)
        return n

    return _renamed(node, change)


def _renamed(node, change):
    if isinstance(node, tuple):
        return tuple(_renamed(x, change) for x in node)
    if hasattr(node, "__dataclass_fields__"):
        return change(replace(node, **{f: _renamed(getattr(node, f), change) for f in node.__dataclass_fields__}))
    return node


__all__ = ["Session", "Unsupported"]
