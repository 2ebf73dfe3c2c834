"""Single-file databases: read into a session, written back whole."""

from __future__ import annotations

import os
import sqlite3
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from brindle.plans import ast as A
from brindle.plans.errors import Unsupported
from brindle.plans.parser import parse
from brindle.plans.session import Session

#: Rows a partition of a table read covers, by rowid.
ROWS = 50_000
KINDS = {"integer": "INT", "real": "REAL", "text": "TEXT", "blob": "BLOB"}


class DatabaseFile(DataSource):
    """spark.read.format("brindle_db").option("path", file).option("table", name): a table in ranges of rowids.

    The file must be readable at that path on every executor.
    """

    @classmethod
    def name(cls) -> str:
        return "brindle_db"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options)


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table, self.columns = options["path"], options["table"], options["columns"].split("\x01")

    def partitions(self) -> list[_Range]:
        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        db.close()
        if low is None:
            return [_Range(0, -1)]
        step = max(ROWS, -(-(high - low + 1) // 10_000))
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range):
        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        names = ", ".join(_quoted(c) for c in self.columns)
        yield from db.execute(f"SELECT rowid, {names} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))
        db.close()


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def open_database(spark: SparkSession, path: str) -> Session:
    """A session over a file's tables, indexes and views; a missing or empty file gives an empty one."""
    spark.dataSource.register(DatabaseFile)
    s = Session(spark)
    if not os.path.exists(path) or not os.path.getsize(path):
        return s
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    objects = db.execute("SELECT type, name, tbl_name, sql FROM sqlite_schema WHERE sql IS NOT NULL ORDER BY type = 'table' DESC, rowid").fetchall()
    for kind, name, _, sql in objects:
        if name == "sqlite_sequence":
            continue
        statement = parse(sql)
        if kind == "table":
            s.do_create_table(statement)
            t = s.catalog.tables[name.lower()]
            for i, c in enumerate(t.columns):
                found = {r[0] for r in db.execute(f"SELECT DISTINCT typeof({_quoted(c.name)}) FROM {_quoted(name)}")} - {"null"}
                classes = {KINDS[f] for f in found}
                if i == t.rowid_alias or not classes:
                    continue
                if classes == {"INT", "REAL"}:
                    classes = {"REAL"}
                if len(classes) > 1:
                    raise Unsupported(f"column {c.name} of {name} holds values of several classes")
                c.cls = classes.pop()
            schema = ", ".join(["_rowid_ long"] + [f"c{i} { {'INT': 'long', 'REAL': 'double', 'TEXT': 'string', 'BLOB': 'binary'}.get('INT' if i == t.rowid_alias else c.cls, 'string')}" for i, c in enumerate(t.columns)])
            data = spark.read.format("brindle_db").option("path", os.path.abspath(path)).option("table", name).option("columns", "\x01".join(c.name for c in t.columns)).option("schema", schema).load()
            if t.rowid_alias is not None:
                data = data.withColumn(f"c{t.rowid_alias}", data["_rowid_"].cast("long" if t.columns[t.rowid_alias].cls == "INT" else "string"))
            s.put(t, data)
            if t.autoincrement:
                row = db.execute("SELECT seq FROM sqlite_sequence WHERE name = ?", (name,)).fetchone()
                t.sequence = row[0] if row else 0
        elif kind == "view":
            s.do_create_view(statement)
        else:
            s.do_create_index(statement)
    db.close()
    s.dirty = False
    return s


def save_database(s: Session, path: str) -> None:
    """The session's tables, indexes and views as one file, put in place at once. Rows stream through the driver."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder)
    os.close(handle)
    os.unlink(temporary)
    db = sqlite3.connect(temporary, isolation_level=None)
    if os.path.exists(path) and os.path.getsize(path) >= 100:
        with open(path, "rb") as f:
            size = int.from_bytes(f.read(18)[16:18], "big")
        db.execute(f"PRAGMA page_size = {65536 if size == 1 else size}")
    db.execute("BEGIN")
    for t in s.catalog.tables.values():
        db.execute(definition(t))
        names = [c.name for i, c in enumerate(t.columns) if i != t.rowid_alias]
        kept = [f"c{i}" for i in range(len(t.columns)) if i != t.rowid_alias]
        key = t.columns[t.rowid_alias].name if t.rowid_alias is not None else "rowid"
        sql = f"INSERT INTO {_quoted(t.name)}({', '.join([_quoted(key) if t.rowid_alias is not None else key, *map(_quoted, names)])}) VALUES ({', '.join('?' * (len(names) + 1))})"
        db.executemany(sql, (tuple(r) for r in t.data.orderBy("_rowid_").select("_rowid_", *kept).toLocalIterator()))
        if t.autoincrement and t.sequence:
            db.execute("INSERT OR REPLACE INTO sqlite_sequence(rowid, name, seq) VALUES ((SELECT rowid FROM sqlite_sequence WHERE name = ?), ?, ?)", (t.name, t.name, t.sequence))
    for _, table, unique, _, _, sql in s.catalog.indexes.values():
        db.execute(sql)
    for _, _, _, sql in s.catalog.views.values():
        db.execute(sql)
    db.execute("COMMIT")
    db.close()
    os.replace(temporary, path)
    s.dirty = False


def definition(t) -> str:
    """CREATE TABLE for a table as it is now: as written while its columns are, else put together again."""
    try:
        statement = parse(t.sql)
        if statement.query is None and statement.name == t.name and [c.name for c in statement.columns] == [c.name for c in t.columns]:
            return t.sql
    except Exception:  # noqa: BLE001
        pass
    parts = []
    for i, c in enumerate(t.columns):
        words = [_quoted(c.name), c.declared]
        if i == t.rowid_alias:
            words.append("PRIMARY KEY" + (" AUTOINCREMENT" if t.autoincrement else ""))
        if c.not_null:
            words.append("NOT NULL")
        if isinstance(c.default, A.Lit):
            v = c.default.value
            words.append("DEFAULT " + ("NULL" if v is None else repr(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"))
        if c.collation != "BINARY":
            words.append(f"COLLATE {c.collation}")
        parts.append(" ".join(w for w in words if w))
    for u in t.uniques:
        if u.name.startswith("sqlite_autoindex_"):
            parts.append(("PRIMARY KEY" if u.primary else "UNIQUE") + "(" + ", ".join(_quoted(x.column) for x in u.columns) + ")")
    return f"CREATE TABLE {_quoted(t.name)}({', '.join(parts)})"
