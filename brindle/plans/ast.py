"""Syntax tree of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lit:
    value: object  # None, int, float, str or bytes


@dataclass(frozen=True)
class Name:
    table: str | None
    column: str
    quoted: bool = False  # in double quotes: a string if no column has the name


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Collate:
    arg: object
    name: str


@dataclass(frozen=True)
class Cast:
    arg: object
    type: str


@dataclass(frozen=True)
class Case:
    base: object | None
    arms: tuple
    other: object | None


@dataclass(frozen=True)
class Between:
    arg: object
    low: object
    high: object
    negated: bool


@dataclass(frozen=True)
class In:
    arg: object
    items: tuple | None
    query: object | None
    negated: bool


@dataclass(frozen=True)
class Like:
    kind: str  # like or glob
    arg: object
    pattern: object
    escape: object | None
    negated: bool


@dataclass(frozen=True)
class Exists:
    query: object


@dataclass(frozen=True)
class Scalar:
    query: object


@dataclass(frozen=True)
class Bound:
    kind: str  # preceding, following, current
    amount: object | None  # None: unbounded


@dataclass(frozen=True)
class WindowSpec:
    base: str | None
    partition: tuple
    order: tuple
    unit: str | None = None
    low: Bound | None = None
    high: Bound | None = None
    exclude: str | None = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    star: bool = False
    distinct: bool = False
    order: tuple = ()
    filter: object | None = None
    over: object | None = None  # a window's name or its WindowSpec


@dataclass(frozen=True)
class Star:
    table: str | None


@dataclass(frozen=True)
class OrderTerm:
    expr: object
    descending: bool = False
    nulls_first: bool | None = None


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None


@dataclass(frozen=True)
class Derived:
    query: object
    alias: str | None


@dataclass(frozen=True)
class Join:
    left: object
    right: object
    kind: str  # inner, left, right, full
    natural: bool = False
    on: object | None = None
    using: tuple | None = None


@dataclass(frozen=True)
class Core:
    columns: tuple  # (expression or Star, alias)
    source: object | None = None
    where: object | None = None
    group: tuple = ()
    having: object | None = None
    distinct: bool = False
    windows: tuple = ()


@dataclass(frozen=True)
class Values:
    rows: tuple


@dataclass(frozen=True)
class Compound:
    op: str  # union, union all, intersect, except
    left: object
    right: object


@dataclass(frozen=True)
class Cte:
    name: str
    columns: tuple | None
    query: object


@dataclass(frozen=True)
class Query:
    body: object  # Core, Values or Compound
    order: tuple = ()
    limit: object | None = None
    offset: object | None = None
    ctes: tuple = ()
    recursive: bool = False


@dataclass
class ColumnDef:
    name: str
    type: str = ""
    not_null: str | None = None  # conflict clause
    default: object | None = None
    collation: str = "BINARY"
    primary_key: bool = False
    autoincrement: bool = False
    checks: list = field(default_factory=list)
    uniques: list = field(default_factory=list)  # (columns, conflict, is primary)


@dataclass
class Statement:
    kind: str
    fields: dict

    def __getattr__(self, name):
        try:
            return self.__dict__["fields"][name]
        except KeyError:
            raise AttributeError(name) from None
