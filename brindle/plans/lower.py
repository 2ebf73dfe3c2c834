"""Bound lowering: syntax trees to Spark SQL text, so that Catalyst plans and decorrelates the whole statement."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from brindle.functions import scalar, texts
from brindle.functions.moments import let
from brindle.functions.values import (NULLS, REAL_PREFIX, E, any_integer, any_of, cast, collation_key, compare, integer, key, known_collation, literal, number, real, text, truth, unify, value)

from . import ast as A
from .errors import DialectError, Unsupported

AGGREGATES = {"count", "sum", "total", "avg", "group_concat", "string_agg"}
WINDOW_ONLY = {"row_number": 0, "rank": 0, "dense_rank": 0, "percent_rank": 0, "cume_dist": 0, "ntile": 1, "lag": 3, "lead": 3, "first_value": 1, "last_value": 1, "nth_value": 2}
ROWID = ("rowid", "oid", "_rowid_")


@dataclass
class Out:
    """A column of a lowered query; in its SQL the i-th is named k<i>."""

    name: str
    cls: str
    aff: str | None = None
    coll: str | None = None
    ts: bool = False


@dataclass
class Rel:
    sql: str
    columns: list[Out]


@dataclass
class Column:
    name: str
    e: E
    table: str | None
    hidden: bool = False  # the right copy of a USING column, or a rowid: found by its table's name, not by *
    merged: bool = False  # stands for both copies


@dataclass
class Scope:
    columns: list[Column] = field(default_factory=list)
    parent: Scope | None = None
    ctes: dict = field(default_factory=dict)
    aliases: dict = field(default_factory=dict)
    windows: dict = field(default_factory=dict)
    group: Grouping | None = None
    prepared: dict = field(default_factory=dict)

    def find(self, name: A.Name) -> Column | None:
        want, table = name.column.lower(), name.table.lower() if name.table else None
        found = [c for c in self.columns if c.name.lower() == want and (table is None and not c.hidden or table is not None and c.table is not None and c.table.lower() == table and not c.merged)]
        if not found and table is None and want in ROWID:
            found = [c for c in self.columns if c.name == "_rowid_"]
        if not found and table is not None and want in ROWID:
            found = [c for c in self.columns if c.name == "_rowid_" and (c.table or "").lower() == table]
        if len(found) > 1:
            raise DialectError(f"ambiguous column name: {name.column}")
        return found[0] if found else None


@dataclass
class Grouping:
    """An aggregation: its keys, and the aggregates and bare columns asked for from above it."""

    inner: Scope
    alias: str
    keys: list[tuple[str, E]] = field(default_factory=list)  # (inner SQL, as seen from above)
    outputs: list[str] = field(default_factory=list)
    seen: dict = field(default_factory=dict)
    bare: list = field(default_factory=list)
    extremes: list = field(default_factory=list)
    implicit: bool = False

    def output(self, sql: str, e: E) -> E:
        if sql not in self.seen:
            name = f"a{len(self.outputs)}"
            self.outputs.append(f"{sql} AS {name}")
            self.seen[sql] = f"{self.alias}.{name}"
        return replace(e, sql=self.seen[sql], is_const=False)

    def bare_column(self, e: E) -> E:
        name = f"b{len(self.bare)}"
        for n, sql in self.bare:
            if sql == e.sql:
                return replace(e, sql=f"{self.alias}.{n}", ts=None)
        self.bare.append((name, e.sql))
        return replace(e, sql=f"{self.alias}.{name}", ts=None)


class Lowering:
    """One statement's lowering. ``lookup`` resolves a table name to (SQL relation, columns), or None."""

    def __init__(self, lookup, counters: dict | None = None, recursion=None, evaluate=None, wide: bool = False, functions: dict | None = None, aggregates: dict | None = None):
        self.lookup, self.counters, self.recursion, self.evaluate, self.wide = lookup, counters or {}, recursion, evaluate, wide
        self.functions, self.aggregates = functions or {}, aggregates or {}
        self.count = 0

    def fresh(self, lead: str = "s") -> str:
        self.count += 1
        return f"{lead}{self.count}"

    # Queries

    def query(self, q: A.Query, parent: Scope | None = None) -> Rel:
        scope = Scope(parent=parent, ctes=dict(parent.ctes) if parent else {})
        for c in q.ctes:
            self.declare(c, scope, q.recursive)
        limit = self.limit(q, scope)
        if isinstance(q.body, A.Core):
            return self.core(q.body, q.order, limit, scope)
        rel = self.body(q.body, scope)
        if not q.order and not limit:
            return rel
        s = self.fresh()
        above = Scope([Column(o.name, self.seen(s, i, o), None) for i, o in enumerate(rel.columns)], None)
        terms = []
        first = q.body
        while isinstance(first, A.Compound):
            first = first.left
        for t in q.order:
            e = self.ordinal(t.expr, above)
            if e is None:
                bare = t.expr
                while isinstance(bare, A.Collate):
                    bare = bare.arg
                name = bare.column.lower() if isinstance(bare, A.Name) and bare.table is None else None
                at = [i for i, o in enumerate(rel.columns) if o.name.lower() == name]
                if not at and isinstance(first, A.Core):
                    at = [i for i, (x, _) in enumerate(first.columns) if x == bare or (isinstance(x, A.Name) and isinstance(bare, A.Name) and x.column.lower() == bare.column.lower())]
                if not at:
                    raise DialectError("ORDER BY term does not match any column in the result set")
                e = above.columns[at[0]].e
                if isinstance(t.expr, A.Collate):
                    e = replace(e, coll=known_collation(t.expr.name), explicit=True)
            terms.append(self.order_sql(e, t))
        order = f" ORDER BY {', '.join(terms)}" if terms else ""
        return Rel(f"SELECT {', '.join(f'{s}.k{i}' for i in range(len(rel.columns)))} FROM ({rel.sql}) {s}{order}{limit}", rel.columns)

    def limit(self, q: A.Query, scope: Scope) -> str:
        def constant(e) -> int | None:
            if e is None:
                return None
            x = self.expr(e, Scope(parent=None, ctes=scope.ctes))
            v = x.const if x.is_const else self.evaluate(x.sql) if self.evaluate else None
            if isinstance(v, str):
                try:
                    v = float(v)
                except ValueError:
                    v = None
            if v is None or float(v) != int(v):
                raise DialectError("datatype mismatch")
            return int(v)

        limit, offset = constant(q.limit), constant(q.offset)
        out = f" LIMIT {min(limit, 2**31 - 1)}" if limit is not None and limit >= 0 else ""
        return out + (f" OFFSET {min(offset, 2**31 - 1)}" if offset and offset > 0 else "")

    def declare(self, c: A.Cte, scope: Scope, recursive: bool) -> None:
        lower = c.name.lower()
        if recursive and self.mentions(c.query, lower):
            if self.recursion is None:
                raise Unsupported("recursion here")
            scope.ctes[lower] = self.recursion(self, c, scope)
            return
        outer = Scope(parent=scope.parent, ctes=dict(scope.ctes))
        rel = self.query(c.query, outer)
        scope.ctes[lower] = (f"({rel.sql})", self.renamed(rel.columns, c.columns, c.name))

    @staticmethod
    def renamed(columns: list[Out], names, what: str) -> list[Out]:
        if names is None:
            return columns
        if len(names) != len(columns):
            raise DialectError(f"table {what} has {len(columns)} values for {len(names)} columns")
        return [replace(o, name=n) for o, n in zip(columns, names, strict=True)]

    def mentions(self, node, name: str) -> bool:
        if isinstance(node, A.TableRef):
            return node.name.lower() == name
        if isinstance(node, tuple):
            return any(self.mentions(x, name) for x in node)
        if hasattr(node, "__dataclass_fields__"):
            return any(self.mentions(getattr(node, f), name) for f in node.__dataclass_fields__)
        return False

    def body(self, b, scope: Scope) -> Rel:
        if isinstance(b, A.Core):
            return self.core(b, (), "", Scope(parent=scope.parent, ctes=scope.ctes))
        if isinstance(b, A.Values):
            return self.values(b, scope)
        left, right = self.body(b.left, scope), self.body(b.right, scope)
        if len(left.columns) != len(right.columns):
            raise DialectError(f"SELECTs to the left and right of {b.op.upper()} do not have the same number of result columns")
        return self.combine(b.op, left, right)

    def combine(self, op: str, left: Rel, right: Rel) -> Rel:
        a, b = self.fresh(), self.fresh()
        xs, ys, outs = [], [], []
        for i, (l, r) in enumerate(zip(left.columns, right.columns, strict=True)):
            (x, y), cls = unify([self.seen(a, i, l), self.seen(b, i, r)])
            coll = l.coll or r.coll
            xs.append(f"{x} AS k{i}")
            ys.append(f"{y} AS k{i}")
            outs.append(Out(l.name, cls, l.aff if l.aff == r.aff else None, coll))
        lsql, rsql = f"SELECT {', '.join(xs)} FROM ({left.sql}) {a}", f"SELECT {', '.join(ys)} FROM ({right.sql}) {b}"
        if op == "union all":
            return Rel(f"({lsql}) UNION ALL ({rsql})", outs)
        if all(o.coll in (None, "BINARY") and o.cls != "ANY" for o in outs):
            return Rel(f"({lsql}) {op.upper()} ({rsql})", outs)
        keys = [key(E(f"k{i}", o.cls, None, o.coll)) for i, o in enumerate(outs)]
        s = self.fresh()
        tagged = f"SELECT *, 0 AS side FROM ({lsql}) UNION ALL SELECT *, 1 AS side FROM ({rsql})"
        having = {"union": "", "intersect": " HAVING min(side) = 0 AND max(side) = 1", "except": " HAVING max(side) = 0"}[op]
        pick = "max_by" if op == "union" else "min_by"
        return Rel(f"SELECT {', '.join(f'{pick}(k{i}, side) AS k{i}' for i in range(len(outs)))} FROM ({tagged}) {s} GROUP BY {', '.join(keys)}{having}", outs)

    def values(self, v: A.Values, scope: Scope) -> Rel:
        rows = [[value(self.expr(x, Scope(parent=scope.parent, ctes=scope.ctes))) for x in r] for r in v.rows]
        columns = [unify(list(c)) for c in zip(*rows, strict=True)]
        outs = [Out(f"column{i + 1}", cls) for i, (_, cls) in enumerate(columns)]
        lines = [", ".join(f"{columns[j][0][i]} AS k{j}" for j in range(len(outs))) for i in range(len(rows))]
        if all(x.is_const for r in rows for x in r) and all(o.cls != "ANY" for o in outs):
            return Rel(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(columns[j][0][i] for j in range(len(outs))) + ')' for i in range(len(rows)))} AS v({', '.join(f'k{j}' for j in range(len(outs)))})", outs)
        return Rel(" UNION ALL ".join(f"(SELECT {line})" for line in lines) if len(lines) > 1 else f"SELECT {lines[0]}", outs)

    @staticmethod
    def seen(s: str, i: int, o: Out) -> E:
        return E(f"{s}.k{i}", o.cls, o.aff, o.coll)

    # FROM

    def source(self, node, scope: Scope) -> tuple[str, list[Column]]:
        if isinstance(node, A.TableRef):
            return self.table(node, scope)
        if isinstance(node, A.Derived):
            rel = self.query(node.query, Scope(parent=scope.parent, ctes=scope.ctes))
            s = self.fresh()
            return f"({rel.sql}) {s}", [Column(o.name, self.seen(s, i, o), node.alias) for i, o in enumerate(rel.columns)]
        return self.join(node, scope)

    def table(self, node: A.TableRef, scope: Scope) -> tuple[str, list[Column]]:
        s, name = self.fresh(), node.name.lower()
        if name in scope.ctes:
            sql, outs = scope.ctes[name]
            return f"{sql} {s}", [Column(o.name, self.seen(s, i, o), node.alias or node.name) for i, o in enumerate(outs)]
        found = self.lookup(node.name, self)
        if found is None:
            raise DialectError(f"no such table: {node.name}")
        sql, columns = found
        return f"{sql} {s}", [Column(n, replace(e, sql=e.sql.replace("\0", s), ts=e.ts.replace("\0", s) if e.ts else None), node.alias or node.name, hidden=n == "_rowid_") for n, e in columns]

    def join(self, j: A.Join, scope: Scope) -> tuple[str, list[Column]]:
        lsql, left = self.source(j.left, scope)
        rsql, right = self.source(j.right, scope)
        names = None
        visible = lambda cs: [c for c in cs if not c.hidden]
        if j.natural:
            have = {c.name.lower() for c in visible(left)}
            names = [c.name for c in visible(right) if c.name.lower() in have]
        elif j.using:
            names = list(j.using)
        columns = left + right
        conditions = []
        if names:
            for n in names:
                l = [c for c in visible(left) if c.name.lower() == n.lower()]
                r = [c for c in visible(right) if c.name.lower() == n.lower()]
                if not l or not r:
                    raise DialectError(f"cannot join using column {n} - column not present in both tables")
                if len(l) > 1:
                    raise DialectError(f"ambiguous reference to {n} in USING()")
                conditions.append(compare("=", l[0].e, r[0].e).sql)
                at = columns.index(l[0])
                r[0].hidden = True
                if j.kind in ("right", "full"):
                    items, cls = unify([l[0].e, r[0].e])
                    both = E(f"coalesce({', '.join(items)})", cls, l[0].e.aff, l[0].e.coll)
                    l[0].hidden = True
                    columns.insert(at, Column(l[0].name, both, None, merged=True))
        if j.on is not None:
            conditions.append(truth(self.expr(j.on, Scope(columns, scope.parent, scope.ctes, scope.aliases))))
        word = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}[j.kind]
        if not conditions:
            if j.kind == "inner":
                return f"{lsql} CROSS JOIN {rsql}", columns
            conditions = ["TRUE"]
        right_sql = f"({rsql})" if isinstance(j.right, A.Join) else rsql
        return f"{lsql} {word} {right_sql} ON {' AND '.join(conditions)}", columns

    # SELECT

    def core(self, c: A.Core, order: tuple, limit: str, scope: Scope) -> Rel:
        from_sql = ""
        if c.source is not None:
            sql, scope.columns = self.source(c.source, scope)
            from_sql = f" FROM {sql}"
        for n, w in c.windows:
            if n.lower() in scope.windows:
                raise DialectError(f"window {n} is defined twice")
            scope.windows[n.lower()] = w
        items = []
        for e, alias in c.columns:
            if isinstance(e, A.Star):
                found = [x for x in scope.columns if (e.table is None and not x.hidden) or (e.table is not None and x.name != "_rowid_" and not x.merged and (x.table or "").lower() == e.table.lower())]
                if not found or c.source is None:
                    raise DialectError("no tables specified" if e.table is None else f"no such table: {e.table}")
                items += [(x, x.name) for x in found]
            else:
                name = alias if isinstance(alias, str) else e.column if isinstance(e, A.Name) else alias[1] if alias else ""
                items.append((e, name))
                if isinstance(alias, str):
                    scope.aliases.setdefault(alias.lower(), e)
        where = ""
        if c.where is not None:
            if self.has_aggregate(c.where, scope):
                raise DialectError("misuse of aggregate")
            where = f" WHERE {self.condition(c.where, scope)}"
        exprs = [e for e, _ in items if not isinstance(e, Column)] + [t.expr for t in order] + ([c.having] if c.having is not None else [])
        grouped = bool(c.group) or any(self.has_aggregate(e, scope) for e in exprs)
        if c.having is not None and not grouped:
            raise DialectError("HAVING clause on a non-aggregate query")
        top = scope
        g = None
        if grouped and self.to_prepare(exprs, scope):
            return self.core(*self.above_groups(c, items, order, scope), limit, Scope(parent=scope.parent, ctes=scope.ctes))
        if grouped:
            g = Grouping(scope, self.fresh("g"), implicit=not c.group)
            self.group_keys(c, items, scope, g)
            top = Scope([], scope.parent, scope.ctes, scope.aliases, scope.windows, g)
            base_from, base_where = None, ""
        else:
            base_from, base_where = from_sql, where
            if specs := self.to_prepare(exprs, scope):
                base_from = self.prepare(specs, from_sql, where, scope, items)
                base_where = ""
        having = f" WHERE {self.condition(c.having, top)}" if c.having is not None else ""
        outs, sqls = [], []
        for e, name in items:
            x = self.column_value(e, top) if isinstance(e, Column) else value(self.expr(e, top))
            sqls.append(x.sql)
            outs.append(Out(name, x.cls, x.aff, x.coll))
        terms = [self.result_term(t, items, sqls, outs, top) for t in order]
        if g is not None:
            base_from, base_where = self.grouped_from(g, from_sql, where, c), having
        names = [f"k{i}" for i in range(len(outs))]
        select = ", ".join(f"{s} AS {n}" for s, n in zip(sqls, names, strict=True))
        s = self.fresh()
        if c.distinct:
            if all(o.cls != "ANY" and (o.cls != "TEXT" or o.coll in (None, "BINARY")) for o in outs):
                inner = f"SELECT DISTINCT {select}{base_from}{base_where}"
            else:
                d = self.fresh()
                keys = ", ".join(key(E(n, o.cls, None, o.coll)) for n, o in zip(names, outs, strict=True))
                inner = f"SELECT {', '.join(f'first({n}) AS {n}' for n in names)} FROM (SELECT {select}{base_from}{base_where}) {d} GROUP BY {keys}"
            if not terms:
                return Rel(inner + limit, outs)
            by, hidden = [], []
            for i, (e, t) in enumerate(terms):
                if e.sql not in sqls:
                    hidden.append(f"{value(e).sql} AS o{i}")
                at = f"k{sqls.index(e.sql)}" if e.sql in sqls else f"o{i}"
                by.append(self.order_sql(replace(value(e), sql=f"{s}.{at}"), t))
            if hidden:  # the terms of the first of equal rows count
                d = self.fresh()
                keys = ", ".join(key(E(n, o.cls, None, o.coll)) for n, o in zip(names, outs, strict=True))
                firsts = ", ".join(f"first({n}) AS {n}" for n in [*names, *(h.rpartition(" AS ")[2] for h in hidden)])
                inner = f"SELECT {firsts} FROM (SELECT {', '.join([select, *hidden])}{base_from}{base_where}) {d} GROUP BY {keys}"
            return Rel(f"SELECT {', '.join(f'{s}.{n}' for n in names)} FROM ({inner}) {s} ORDER BY {', '.join(by)}{limit}", outs)
        if not terms:
            return Rel(f"SELECT {select}{base_from}{base_where}{limit}", outs)
        hidden, by = [], []
        for i, (e, t) in enumerate(terms):
            if e.sql in sqls:
                by.append(self.order_sql(replace(e, sql=f"{s}.k{sqls.index(e.sql)}"), t))
            else:
                hidden.append(f"{value(e).sql} AS o{i}")
                by.append(self.order_sql(replace(value(e), sql=f"{s}.o{i}"), t))
        inner = f"SELECT {', '.join([select, *hidden])}{base_from}{base_where}"
        return Rel(f"SELECT {', '.join(f'{s}.{n}' for n in names)} FROM ({inner}) {s} ORDER BY {', '.join(by)}{limit}", outs)

    def above_groups(self, c: A.Core, items: list, order: tuple, scope: Scope) -> tuple[A.Core, tuple]:
        """A grouped query with windows as one over its groups: what holds no window is a column of a derived table."""
        inner: list = []

        def hoisted(node):
            if isinstance(node, Column):
                node = A.Name(node.table, node.name)
            if isinstance(node, A.Lit) or node is None:
                return node
            if not self.window_calls(node):
                if node not in inner:
                    inner.append(node)
                return A.Name("groups of", f"x{inner.index(node)}")
            if isinstance(node, A.Call) and node.over is not None:
                w = self.spec(node.over, scope)
                w = replace(w, partition=tuple(map(hoisted, w.partition)), order=tuple(replace(t, expr=hoisted(t.expr)) for t in w.order))
                return replace(node, args=tuple(map(hoisted, node.args)), filter=hoisted(node.filter), over=w)
            return rebuilt(node)

        def rebuilt(node):
            if isinstance(node, tuple):
                return tuple(hoisted(x) if hasattr(x, "__dataclass_fields__") else rebuilt(x) for x in node)
            if not hasattr(node, "__dataclass_fields__"):
                return node
            return replace(node, **{f: hoisted(v) if hasattr(v, "__dataclass_fields__") else rebuilt(v) for f in node.__dataclass_fields__ for v in [getattr(node, f)]})

        def named(node):
            """Aliases and positions that stand for result columns, which the derived table doesn't have."""
            if isinstance(node, tuple):
                return tuple(map(named, node))
            if isinstance(node, A.Name) and node.table is None and scope.find(node) is None and (e := scope.aliases.get(node.column.lower())) is not None and e is not node:
                return e
            if not hasattr(node, "__dataclass_fields__") or isinstance(node, Column):
                return node
            return replace(node, **{f: named(getattr(node, f)) for f in node.__dataclass_fields__})

        group = tuple(items[e.value - 1][0] if isinstance(e, A.Lit) and isinstance(e.value, int) and 1 <= e.value <= len(items) else named(e) for e in c.group)
        group = tuple(A.Name(e.table, e.name) if isinstance(e, Column) else e for e in group)
        aliases = {n.lower() for _, n in items}
        items = [(named(e), n) for e, n in items]
        order = tuple(t if isinstance(t.expr, A.Name) and t.expr.table is None and t.expr.column.lower() in aliases else replace(t, expr=named(t.expr)) for t in order)
        columns = tuple((hoisted(e), name) for e, name in items)
        terms = tuple(t if isinstance(t.expr, A.Lit) or (isinstance(t.expr, A.Name) and t.expr.table is None and t.expr.column.lower() in aliases) else replace(t, expr=hoisted(t.expr)) for t in order)
        plain = A.Core(tuple((e, f"x{i}") for i, e in enumerate(inner)), c.source, named(c.where), group, named(c.having))
        return A.Core(columns, A.Derived(A.Query(plain), "groups of"), distinct=c.distinct), terms

    def result_term(self, t: A.OrderTerm, items, sqls, outs, top: Scope) -> tuple[E, A.OrderTerm]:
        """An ORDER BY term: a position, a result column's name (those that * yields too), or an expression."""
        bare, coll = t.expr, None
        while isinstance(bare, A.Collate):
            coll = coll or known_collation(bare.name)
            bare = bare.arg
        at = None
        if isinstance(bare, A.Lit) and isinstance(bare.value, int) and not isinstance(bare.value, bool):
            at = bare.value - 1
            if not 0 <= at < len(outs):
                raise DialectError("ORDER BY term out of range")
        elif isinstance(bare, A.Name) and bare.table is None:
            found = [i for i, o in enumerate(outs) if o.name.lower() == bare.column.lower()]
            at = found[0] if found else None
        if at is not None:
            o = outs[at]
            e = E(sqls[at], o.cls, o.aff, coll or o.coll, coll is not None)
        else:
            e = self.expr(t.expr, top)
        return e, t

    def ordinal(self, e, above: Scope) -> E | None:
        if isinstance(e, A.Lit) and isinstance(e.value, int):
            if not 1 <= e.value <= len(above.columns):
                raise DialectError("ORDER BY term out of range")
            return above.columns[e.value - 1].e
        return None

    @staticmethod
    def order_sql(e: E, t: A.OrderTerm) -> str:
        nulls = t.nulls_first if t.nulls_first is not None else not t.descending
        return f"{key(e)} {'DESC' if t.descending else 'ASC'} NULLS {'FIRST' if nulls else 'LAST'}"

    # Aggregation

    def group_keys(self, c: A.Core, items, scope: Scope, g: Grouping) -> None:
        for i, e in enumerate(c.group):
            bare = e
            if isinstance(e, A.Lit) and isinstance(e.value, int):
                if not 1 <= e.value <= len(items):
                    raise DialectError("GROUP BY term out of range")
                bare = items[e.value - 1][0]
            elif isinstance(e, A.Name) and e.table is None and scope.find(e) is None and e.column.lower() in scope.aliases:
                bare = scope.aliases[e.column.lower()]
            if not isinstance(bare, Column) and self.has_aggregate(bare, scope):
                raise DialectError("aggregate functions are not allowed in the GROUP BY clause")
            x = bare.e if isinstance(bare, Column) else value(self.expr(bare, scope))
            g.keys.append((x.sql, replace(x, sql=f"{g.alias}.g{i}", is_const=False, ts=None)))

    def grouped_from(self, g: Grouping, from_sql: str, where: str, c: A.Core) -> str:
        keys, outs = [], []
        for i, (sql, e) in enumerate(g.keys):
            k = key(replace(e, sql=sql)) if e.cls in ("TEXT", "ANY") else sql
            keys.append(k)
            outs.append(f"{sql} AS g{i}" if k == sql else f"first({sql}) AS g{i}")
        for n, sql in g.bare:
            if len(g.extremes) == 1:
                kind, x = g.extremes[0]
                if rowids := [c.e.sql for c in g.inner.columns if c.name == "_rowid_"]:
                    # Of equal extremes the first row counts.
                    x = f"if({x} IS NULL, NULL, struct({x} AS x, {', '.join(f'-{r}' if kind == 'max' else r for r in rowids)}))"
                outs.append(f"coalesce({kind}_by(struct({sql} AS v), {x}), first(struct({sql} AS v))).v AS {n}")
            else:
                outs.append(f"first({sql}) AS {n}")
        outs += g.outputs
        by = f" GROUP BY {', '.join(keys)}" if keys else ""
        return f" FROM (SELECT {', '.join(outs) or '1 AS one'}{from_sql}{where}{by}) {g.alias}"

    def has_aggregate(self, node, scope: Scope) -> bool:
        """An aggregate call of this query: not of a subquery, not under OVER."""
        if isinstance(node, Column):
            return False
        if isinstance(node, A.Call):
            if node.over is None and self.is_aggregate(node):
                return True
            parts = [*node.args, *(t.expr for t in node.order), *([node.filter] if node.filter is not None else [])]
            if isinstance(node.over, A.WindowSpec):
                parts += [*node.over.partition, *(t.expr for t in node.over.order)]
            return any(self.has_aggregate(x, scope) for x in parts)
        if isinstance(node, A.Name):
            if node.table is None and scope.find(node) is None and (e := scope.aliases.get(node.column.lower())) is not None and e is not node:
                return self.has_aggregate(e, Scope(scope.columns, scope.parent, scope.ctes))
            return False
        if isinstance(node, A.Query):
            return self.outer_aggregate(node, scope)
        if isinstance(node, tuple):
            return any(self.has_aggregate(x, scope) for x in node)
        if hasattr(node, "__dataclass_fields__"):
            return any(self.has_aggregate(getattr(node, f), scope) for f in node.__dataclass_fields__)
        return False

    def outer_aggregate(self, node, scope: Scope) -> bool:
        """A subquery's aggregate whose columns are all of this query."""
        if isinstance(node, A.Call) and node.over is None and self.is_aggregate(node) and node.args:
            names = self.names(node.args)
            return bool(names) and all(n.table is not None and scope.find(n) is not None for n in names)
        if isinstance(node, tuple):
            return any(self.outer_aggregate(x, scope) for x in node)
        if hasattr(node, "__dataclass_fields__"):
            return any(self.outer_aggregate(getattr(node, f), scope) for f in node.__dataclass_fields__)
        return False

    def names(self, node) -> list[A.Name]:
        if isinstance(node, A.Name):
            return [node]
        if isinstance(node, tuple):
            return [n for x in node for n in self.names(x)]
        if hasattr(node, "__dataclass_fields__"):
            return [n for f in node.__dataclass_fields__ for n in self.names(getattr(node, f))]
        return []

    def is_aggregate(self, c: A.Call) -> bool:
        return c.name in AGGREGATES or c.name in self.aggregates or (c.name in ("min", "max") and len(c.args) == 1)

    def aggregate(self, c: A.Call, scope: Scope, window: bool = False) -> E:
        """An aggregate over ``scope``'s rows, without OVER."""
        if c.star or (c.name == "count" and not c.args):
            if c.name != "count":
                raise DialectError(f"wrong number of arguments to function {c.name}()")
            return E(f"count({self.filtered('1', c, scope, window)})" if window else f"count(1){self.filter_sql(c, scope)}", "INT")
        if len(c.args) > (2 if c.name in ("group_concat", "string_agg") else 1) or (c.name == "string_agg" and len(c.args) != 2):
            raise DialectError(f"wrong number of arguments to function {c.name}()")
        if not window and any(self.has_aggregate(a, scope) for a in c.args):
            raise DialectError(f"misuse of aggregate function {c.name}()")
        if c.distinct and len(c.args) != 1:
            raise DialectError("DISTINCT aggregates must have exactly one argument")
        x = value(self.expr(c.args[0], scope))
        if window:
            x = replace(x, sql=self.filtered(x.sql, c, scope, True))
        d, f = "DISTINCT " if c.distinct else "", "" if window else self.filter_sql(c, scope)
        if c.name in self.aggregates:
            if window:
                raise Unsupported("a user's aggregate in a window")
            spark_name, cls = self.aggregates[c.name]
            return E(f"{spark_name}(collect_list({d}{text(x) if x.cls == 'ANY' else x.sql}){f})", cls)
        if c.name == "count":
            return E(f"count({d}{key(x)}){f}", "INT")
        if c.name in ("min", "max"):
            if x.cls == "ANY" or (x.cls == "TEXT" and x.coll not in (None, "BINARY")):
                return E(f"{c.name}_by({x.sql}, {key(x)}){f}", x.cls, x.aff, x.coll)
            return E(f"{c.name}({x.sql}){f}", x.cls, x.aff, x.coll)
        if c.name in ("group_concat", "string_agg"):
            sep = value(self.expr(c.args[1], scope)) if len(c.args) > 1 else literal(",")
            if not sep.is_const:
                return self.joined(c, x, sep, scope, window)
            glue = "''" if sep.const is None else text(sep)
            if window:
                return E(f"collect_list({text(x)})", "LIST:" + glue)
            order = ", ".join(self.order_sql(self.expr(t.expr, scope), t) for t in c.order)
            within = f" WITHIN GROUP (ORDER BY {order})" if order else ""
            return E(f"listagg({d}{text(x)}, {glue}){within}{f}", "TEXT")
        if c.name == "sum" and x.cls == "ANY" and not c.distinct:
            if window:
                return E(x.sql, "SUM:any")
            return E(self.sum_any(x, lambda sql: sql + f), "ANY")
        n = number(x)
        if c.distinct or (n.cls == "INT" and c.name == "sum"):
            return {"sum": E(f"sum({d}{n.sql}){f}", n.cls), "avg": E(f"avg({d}{real(x)}){f}", "REAL"), "total": E(f"sum({d}{real(x)}){f}", "TOTAL")}[c.name]
        if n.cls == "INT":  # as doubles, exact up to 2**53
            return E(f"avg({real(x)}){f}", "REAL") if c.name == "avg" else E(f"sum({real(x)}){f}", "TOTAL")
        if window:
            return E(n.sql, "SUM:" + c.name)
        return E(self.compensated(c.name, n.sql, lambda sql: sql + f), "TOTAL" if c.name == "total" else "REAL")

    @staticmethod
    def compensated(kind: str, x: str, over) -> str:
        """sum, total or avg of reals without the error of adding up: ``over`` makes an aggregate one of the group or frame.

        Values under 2**31 are summed as whole numbers, as multiples of 2**-30 and as the rest below, the first two of
        these exactly; larger ones apart. All are plain sums, so groups are reduced before the shuffle.
        """
        small = f"if(abs({x}) < 2147483648D, {x}, 0D)"
        whole = f"CAST({small} AS BIGINT)"
        part = f"CAST(({small} - {whole}) * 1073741824D AS BIGINT)"
        a, b, c, large = (over(f"sum({v})") for v in (whole, part, f"({small} - {whole}) - {part} / 1073741824D", f"if(abs({x}) < 2147483648D, 0D, {x})"))
        total = f"({large} + (CAST({a} + {b} div 1073741824L AS DOUBLE) + (({b} % 1073741824L) / 1073741824D + {c})))"
        n = over(f"count({x})")
        # Infinities of both signs have no sum.
        return {"total": total, "sum": f"if({n} = 0, NULL, nullif({total}, CAST('NaN' AS DOUBLE)))", "avg": f"if({n} = 0, NULL, {total} / {n})"}[kind]

    def sum_any(self, x: E, over) -> str:
        """An integer where all values are, else a real."""
        is_int = f"{x.sql}.c = 1 AND {x.sql}.k = 0"
        i = over(f"sum(if({is_int}, {any_integer(x.sql)}, NULL))")
        return f"if({over(f'count(if({is_int}, NULL, {x.sql}.c))')} = 0, {any_of(E(i, 'INT'))}, {any_of(E(self.compensated('sum', number(x).sql, over), 'REAL'))})"

    def joined(self, c: A.Call, x: E, sep: E, scope: Scope, window: bool) -> E:
        """group_concat with a separator of each row, which stands before the row's value except the first's."""
        if window:
            raise Unsupported("a separator that varies by row in a window")
        order = [self.expr(t.expr, scope) for t in c.order]
        pair = f"struct(coalesce({text(sep)}, '') AS s, {text(x)} AS v)"
        rows = f"array_agg({pair}) FILTER (WHERE {x.sql} IS NOT NULL{f' AND {truth(self.expr(c.filter, scope))}' if c.filter is not None else ''})"
        if order:
            keys = ", ".join(f"{key(e)} AS o{i}" for i, e in enumerate(order))
            rows = rows.replace(pair, f"struct({keys}, coalesce({text(sep)}, '') AS s, {text(x)} AS v)")
            steps = []
            for i, t in enumerate(c.order):
                nulls = t.nulls_first if t.nulls_first is not None else not t.descending
                up, down = ("1", "-1") if t.descending else ("-1", "1")
                steps.append(f"WHEN l.o{i} IS NULL AND r.o{i} IS NOT NULL THEN {'-1' if nulls else '1'} WHEN l.o{i} IS NOT NULL AND r.o{i} IS NULL THEN {'1' if nulls else '-1'} WHEN l.o{i} < r.o{i} THEN {up} WHEN l.o{i} > r.o{i} THEN {down}")
            rows = f"array_sort({rows}, (l, r) -> CASE {' '.join(steps)} ELSE 0 END)"
        return E(f"aggregate({rows}, CAST(NULL AS STRING), (a, y) -> if(a IS NULL, y.v, concat(a, y.s, y.v)))", "TEXT")

    def filter_sql(self, c: A.Call, scope: Scope) -> str:
        return f" FILTER (WHERE {truth(self.expr(c.filter, scope))})" if c.filter is not None else ""

    def filtered(self, sql: str, c: A.Call, scope: Scope, window: bool) -> str:
        return f"CASE WHEN {truth(self.expr(c.filter, scope))} THEN {sql} END" if c.filter is not None else sql

    # Windows

    def window_calls(self, node) -> list[A.Call]:
        if isinstance(node, A.Query) or isinstance(node, Column):
            return []
        out = [node] if isinstance(node, A.Call) and node.over is not None else []
        if isinstance(node, tuple | list):
            return [c for x in node for c in self.window_calls(x)]
        if hasattr(node, "__dataclass_fields__"):
            out += [c for f in node.__dataclass_fields__ for c in self.window_calls(getattr(node, f))]
        return out

    def spec(self, over, scope: Scope) -> A.WindowSpec:
        """A window with its base resolved."""
        if isinstance(over, str):
            if over.lower() not in scope.windows:
                raise DialectError(f"no such window: {over}")
            return self.spec(scope.windows[over.lower()], scope)
        if over.base is None:
            return over
        if over.base.lower() not in scope.windows:
            raise DialectError(f"no such window: {over.base}")
        base = self.spec(scope.windows[over.base.lower()], scope)
        if over.partition:
            raise DialectError(f"cannot override PARTITION clause of window: {over.base}")
        if over.order and base.order:
            raise DialectError(f"cannot override ORDER BY clause of window: {over.base}")
        if base.unit is not None:
            raise DialectError(f"cannot override frame specification of window: {over.base}")
        return replace(over, base=None, partition=base.partition, order=over.order or base.order)

    def to_prepare(self, exprs: list, scope: Scope) -> list[A.WindowSpec]:
        out = []
        for c in self.window_calls(exprs):
            w = self.spec(c.over, scope)
            if (w.unit == "groups" or w.exclude) and w not in out:
                out.append(w)
        return out

    def prepare(self, specs: list[A.WindowSpec], from_sql: str, where: str, scope: Scope, items: list) -> str:
        """Rows with the number of their peer group and their place in it, for frames that Spark has no syntax for."""
        s, inner = self.fresh(), []
        for i, c in enumerate(scope.columns):
            inner.append(f"{c.e.sql} AS x{i}")
        level = f"SELECT {', '.join(inner)}{from_sql}{where}"
        for i, c in enumerate(scope.columns):
            c.e = replace(c.e, sql=f"{s}.x{i}", ts=None)
        extra = []
        for n, w in enumerate(specs):
            over = self.over_sql(replace(w, unit=None, low=None, high=None, exclude=None), scope)
            extra += [f"dense_rank() OVER ({over}) AS p{n}", f"row_number() OVER ({over}) AS r{n}"]
            scope.prepared[w] = n
        t = self.fresh()
        sql = f" FROM (SELECT {s}.*, {', '.join(extra)} FROM ({level}) {s}) {t}"
        for i, c in enumerate(scope.columns):
            c.e = replace(c.e, sql=f"{t}.x{i}")
        scope.prepared["alias"] = t
        return sql

    def over_sql(self, w: A.WindowSpec, scope: Scope, frame: str | None = None) -> str:
        parts = []
        if w.partition:
            parts.append("PARTITION BY " + ", ".join(key(self.expr(e, scope)) for e in w.partition))
        if w.order:
            parts.append("ORDER BY " + ", ".join(self.order_sql(self.expr(t.expr, scope), t) for t in w.order))
        if frame is not None:
            parts.append(frame)
        return " ".join(parts)

    def bound(self, b: A.Bound, scope: Scope, real_order: bool = False) -> str:
        if b.kind == "current":
            return "CURRENT ROW"
        if b.amount is None:
            return f"UNBOUNDED {b.kind.upper()}"
        e = self.expr(b.amount, scope)
        v = e.const if e.is_const else self.evaluate(e.sql) if self.evaluate else None
        if isinstance(v, str):
            try:
                v = float(v)
            except ValueError:
                v = None
        if v is None or v < 0:
            raise DialectError(f"frame {'starting' if b.kind == 'preceding' else 'ending'} offset must be a non-negative {'number' if real_order else 'integer'}")
        return f"{literal(float(v) if real_order else int(v)).sql.rstrip('L')} {b.kind.upper()}"

    def window(self, c: A.Call, scope: Scope) -> E:
        if c.distinct:
            raise DialectError("DISTINCT is not supported for window functions")
        if c.order:
            raise DialectError("ORDER BY is not supported for window functions")
        w = self.spec(c.over, scope)
        aggregate = self.is_aggregate(c) or c.star
        if not aggregate and c.name not in WINDOW_ONLY:
            raise DialectError(f"{c.name}() may not be used as a window function")
        if c.filter is not None and not aggregate:
            raise DialectError("FILTER clause may only be used with aggregate window functions")
        if w.unit == "range" and len(w.order) != 1 and ((w.low.amount, w.high.amount) != (None, None)):
            raise DialectError("RANGE with offset PRECEDING/FOLLOWING requires one ORDER BY expression")
        ranking = c.name in WINDOW_ONLY and c.name not in ("first_value", "last_value", "nth_value")
        if w in scope.prepared and not ranking:
            return self.prepared_window(c, w, scope)
        if ranking:
            over = self.over_sql(replace(w, unit=None), scope)
            if not w.order:
                over = f"{over} ORDER BY 1" if c.name in ("row_number", "ntile", "lag", "lead") else f"{over} ORDER BY 0"
        else:
            frame = None
            if w.unit is not None:
                order = self.expr(w.order[0].expr, scope) if w.unit == "range" and len(w.order) == 1 else None
                is_real = order is not None and order.cls == "REAL"
                frame = f"{w.unit.upper()} BETWEEN {self.bound(w.low, scope, is_real)} AND {self.bound(w.high, scope, is_real)}"
                if not w.order and w.unit == "range":
                    frame = None if (w.low.amount, w.high.amount) == (None, None) else frame
            over = self.over_sql(w, scope, frame)
            if not w.order and w.unit == "rows":
                over = f"{'PARTITION BY ' + ', '.join(key(self.expr(e, scope)) for e in w.partition) if w.partition else ''} ORDER BY 1 {frame}"
        if aggregate:
            return self.finish(self.aggregate(c, scope, True), lambda sql: f"{sql} OVER ({over})")
        args = [value(self.expr(a, scope)) for a in c.args]
        low = {"lag": 1, "lead": 1}.get(c.name, WINDOW_ONLY[c.name])
        if not low <= len(args) <= WINDOW_ONLY[c.name]:
            raise DialectError(f"wrong number of arguments to function {c.name}()")
        if c.name in ("row_number", "rank", "dense_rank"):
            return E(f"CAST({c.name}() OVER ({over}) AS BIGINT)", "INT")
        if c.name in ("percent_rank", "cume_dist"):
            return E(f"{c.name}() OVER ({over})", "REAL")
        if c.name == "ntile":
            if args[0].is_const:
                if not isinstance(args[0].const, int) or args[0].const <= 0:
                    raise DialectError("argument of ntile must be a positive integer")
                return E(f"CAST(ntile({args[0].const}) OVER ({over}) AS BIGINT)", "INT")
            n, row = integer(args[0]), f"CAST(row_number() OVER ({over}) AS BIGINT)"
            part = f"PARTITION BY {', '.join(key(self.expr(e, scope)) for e in w.partition)}" if w.partition else ""
            total = f"count(1) OVER ({part})"
            big, size = f"({total} % {n})", f"({total} div {n})"
            return E(f"CASE WHEN {size} = 0 THEN {row} WHEN {row} <= {big} * ({size} + 1) THEN ({row} - 1) div ({size} + 1) + 1 ELSE ({row} - 1 - {big} * ({size} + 1)) div {size} + {big} + 1 END", "INT")
        if c.name in ("lag", "lead"):
            step = args[1] if len(args) > 1 else literal(1)
            x = args[0]
            if step.is_const and isinstance(step.const, int):
                items, cls = unify([x, args[2] if len(args) > 2 else literal(None)])
                if len(args) < 3 or args[2].is_const:
                    return E(f"{c.name}({items[0]}, {step.const}{', ' + items[1] if len(args) > 2 else ''}) OVER ({over})", cls, x.aff, x.coll)
            full = f"{over} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
            at = f"(row_number() OVER ({over}) {'-' if c.name == 'lag' else '+'} {integer(step)})"
            rows = f"collect_list(struct({x.sql} AS v)) OVER ({full})"
            items, cls = unify([replace(x, sql=f"element_at({rows}, CAST({at} AS INT)).v"), args[2] if len(args) > 2 else literal(None)])
            return E(f"CASE WHEN {at} BETWEEN 1 AND size({rows}) THEN {items[0]} ELSE {items[1]} END", cls)
        x = args[0]
        if c.name == "nth_value":
            if args[1].is_const:
                if not isinstance(args[1].const, int) or args[1].const <= 0:
                    raise DialectError("second argument to nth_value must be a positive integer")
                return E(f"nth_value({x.sql}, {args[1].const}) OVER ({over})", x.cls, x.aff, x.coll)
            return E(f"try_element_at(collect_list(struct({x.sql} AS v)) OVER ({over}), CAST({integer(args[1])} AS INT)).v", x.cls, x.aff, x.coll)
        return E(f"{c.name}({x.sql}) OVER ({over})", x.cls, x.aff, x.coll)

    def finish(self, e: E, over) -> E:
        """OVER applied to an aggregate, with what stands around it."""
        if e.cls == "SUM:any":
            return E(self.sum_any(replace(e, cls="ANY"), over), "ANY")
        if e.cls.startswith("SUM:"):
            sql = self.compensated(e.cls[4:], e.sql, over)
            return E(f"coalesce({sql}, 0D)" if e.cls == "SUM:total" else sql, "REAL")
        if e.cls == "TOTAL":
            return E(f"coalesce({over(e.sql)}, 0D)", "REAL")
        if e.cls.startswith("LIST:"):
            rows = over(e.sql)
            return E(f"CASE WHEN size({rows}) > 0 THEN array_join({rows}, {e.cls[5:]}) END", "TEXT")
        return replace(e, sql=over(e.sql))

    def prepared_window(self, c: A.Call, w: A.WindowSpec, scope: Scope) -> E:
        """A frame of GROUPS, as a RANGE over group numbers; EXCLUDE, by leaving rows out of the collected frame."""
        n, t = scope.prepared[w], scope.prepared["alias"]
        part = f"PARTITION BY {', '.join(key(self.expr(e, scope)) for e in w.partition)} " if w.partition else ""
        if w.unit == "groups":
            frame = f"{part}ORDER BY {t}.p{n} ASC RANGE BETWEEN {self.bound(w.low, scope)} AND {self.bound(w.high, scope)}"
        elif w.unit is None:
            frame = self.over_sql(w, scope)
        else:
            order = self.expr(w.order[0].expr, scope) if w.unit == "range" and len(w.order) == 1 else None
            is_real = order is not None and order.cls == "REAL"
            frame = self.over_sql(w, scope, f"{w.unit.upper()} BETWEEN {self.bound(w.low, scope, is_real)} AND {self.bound(w.high, scope, is_real)}")
        aggregate = self.is_aggregate(c) or c.star
        if w.exclude is None:
            if aggregate:
                return self.finish(self.aggregate(c, scope, True), lambda sql: f"{sql} OVER ({frame})")
            x = value(self.expr(c.args[0], scope))
            second = f", {self.expr(c.args[1], scope).const}" if c.name == "nth_value" else ""
            return E(f"{c.name}({x.sql}{second}) OVER ({frame})", x.cls, x.aff, x.coll)
        x = literal(1) if c.star or not c.args else value(self.expr(c.args[0], scope))
        keep = f"coalesce({truth(self.expr(c.filter, scope))}, FALSE)" if c.filter is not None else "TRUE"
        rows = f"collect_list(struct({t}.r{n} AS r, {t}.p{n} AS p, {keep} AS f, {x.sql} AS v)) OVER ({frame})"
        out = {"current row": f"y.r <> {t}.r{n}", "group": f"y.p <> {t}.p{n}", "ties": f"(y.p <> {t}.p{n} OR y.r = {t}.r{n})"}[w.exclude]
        left = f"filter({rows}, y -> y.f AND {out})"
        if c.name in ("first_value", "last_value", "nth_value"):
            at = {"first_value": "1", "last_value": "-1"}.get(c.name) or str(self.expr(c.args[1], scope).const)
            return E(f"try_element_at({left}, {at}).v", x.cls, x.aff, x.coll)
        if c.star or not c.args:
            return E(f"CAST(size({left}) AS BIGINT)", "INT")
        values = f"filter(transform({left}, y -> y.v), y -> y IS NOT NULL)"
        if c.name == "count":
            return E(f"CAST(size({values}) AS BIGINT)", "INT")
        if c.name in ("min", "max"):
            return E(f"array_{c.name}({values})", x.cls, x.aff, x.coll)
        if c.name in ("group_concat", "string_agg"):
            sep = self.expr(c.args[1], scope) if len(c.args) > 1 else literal(",")
            return E(f"CASE WHEN size({values}) > 0 THEN array_join(transform({values}, y -> {text(E('y', x.cls))}), {text(sep)}) END", "TEXT")
        cls = "INT" if x.cls == "INT" and c.name == "sum" else "REAL"
        zero, kind = ("0L", "BIGINT") if cls == "INT" else ("0D", "DOUBLE")
        total = f"aggregate({values}, {zero}, (a, y) -> a + CAST(y AS {kind}))"
        if c.name == "total":
            return E(total, "REAL")
        body = f"{total} / size({values})" if c.name == "avg" else total
        return E(f"CASE WHEN size({values}) > 0 THEN {body} END", cls)

    # Expressions

    def condition(self, e, scope: Scope) -> str:
        """A filter: there NULL and FALSE are alike, so that IN and NOT IN subqueries become semi and anti joins."""
        if isinstance(e, A.Binary) and e.op == "and":
            return f"{self.condition(e.left, scope)} AND {self.condition(e.right, scope)}"
        negated, inner = False, e
        while isinstance(inner, A.Unary) and inner.op == "not":
            negated, inner = not negated, inner.arg
        if isinstance(inner, A.In) and inner.query is not None:
            native = self.in_query(inner, negated, scope)
            if native:
                return native
        return truth(self.expr(e, scope))

    def in_query(self, e: A.In, negated: bool, scope: Scope) -> str | None:
        if isinstance(e.arg, A.Call) and e.arg.name == "row":
            return None
        x = value(self.expr(e.arg, scope))
        rel = self.query(e.query, self.child(scope))
        if len(rel.columns) != 1:
            raise DialectError(f"sub-select returns {len(rel.columns)} columns - expected 1")
        y = rel.columns[0]
        s = self.fresh()
        if x.cls != y.cls or (x.cls == "TEXT" and (x.coll not in (None, "BINARY"))):
            return None
        if negated == e.negated:
            return f"{x.sql} IN (SELECT {s}.k0 FROM ({rel.sql}) {s})"
        # An anti join that can shuffle, and one look at whether the subquery has rows (1) or a NULL (2).
        state = f"(SELECT CASE WHEN count(1) = 0 THEN 0 WHEN count({s}.k0) = count(1) THEN 1 ELSE 2 END FROM ({rel.sql}) {s})"
        return f"NOT EXISTS (SELECT 1 FROM ({rel.sql}) {s} WHERE {s}.k0 = {x.sql}) AND ({state} = 0 OR ({state} = 1 AND {x.sql} IS NOT NULL))"

    def child(self, scope: Scope) -> Scope:
        return Scope(parent=scope, ctes=scope.ctes)

    def column_value(self, c: Column, scope: Scope) -> E:
        if scope.group is None:
            return c.e
        for sql, e in scope.group.keys:
            if sql == c.e.sql:
                return e
        return scope.group.bare_column(c.e)

    def name(self, n: A.Name, scope: Scope) -> E:
        at: Scope | None = scope
        while at is not None:
            rows = at.group.inner if at.group is not None else at
            if (c := rows.find(n)) is not None:
                return self.column_value(c, at)
            if n.table is None and n.column.lower() in at.aliases:
                alias = at.aliases[n.column.lower()]
                if alias is not n:
                    return self.expr(alias, replace(at, aliases={k: v for k, v in at.aliases.items() if k != n.column.lower()}))
            at = at.parent
        if n.quoted:
            return literal(n.column)
        if n.table is None and n.column.lower() in ("true", "false"):
            return literal(int(n.column.lower() == "true"))
        raise DialectError(f"no such column: {n.table + '.' if n.table else ''}{n.column}")

    def expr(self, e, scope: Scope) -> E:
        if isinstance(e, Column):
            return self.column_value(e, scope)
        if scope.group is not None and not isinstance(e, A.Lit | A.Name) and not self.has_aggregate(e, scope.group.inner) and not self.window_calls(e) and not self.has_query(e):
            try:
                inner = value(self.expr(e, scope.group.inner)).sql
            except DialectError:
                inner = None
            for sql, k in scope.group.keys:
                if sql == inner:
                    return k
        return getattr(self, "lower_" + type(e).__name__.lower())(e, scope)

    def has_query(self, node) -> bool:
        if isinstance(node, A.Query):
            return True
        if isinstance(node, tuple):
            return any(self.has_query(x) for x in node)
        if hasattr(node, "__dataclass_fields__"):
            return any(self.has_query(getattr(node, f)) for f in node.__dataclass_fields__)
        return False

    def lower_lit(self, e: A.Lit, scope: Scope) -> E:
        return literal(e.value)

    def lower_name(self, e: A.Name, scope: Scope) -> E:
        return self.name(e, scope)

    def lower_collate(self, e: A.Collate, scope: Scope) -> E:
        return replace(self.expr(e.arg, scope), coll=known_collation(e.name), explicit=True, ts=None)

    def lower_cast(self, e: A.Cast, scope: Scope) -> E:
        return cast(self.expr(e.arg, scope), e.type)

    def lower_unary(self, e: A.Unary, scope: Scope) -> E:
        x = self.expr(e.arg, scope)
        if e.op == "not":
            return E(f"(NOT {truth(x)})", "BOOL")
        if e.op == "+":
            return replace(value(x), aff=None)
        if e.op == "~":
            return E(f"(~{integer(x)})", "INT")
        n = number(x)
        if n.is_const and n.const is not None:
            v = -n.const
            return literal(float(v) if isinstance(v, int) and v >= 2**63 else v)
        if n.cls == "REAL":
            return E(f"(0D - {n.sql})", "REAL") if x.cls != "ANY" else self.any_arithmetic("-", literal(0), x)
        return self.arithmetic("-", literal(0), n) if self.wide else E(f"(-{n.sql})", n.cls)

    def lower_binary(self, e: A.Binary, scope: Scope) -> E:
        if e.op in ("and", "or"):
            return E(f"({truth(self.expr(e.left, scope))} {e.op.upper()} {truth(self.expr(e.right, scope))})", "BOOL")
        if e.op in ("=", "<>", "<", "<=", ">", ">=", "is", "is not") and all(isinstance(x, A.Call) and x.name == "row" for x in (e.left, e.right)):
            return self.rows(e, scope)
        a, b = self.expr(e.left, scope), self.expr(e.right, scope)
        if e.op in ("+", "-", "*", "/", "%") and any(x.cls == "ANY" or (x.cls in ("TEXT", "BLOB") and not x.is_const) for x in (a, b)):
            return self.any_arithmetic(e.op, a, b)
        if e.op in ("is", "is not") and isinstance(e.right, A.Name) and e.right.table is None and e.right.column.lower() in ("true", "false") and b.is_const:
            t = f"coalesce({truth(a)}, FALSE)" if b.const else f"coalesce(NOT {truth(a)}, FALSE)"
            return E(f"(NOT {t})" if e.op == "is not" else t, "BOOL")
        if e.op in ("=", "<>", "<", "<=", ">", ">=", "is", "is not"):
            return compare(e.op, a, b)
        if e.op == "||":
            if a.is_const and b.is_const and isinstance(a.const, str) and isinstance(b.const, str):
                return literal(a.const + b.const)
            return E(f"concat({text(a)}, {text(b)})", "TEXT")
        if e.op in ("&", "|"):
            return E(f"({integer(a)} {e.op} {integer(b)})", "INT")
        if e.op in ("<<", ">>"):
            x, n = integer(a), integer(b)
            left, right = (n, f"-({n})") if e.op == "<<" else (f"-({n})", n)
            return E(f"CASE WHEN {left} >= 64L THEN 0L WHEN {left} >= 0L THEN shiftleft({x}, CAST({left} AS INT)) WHEN {right} >= 64L THEN if({x} < 0L, -1L, 0L) ELSE shiftright({x}, CAST({right} AS INT)) END", "INT")
        return self.arithmetic(e.op, number(a), number(b))

    def arithmetic(self, op: str, a: E, b: E) -> E:
        """Integers stay integers; constants that overflow become reals. Columns that overflow do so in a ``wide`` lowering, else they raise."""
        if a.is_const and b.is_const:
            if a.const is None or b.const is None:
                return E("CAST(NULL AS BIGINT)", "INT", is_const=True)
            return literal(_fold(op, a.const, b.const))
        if op == "%":
            if a.cls == b.cls == "INT":
                return E(f"if({b.sql} = -1L, if({a.sql} IS NULL, NULL, 0L), {a.sql} % nullif({b.sql}, 0L))", "INT") if not b.is_const else E(f"({a.sql} % nullif({b.sql}, 0L))", "INT")
            return E(f"CAST({integer(a)} % nullif({integer(b)}, 0L) AS DOUBLE)", "REAL")
        if a.cls == b.cls == "INT":
            if op == "/":
                return E(f"({a.sql} div nullif({b.sql}, 0L))", "INT")
            if self.wide:
                made = f"{ {'+': 'try_add', '-': 'try_subtract', '*': 'try_multiply'}[op] }({a.sql}, {b.sql})"
                over = any_of(E(f"(CAST({a.sql} AS DOUBLE) {op} CAST({b.sql} AS DOUBLE))", "REAL"))
                return E(f"if({made} IS NULL, {over}, {any_of(E(made, 'INT'))})", "ANY")
            return E(f"({a.sql} {op} {b.sql})", "INT")
        x, y = real(a), real(b)
        if op == "/":
            return E(f"({x} / nullif({y}, 0D))", "REAL")
        return E(f"({x} {op} {y})", "REAL")

    def any_arithmetic(self, op: str, a: E, b: E) -> E:
        """Integers of both sides give an integer, else the result is a real."""
        # Text counts by its numeric prefix: an integer unless that has a fraction or an exponent.
        is_int = lambda v: f"coalesce(if({v}.c = 1, {v}.k = 0, NOT rlike({text(E(v, 'ANY'))}, '{REAL_PREFIX}')), FALSE)"

        def body(v: str) -> str:
            x, y = f"{v}.x", f"{v}.y"
            i = self.arithmetic(op, E(f"({integer(E(x, 'ANY'))})", "INT"), E(f"({integer(E(y, 'ANY'))})", "INT"))
            if i.cls == "ANY":  # of a wide lowering, which looks for overflow itself
                return f"if({is_int(x)} AND {is_int(y)}, {i.sql}, {any_of(self.arithmetic(op, number(E(x, 'ANY')), number(E(y, 'ANY'))))})"
            r = self.arithmetic(op, number(E(x, "ANY")), number(E(y, "ANY")))
            if op == "%":  # of integers, that is of text's integer prefixes, whatever the result's class
                r = E(f"CAST(({integer(E(x, 'ANY'))}) % nullif(({integer(E(y, 'ANY'))}), 0L) AS DOUBLE)", "REAL")
            both = f"{is_int(x)} AND {is_int(y)}"
            return f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN NULL WHEN {both} THEN named_struct('i', {i.sql}, 'r', CAST(NULL AS DOUBLE)) ELSE named_struct('i', CAST(NULL AS BIGINT), 'r', {r.sql}) END"

        made = let(f"named_struct('x', {any_of(a)}, 'y', {any_of(b)})", body)
        if self.wide and op in ("+", "-", "*"):
            return E(made, "ANY")
        return E(let(made, lambda v: f"CASE WHEN {v}.i IS NOT NULL THEN {any_of(E(v + '.i', 'INT'))} ELSE {any_of(E(v + '.r', 'REAL'))} END"), "ANY")

    def rows(self, e: A.Binary, scope: Scope) -> E:
        a, b = e.left.args, e.right.args
        if len(a) != len(b):
            raise DialectError("row value misused")
        pairs = [(self.expr(x, scope), self.expr(y, scope)) for x, y in zip(a, b, strict=True)]
        if e.op in ("=", "is"):
            return E("(" + " AND ".join(compare(e.op, x, y).sql for x, y in pairs) + ")", "BOOL")
        if e.op in ("<>", "is not"):
            return E("(" + " OR ".join(compare(e.op, x, y).sql for x, y in pairs) + ")", "BOOL")
        out = compare(e.op, *pairs[-1]).sql
        for x, y in reversed(pairs[:-1]):
            out = f"({compare(e.op[0], x, y).sql} OR ({compare('=', x, y).sql} AND {out}))"
        return E(out, "BOOL")

    def lower_between(self, e: A.Between, scope: Scope) -> E:
        x = self.expr(e.arg, scope)
        sql = f"({compare('>=', x, self.expr(e.low, scope)).sql} AND {compare('<=', x, self.expr(e.high, scope)).sql})"
        return E(f"(NOT {sql})" if e.negated else sql, "BOOL")

    def lower_in(self, e: A.In, scope: Scope) -> E:
        if e.query is not None:
            return self.in_value(e, scope)
        if not e.items:
            return literal(int(e.negated))
        x = value(self.expr(e.arg, scope))
        items = [value(self.expr(i, scope)) for i in e.items]
        # Only the left side's affinity and collation count, unless the list is one constant.
        if len(items) > 1:
            items = [replace(i, coll=None, explicit=False) for i in items]
        same = [i for i in items if i.is_const and i.cls == x.cls]
        if len(same) == len(items) and len(items) > 1:
            k = lambda s: collation_key(s, x.coll) if x.cls == "TEXT" else s
            sql = f"({k(x.sql)} IN ({', '.join(k(i.sql) for i in items)}))"
        else:
            sql = "(" + " OR ".join(compare("=", x, replace(i, aff=None)).sql for i in items) + ")"
        return E(f"(NOT {sql})" if e.negated else sql, "BOOL")

    def in_value(self, e: A.In, scope: Scope) -> E:
        """IN (SELECT) as a value, with its NULL results spelled out."""
        lefts = e.arg.args if isinstance(e.arg, A.Call) and e.arg.name == "row" else (e.arg,)
        xs = [value(self.expr(a, scope)) for a in lefts]
        rel = self.query(e.query, self.child(scope))
        if len(rel.columns) != len(xs):
            raise DialectError(f"sub-select returns {len(rel.columns)} columns - expected {len(xs)}")
        s = self.fresh()
        ys = [replace(self.seen(s, i, o), explicit=False, coll=None) for i, o in enumerate(rel.columns)]
        hit = " AND ".join(compare("=", x, y).sql for x, y in zip(xs, ys, strict=True))
        maybe = " AND ".join(f"({x.sql} IS NULL OR {y.sql} IS NULL OR {compare('=', x, y).sql})" for x, y in zip(xs, ys, strict=True))
        sub = f"SELECT 1 FROM ({rel.sql}) {s}"
        if len(xs) == 1:  # one look at whether the subquery has rows (1) or a NULL (2)
            state = f"(SELECT CASE WHEN count(1) = 0 THEN 0 WHEN count({ys[0].sql}) = count(1) THEN 1 ELSE 2 END FROM ({rel.sql}) {s})"
            unknown = f"{state} = 2 OR ({state} = 1 AND {xs[0].sql} IS NULL)"
        else:
            unknown = f"EXISTS ({sub} WHERE {maybe})"
        sql = f"(CASE WHEN EXISTS ({sub} WHERE {hit}) THEN TRUE WHEN {unknown} THEN NULL ELSE FALSE END)"
        return E(f"(NOT {sql})" if e.negated else sql, "BOOL")

    def lower_like(self, e: A.Like, scope: Scope) -> E:
        x, p = self.expr(e.arg, scope), self.expr(e.pattern, scope)
        out = texts.glob(x, p) if e.kind == "glob" else texts.like(x, p, self.expr(e.escape, scope) if e.escape is not None else None)
        return E(f"(NOT {out.sql})" if e.negated else out.sql, "BOOL")

    def lower_case(self, e: A.Case, scope: Scope) -> E:
        base = self.expr(e.base, scope) if e.base is not None else None
        results = [value(self.expr(r, scope)) for _, r in e.arms] + [value(self.expr(e.other, scope)) if e.other is not None else literal(None)]
        sqls, cls = unify(results)
        arms = []
        for (c, _), r in zip(e.arms, sqls, strict=False):
            x = self.expr(c, scope)
            arms.append(f"WHEN {compare('=', base, x).sql if base is not None else truth(x)} THEN {r}")
        return E(f"CASE {' '.join(arms)} ELSE {sqls[-1]} END", cls)

    def lower_exists(self, e: A.Exists, scope: Scope) -> E:
        return E(f"EXISTS (SELECT 1 FROM ({self.query(e.query, self.child(scope)).sql}) {self.fresh()})", "BOOL")

    def lower_scalar(self, e: A.Scalar, scope: Scope) -> E:
        """The first row's value, NULL if there is none."""
        q = e.query
        if (best := self.best_row(q, scope)) is not None:
            return best
        single = isinstance(q.body, A.Core) and not q.body.group and q.body.having is None and any(self.has_aggregate(x, Scope()) for x, _ in q.body.columns if not isinstance(x, A.Star))
        plain = not single and q.limit is None and not q.order
        if not single and q.limit is None and not plain:
            q = replace(q, limit=A.Lit(1))
        rel = self.query(q, self.child(scope))
        if len(rel.columns) != 1:
            raise DialectError(f"sub-select returns {len(rel.columns)} columns - expected 1")
        o = rel.columns[0]
        sql = rel.sql
        if plain:  # an aggregate is decorrelated to a join on the correlation's keys
            s = self.fresh()
            sql = f"SELECT first({s}.k0) FROM ({rel.sql}) {s}"
        return E(f"({sql})", o.cls, o.aff, o.coll)

    def best_row(self, q: A.Query, scope: Scope) -> E | None:
        """The first row by ORDER BY as an aggregate, which is decorrelated without ranking all rows; None where it can't be one."""
        c = q.body
        if not isinstance(c, A.Core) or not q.order or q.offset is not None or q.limit not in (None, A.Lit(1)) or c.group or c.having is not None or c.distinct or c.windows or len(c.columns) != 1:
            return None
        x, alias = c.columns[0]
        if isinstance(x, A.Star) or any(isinstance(t.expr, A.Lit) for t in q.order):
            return None
        terms = [x if isinstance(t.expr, A.Name) and t.expr.table is None and isinstance(alias, str) and t.expr.column.lower() == alias.lower() else t.expr for t in q.order]
        if self.window_calls([x, *terms]) or any(self.has_aggregate(e, Scope()) for e in (x, *terms)):
            return None
        columns = tuple((e, f"o{i}") for i, e in enumerate((x, *terms)))
        rel = self.query(replace(q, body=replace(c, columns=columns), order=(), limit=None), self.child(scope))
        s, by = self.fresh(), []
        for i, (o, t) in enumerate(zip(rel.columns[1:], q.order, strict=True)):
            k = key(self.seen(s, i + 1, o))
            nulls = t.nulls_first if t.nulls_first is not None else not t.descending
            if t.descending and o.cls not in ("INT", "REAL", "BOOL"):
                return None
            falling = f"(-1 - {k})" if o.cls != "REAL" else f"(-{k})"  # -1 - x never overflows
            by += [f"{s}.k{i + 1} IS {'NOT ' if nulls else ''}NULL", falling if t.descending else k]
        o = rel.columns[0]
        return E(f"(SELECT min_by(struct({s}.k0 AS v), struct({', '.join(by)})).v FROM ({rel.sql}) {s})", o.cls, o.aff, o.coll)

    def lower_call(self, c: A.Call, scope: Scope) -> E:
        if c.over is not None:
            return self.window(c, scope)
        if c.name in WINDOW_ONLY:
            raise DialectError(f"misuse of window function {c.name}()")
        if self.is_aggregate(c) or (c.star and c.name == "count"):
            at: Scope | None = scope
            if c.args and (names := self.names(c.args)):
                # An aggregate belongs to the nearest query that has one of its columns.
                while at is not None and not any((at.group.inner if at.group else at).find(n) is not None for n in names):
                    at = at.parent
            if at is None or at.group is None:
                if at is not None and at is not scope and at.group is None:
                    at = scope if scope.group is not None else None
                if at is None or at.group is None:
                    raise DialectError(f"misuse of aggregate: {c.name}()")
            g = at.group
            made = self.aggregate(c, g.inner)
            if c.name in ("min", "max"):
                x = value(self.expr(c.args[0], g.inner))
                if (c.name, key(x)) not in g.extremes:
                    g.extremes.append((c.name, key(x)))
            if made.cls == "TOTAL":
                return E(f"coalesce({g.output(made.sql, E('', 'REAL')).sql}, 0D)", "REAL")
            return g.output(made.sql, made)
        if c.star:
            raise DialectError(f"wrong number of arguments to function {c.name}()")
        if c.filter is not None or c.distinct or c.order:
            raise DialectError(f"FILTER, DISTINCT or ORDER BY may not be used with non-aggregate {c.name}()")
        if c.name in self.counters and not c.args:
            return literal(self.counters[c.name])
        args = [self.expr(a, scope) for a in c.args]
        if c.name in self.functions:
            return self.functions[c.name](args)
        out = scalar.call(c.name, args)
        if c.name in ("lower", "upper", "trim", "coalesce", "ifnull", "nullif") or out.is_const:
            return out
        return replace(out, is_const=False)


def _fold(op: str, a, b):
    """Arithmetic of constants: 64-bit integers that turn into reals on overflow, NULL on division by zero."""
    if op == "%":
        x, y = _cut(a), _cut(b)
        if y == 0:
            return None
        r = abs(x) % abs(y)
        r = -r if x < 0 else r
        return r if isinstance(a, int) and isinstance(b, int) else float(r)
    if isinstance(a, int) and isinstance(b, int):
        if op == "/":
            if b == 0:
                return None
            q = abs(a) // abs(b)
            q = -q if (a < 0) != (b < 0) else q
        else:
            q = a + b if op == "+" else a - b if op == "-" else a * b
        return q if -(2**63) <= q < 2**63 else float(q) if op == "/" else {"+": float(a) + float(b), "-": float(a) - float(b), "*": float(a) * float(b)}[op]
    a, b = float(a), float(b)
    if op == "/" and b == 0:
        return None
    try:
        x = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b}[op]()
    except OverflowError:
        return None
    return None if x != x else x


def _cut(x) -> int:
    if isinstance(x, int):
        return x
    return max(-(2**63), min(2**63 - 1, int(x))) if abs(x) != float("inf") else (2**63 - 1 if x > 0 else -(2**63))


__all__ = ["NULLS", "Column", "Lowering", "Out", "Rel", "Scope"]
