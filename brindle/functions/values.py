"""Expressions with their storage class, affinity and collation, and conversions between classes."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from brindle.plans.errors import DialectError, Unsupported

NUMERIC_PREFIX = r"^[ \\t\\n\\x0b\\f\\r]*([+-]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
INTEGER_PREFIX = r"^[ \\t\\n\\x0b\\f\\r]*([+-]?[0-9]+)"
REAL_PREFIX = r"^[ \\t\\n\\x0b\\f\\r]*[+-]?(?:[0-9]+\\.|\\.[0-9]|[0-9]+[eE][+-]?[0-9])"
LOOKS_NUMERIC = r"^[ \\t\\n\\x0b\\f\\r]*[+-]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?[ \\t\\n\\x0b\\f\\r]*$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class E:
    """A Spark SQL expression. ``cls``: INT, REAL, TEXT, BLOB, BOOL (an INT 0 or 1), NULL, or ANY: a class for each row.

    An ANY value is a struct (c, d, lo, t, b, k): c is 1 for numbers, 2 for text, 3 for blobs; a number is d + lo, with
    k 0 for integers and 1 for reals. Field by field that is the dialect's order over all classes, and exact for
    integers beyond a double's digits.
    """

    sql: str
    cls: str
    aff: str | None = None
    coll: str | None = None
    explicit: bool = False  # the collation comes from COLLATE
    ts: str | None = None  # the timestamp that this TEXT renders
    const: object = None
    is_const: bool = False


def affinity(declared: str) -> str:
    """Affinity of a declared type, by the words that occur in it."""
    t = declared.upper()
    if "INT" in t:
        return "INTEGER"
    if any(w in t for w in ("CHAR", "CLOB", "TEXT")):
        return "TEXT"
    if not t or "BLOB" in t:
        return "BLOB"
    return "REAL" if any(w in t for w in ("REAL", "FLOA", "DOUB")) else "NUMERIC"


def quoted(text: str) -> str:
    out = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t").replace("\0", "\\0")
    return f"'{out}'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(v) -> E:
    if v is None:
        return E("CAST(NULL AS STRING)", "NULL", const=None, is_const=True)
    if isinstance(v, bool | int):
        v = int(v)
        return E(f"{v}L" if v >= 0 else f"({v}L)" if v > -(2**63) else "(-9223372036854775807L - 1L)", "INT", const=v, is_const=True)
    if isinstance(v, float):
        if math.isinf(v):
            sql = f"CAST('{'-' if v < 0 else ''}Infinity' AS DOUBLE)"
        else:
            sql = f"{v!r}D" if v >= 0 else f"({v!r}D)"
        return E(sql, "REAL", const=v, is_const=True)
    if isinstance(v, str):
        return E(quoted(v), "TEXT", const=v, is_const=True)
    return E(f"X'{v.hex()}'", "BLOB", const=v, is_const=True)


ANY_TYPE = "STRUCT<c: TINYINT, d: DOUBLE, lo: BIGINT, t: STRING, b: BINARY, k: TINYINT>"
NULLS = {"ANY": f"CAST(NULL AS {ANY_TYPE})", "INT": "CAST(NULL AS BIGINT)", "BOOL": "CAST(NULL AS BOOLEAN)", "REAL": "CAST(NULL AS DOUBLE)", "TEXT": "CAST(NULL AS STRING)", "BLOB": "CAST(NULL AS BINARY)", "NULL": "CAST(NULL AS STRING)"}


def value(e: E) -> E:
    """The same with truth values as integers."""
    return replace(e, sql=f"CAST({e.sql} AS BIGINT)", cls="INT") if e.cls == "BOOL" else e


def _any(x: str, c: int, d: str = "0D", lo: str = "0L", t: str = "CAST(NULL AS STRING)", b: str = "CAST(NULL AS BINARY)", k: int = 0) -> str:
    return f"if({x} IS NULL, {NULLS['ANY']}, CAST(struct({c}Y, {d}, {lo}, {t}, {b}, {k}Y) AS {ANY_TYPE}))"


def any_of(e: E) -> str:
    """A value of any class as an ANY."""
    e = value(e)
    x = e.sql
    if e.cls == "ANY":
        return x
    if e.cls == "NULL":
        return NULLS["ANY"]
    if e.cls == "INT":
        lo = f"if({x} BETWEEN -9007199254740992L AND 9007199254740992L, 0L, CAST(CAST({x} AS DECIMAL(20, 0)) - CAST(CAST({x} AS DOUBLE) AS DECIMAL(20, 0)) AS BIGINT))"
        return _any(x, 1, f"CAST({x} AS DOUBLE)", lo)
    if e.cls == "REAL":
        return _any(x, 1, f"{x} + 0D", k=1)
    return _any(x, 2, t=x) if e.cls == "TEXT" else _any(x, 3, b=x)


def any_integer(x: str) -> str:
    """The integer of an ANY that holds one."""
    return f"if(abs({x}.d) < 9007199254740992D, CAST({x}.d AS BIGINT), CAST(CAST({x}.d AS DECIMAL(20, 0)) + CAST({x}.lo AS DECIMAL(20, 0)) AS BIGINT))"


def let(sql: str, body) -> str:
    """``body`` of a name bound to ``sql``, so that it is computed once."""
    let.count += 1
    v = f"m{let.count}"
    return f"element_at(transform(array({sql}), {v} -> {body(v)}), 1)"


let.count = 0


def has_subquery(sql: str) -> bool:
    return "SELECT " in sql


def shortest(x: str) -> str:
    """A double as Java writes it, with the fewest digits that read back as it, of these the nearest.

    Java 17 has too many digits for some doubles below 1e-3 or from 2**53 on (2e23 is 1.9999999999999998E23). These digits,
    or all digits of an integer below 1e38, are cut down to 15, 16 and 17, either way, till they read back. Doubles of
    full precision that Java writes with 15 digits have no other text so short. No lambda looks into one around it: Spark
    can't take such a value into a Python function. Nor can it bind a subquery: that keeps Java's digits.
    """
    if has_subquery(x):
        return f"CAST({x} AS STRING)"

    def whole(a: str) -> str:
        high = f"floor({a} / 18446744073709551616D)"
        low = f"CAST(({a} - CAST({high} AS DOUBLE) * 18446744073709551616D) / 2D AS BIGINT)"
        return f"CAST(CAST({high} AS DECIMAL(20, 0)) * 18446744073709551616BD + CAST({low} AS DECIMAL(20, 0)) * 2BD AS STRING)"

    def cut(n: str, i: str) -> str:
        k, rest, power = f"CAST(substring({n}.t, 1, {i} + 1) AS BIGINT)", f"substring({n}.t, {i} + 2)", f"{n}.e - {i}"
        same = lambda k: f"CAST(concat({k}, 'E', {power}) AS DOUBLE) = {n}.a"
        half = f"rpad('5', length({rest}), '0')"
        down = f"({rest} = '' OR {rest} < {half} OR ({rest} = {half} AND {k} % 2 = 0))"
        best = f"CASE WHEN {same(k)} AND ({down} OR NOT {same(f'({k} + 1)')}) THEN {k} WHEN {same(f'({k} + 1)')} THEN {k} + 1 END"
        return f"named_struct('k', CASE WHEN {i} >= 14 OR {n}.a < 2.3e-308D THEN {best} END, 'e', {power} - 1)"

    def written(c: str) -> str:
        k = f"CAST({c}.k AS STRING)"
        d = f"rtrim('0', {k})"
        return f"concat(substring({d}, 1, 1), '.', if(length({d}) = 1, '0', substring({d}, 2)), 'E', {c}.e + length({k}))"

    def searched(m: str) -> str:
        mantissa = f"substring_index({m}.s, 'E', 1)"
        own = f"named_struct('a', {m}.a, 't', rpad(replace({mantissa}, '.', ''), 17, '0'), 'e', CAST(substring_index({m}.s, 'E', -1) AS INT))"
        exact = let(f"named_struct('a', {m}.a, 't', {whole(f'{m}.a')})", lambda w: f"named_struct('a', {w}.a, 't', concat({w}.t, '0'), 'e', length({w}.t) - 1)")
        cuts = lambda n: f"filter(transform(array_repeat({n}, 17), (n, i) -> {cut('n', 'i')}), c -> c.k IS NOT NULL)[0]"
        found = let(f"if({m}.a >= {2**53}D AND {m}.a < 1e38D, {exact}, {own})", lambda n: let(cuts(n), written))
        return f"CASE WHEN {m}.a = 0D OR ({m}.a >= 2.3e-308D AND length({mantissa}) <= 16) THEN {m}.s WHEN {m}.a IS NOT NULL THEN {found} END"

    found = let(f"abs({x})", lambda a: let(f"named_struct('a', {a}, 's', CAST({a} AS STRING))", searched))
    return f"CASE WHEN abs({x}) >= 1e-3D AND abs({x}) < {2**53}D THEN CAST({x} AS STRING) ELSE concat(if({x} < 0D, '-', ''), {found}) END"


def real_text(x: str) -> str:
    """A double as text: shortest digits, plain from 1e-4 up to 1e16, else with a two-digit exponent."""

    def other(v: str, s: str) -> str:
        plain = f"regexp_replace(CAST(CAST({s} AS DECIMAL(38, 21)) AS STRING), '(\\\\.[0-9]+?)0+$', '$1')"
        power = f"regexp_replace(regexp_replace(regexp_replace({s}, 'E([0-9])', 'e+$1'), 'E-', 'e-'), 'e([+-])([0-9])$', 'e$10$2')"
        return f"if(abs({v}) >= 1e-4D AND abs({v}) < 1e16D, {plain}, {power})"

    if has_subquery(x):
        found = other(x, shortest(x))
    else:
        found = let(x, lambda v: let(f"named_struct('v', {v}, 's', {shortest(v)})", lambda m: other(f"{m}.v", f"{m}.s")))
    return f"CASE WHEN {x} = 0D THEN '0.0' WHEN abs({x}) = CAST('Infinity' AS DOUBLE) THEN CASE WHEN {x} > 0D THEN 'Inf' ELSE '-Inf' END WHEN abs({x}) >= 1e-3D AND abs({x}) < 1e7D THEN CAST({x} AS STRING) ELSE {found} END"


def text(e: E) -> str:
    if e.cls == "TEXT" or e.cls == "NULL":
        return e.sql
    if e.cls == "REAL":
        return f"({real_text(e.sql)})"
    if e.cls == "BLOB":
        return f"decode({e.sql}, 'UTF-8')"
    if e.cls == "ANY":
        x = e.sql
        return f"(CASE WHEN {x}.c = 2 THEN {x}.t WHEN {x}.c = 3 THEN decode({x}.b, 'UTF-8') WHEN {x}.k = 0 THEN CAST({any_integer(x)} AS STRING) ELSE {real_text(x + '.d')} END)"
    return f"CAST({value(e).sql} AS STRING)"


def real_to_int(x: str) -> str:
    return f"CASE WHEN {x} >= 9223372036854775807D THEN 9223372036854775807L WHEN {x} <= -9223372036854775808D THEN (-9223372036854775807L - 1L) ELSE CAST({x} AS BIGINT) END"


def number(e: E) -> E:
    """A numeric value: text and blobs count by their numeric prefix, as REAL unless that is an integer literal."""
    if e.cls in ("INT", "BOOL"):
        return value(e)
    if e.cls == "REAL":
        return e
    if e.cls == "NULL":
        return E("CAST(NULL AS BIGINT)", "INT", is_const=True)
    if e.cls == "ANY":
        t = E(f"if({e.sql}.c = 2, {e.sql}.t, decode({e.sql}.b, 'UTF-8'))", "TEXT")
        return E(f"if({e.sql}.c = 1, {e.sql}.d + {e.sql}.lo, {number(t).sql})", "REAL")
    if e.is_const:
        import re

        m = re.match(r"[ \t\n\x0b\f\r]*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)", e.const if isinstance(e.const, str) else e.const.decode("utf-8", "replace"))
        raw = m[1] if m else "0"
        whole = re.fullmatch(r"[+-]?\d+", raw)
        return literal(int(raw) if whole and abs(int(raw)) < 2**63 else float(raw))
    return E(f"coalesce(CAST(nullif(regexp_extract({text(e)}, '{NUMERIC_PREFIX}', 1), '') AS DOUBLE), if({e.sql} IS NULL, NULL, 0D))", "REAL")


def real(e: E) -> str:
    n = number(e)
    return n.sql if n.cls == "REAL" else f"CAST({n.sql} AS DOUBLE)"


def integer(e: E) -> str:
    """CAST(e AS INTEGER): text by its integer prefix, reals cut off and held within 64 bits."""
    if e.cls in ("INT", "BOOL"):
        return value(e).sql
    if e.cls == "REAL":
        return real_to_int(e.sql)
    if e.cls == "NULL":
        return "CAST(NULL AS BIGINT)"
    if e.cls == "ANY":
        t = E(f"if({e.sql}.c = 2, {e.sql}.t, decode({e.sql}.b, 'UTF-8'))", "TEXT")
        return f"CASE WHEN {e.sql}.c = 1 AND {e.sql}.k = 0 THEN {any_integer(e.sql)} WHEN {e.sql}.c = 1 THEN {real_to_int(e.sql + '.d')} ELSE {integer(t)} END"
    x = f"CAST(nullif(regexp_extract({text(e)}, '{INTEGER_PREFIX}', 1), '') AS DECIMAL(38, 0))"
    return f"CASE WHEN {e.sql} IS NULL THEN NULL WHEN {x} IS NULL THEN 0L ELSE CAST(least(greatest({x}, -9223372036854775808BD), 9223372036854775807BD) AS BIGINT) END"


def truth(e: E) -> str:
    """A condition: numbers other than 0; text by its numeric prefix."""
    if e.cls == "BOOL":
        return e.sql
    if e.cls == "NULL":
        return "CAST(NULL AS BOOLEAN)"
    n = number(e)
    return f"({n.sql} <> {'0D' if n.cls == 'REAL' else '0L'})"


def cast(e: E, declared: str) -> E:
    a = affinity(declared)
    if a == "TEXT":
        return E(text(e) if e.cls != "NULL" else NULLS["TEXT"], "TEXT", a, e.coll)
    if a == "INTEGER":
        return E(integer(e), "INT", a, e.coll)
    if a == "REAL":
        return E(real(e), "REAL", a, e.coll)
    if e.cls == "ANY" and a == "BLOB":
        return E(f"if({e.sql}.c = 3, {e.sql}.b, CAST({text(e)} AS BINARY))", "BLOB", a, e.coll)
    if e.cls == "ANY":  # numbers stay as they are
        t = E(f"if({e.sql}.c = 2, {e.sql}.t, decode({e.sql}.b, 'UTF-8'))", "TEXT")
        whole = f"NOT rlike({t.sql}, '{REAL_PREFIX}')"
        return E(f"CASE WHEN {e.sql} IS NULL OR {e.sql}.c = 1 THEN {e.sql} WHEN {whole} THEN {any_of(E(f'({integer(t)})', 'INT'))} ELSE {any_of(number(t))} END", "ANY", a, e.coll)
    if a == "BLOB":
        return E(f"CAST({text(e)} AS BINARY)" if e.cls != "BLOB" else e.sql, "BLOB", a, e.coll)
    n = number(e)
    return E(n.sql, n.cls, a, e.coll)


def constant_stored(e: E, aff: str) -> E:
    """A constant after a column's affinity."""
    v = e.const
    if not e.is_const or v is None or isinstance(v, bytes):
        return e
    if aff == "TEXT":
        return e if isinstance(v, str) else replace(e, sql=text(e), cls="TEXT")
    if aff in ("INTEGER", "NUMERIC", "REAL") and isinstance(v, str):
        e = _numeric(e)
        v = e.const
    if aff == "REAL" and isinstance(v, int):
        return literal(float(v))
    if aff in ("INTEGER", "NUMERIC") and isinstance(v, float) and v.is_integer() and abs(v) < 2**63:
        return literal(int(v))
    return e


def any_stored(e: E, aff: str) -> str:
    """A value after a column's affinity, in a column of class ANY."""
    if e.cls == "ANY" and aff in ("REAL", "INTEGER", "NUMERIC"):
        x, k = e.sql, 0 if aff == "REAL" else 1
        other = any_of(E(f"({x}.d + {x}.lo)", "REAL")) if aff == "REAL" else any_stored(E(f"{x}.d", "REAL"), aff)
        return f"CASE WHEN {x}.c = 1 AND {x}.k = {k} THEN {other} WHEN {x}.c = 2 THEN {any_stored(E(f'{x}.t', 'TEXT'), aff)} ELSE {x} END"
    if e.cls == "ANY" and aff == "TEXT":
        return f"if({e.sql}.c = 3, {e.sql}, {any_of(E(text(e), 'TEXT'))})"
    if e.cls == "ANY" or aff in ("BLOB", "TEXT") or e.cls == "BLOB":
        return any_of(e) if aff != "TEXT" or e.cls in ("TEXT", "BLOB", "ANY") else any_of(E(text(e), "TEXT"))
    if e.cls == "TEXT":
        n = E(f"CAST(trim({e.sql}) AS DOUBLE)", "REAL")
        whole = f"rlike({e.sql}, '^[ ]*[+-]?[0-9]{{1,18}}[ ]*$')"
        made = any_of(n) if aff == "REAL" else f"if({whole}, {any_of(E(f'try_cast(trim({e.sql}) AS BIGINT)', 'INT'))}, {any_stored(n, aff)})"
        return f"CASE WHEN rlike({e.sql}, '{LOOKS_NUMERIC}') THEN {made} ELSE {any_of(e)} END"
    if e.cls == "REAL" and aff in ("INTEGER", "NUMERIC"):
        return f"if({e.sql} = floor({e.sql}) AND abs({e.sql}) < 9.2e18D, {any_of(E(f'CAST({e.sql} AS BIGINT)', 'INT'))}, {any_of(e)})"
    return any_of(E(f"CAST({e.sql} AS DOUBLE)", "REAL") if e.cls == "INT" and aff == "REAL" else e)


def fits(e: E, aff: str, cls: str) -> bool:
    """Whether a column's class surely holds the value; else the column must become one of class ANY."""
    e = value(constant_stored(e, aff))
    if e.cls in ("NULL", cls) or cls == "ANY":
        return True
    if e.cls == "INT" and cls == "REAL":
        return aff == "REAL"
    return e.cls in ("INT", "REAL") and cls == "TEXT" and aff == "TEXT"


def stored(e: E, aff: str, cls: str) -> str:
    """The value a column of an affinity holds, in the column's class; raises where that class can't hold it."""
    e = value(constant_stored(e, aff))
    if e.cls == "NULL":
        return NULLS[cls]
    if cls == "ANY":
        return any_stored(e, aff)
    if e.cls == cls:
        return e.sql
    if cls == "REAL" and e.cls == "INT":
        return f"CAST({e.sql} AS DOUBLE)"
    if cls == "TEXT" and aff == "TEXT" and e.cls in ("INT", "REAL"):
        return text(e)
    if cls == "INT" and e.cls == "REAL":
        return f"CASE WHEN {e.sql} = floor({e.sql}) AND abs({e.sql}) < 9.2e18D THEN CAST({e.sql} AS BIGINT) WHEN {e.sql} IS NULL THEN NULL ELSE raise_error('a real in an integer column needs a column of mixed classes') END"
    if cls in ("INT", "REAL") and e.cls == "TEXT":
        target = "BIGINT" if cls == "INT" else "DOUBLE"
        return f"CASE WHEN {e.sql} IS NULL THEN NULL WHEN rlike({e.sql}, '{LOOKS_NUMERIC}') THEN CAST(CAST(trim({e.sql}) AS DOUBLE) AS {target}) ELSE raise_error('text in a numeric column needs a column of mixed classes') END"
    if e.cls == "ANY" and cls in ("INT", "REAL", "TEXT"):  # of numbers and numeric text, or of text
        x = any_stored(e, aff)
        value_of, fit = {"INT": (any_integer("x"), "x.c = 1 AND x.k = 0"), "REAL": ("x.d", "x.c = 1 AND x.k = 1"), "TEXT": ("x.t", "x.c = 2")}[cls]
        return f"transform(array({x}), x -> CASE WHEN x IS NULL THEN NULL WHEN {fit} THEN {value_of} ELSE raise_error('this value needs a column of mixed classes') END)[0]"
    raise Unsupported(f"a {e.cls} value in a column of class {cls}")


def collation_key(sql: str, coll: str | None) -> str:
    if coll == "NOCASE":
        return f"translate({sql}, '{UPPER}', '{LOWER}')"
    if coll == "RTRIM":
        return f"rtrim(' ', {sql})"
    return sql


def key(e: E) -> str:
    """What equality, grouping and order of a value go by."""
    if e.cls == "ANY":
        t = collation_key(f"{e.sql}.t", e.coll)
        return f"if({e.sql} IS NULL, NULL, struct({e.sql}.c, {e.sql}.d, {e.sql}.lo, {t}, {e.sql}.b))"
    return collation_key(e.sql, e.coll) if e.cls == "TEXT" else value(e).sql


def known_collation(name: str) -> str:
    if name.upper() not in ("BINARY", "NOCASE", "RTRIM"):
        raise DialectError(f"no such collation sequence: {name}")
    return name.upper()


RANK = {"INT": 1, "REAL": 1, "BOOL": 1, "TEXT": 2, "BLOB": 3}


def comparable(a: E, b: E) -> tuple[E, E, str | None]:
    """Both sides after comparison affinity, and the collation their comparison uses."""
    coll = a.coll if a.explicit else b.coll if b.explicit else a.coll or b.coll
    a, b = value(a), value(b)
    numeric = ("INTEGER", "REAL", "NUMERIC")
    if a.aff in numeric and b.aff not in numeric:
        b = _numeric(b)
    elif b.aff in numeric and a.aff not in numeric:
        a = _numeric(a)
    elif a.aff == "TEXT" and b.aff is None and b.cls in ("INT", "REAL"):
        b = replace(b, sql=text(b), cls="TEXT")
    elif b.aff == "TEXT" and a.aff is None and a.cls in ("INT", "REAL"):
        a = replace(a, sql=text(a), cls="TEXT")
    return a, b, coll


def _numeric(e: E) -> E:
    """Numeric affinity on text: only a constant can be judged here."""
    if e.cls == "TEXT" and e.is_const:
        try:
            v = float(e.const)
        except ValueError:
            return e
        if e.const.strip().lower().lstrip("+-") in ("inf", "infinity", "nan") or "_" in e.const:
            return e
        return replace(literal(int(e.const) if e.const.strip().lstrip("+-").isdigit() and abs(v) < 2**63 else v), aff=e.aff)
    if e.cls == "TEXT":
        return E(f"CASE WHEN rlike({e.sql}, '{LOOKS_NUMERIC}') THEN CAST(trim({e.sql}) AS DOUBLE) END", "REAL")
    return e


EXACT = 2**53  # integers up to here are doubles
FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def compare_mixed(op: str, i: E, r: E) -> str:
    """An integer with a real, by value: beyond 2**53 a double has no place for every integer."""
    spark = {"is": "<=>", "is not": "<=>"}.get(op, op)
    if r.is_const and isinstance(r.const, float):
        v = r.const
        if v.is_integer() and abs(v) < 2**63:
            return f"({i.sql} {spark} {literal(int(v)).sql})"
        if abs(v) < 2**63 and op in FLIPPED:  # stays a comparison of the column, so scans can skip by it
            return f"({i.sql} {op} {literal(math.ceil(v) if op in ('<', '>=') else math.floor(v)).sql})"
    if i.is_const and abs(i.const) <= EXACT:
        return f"(CAST({i.sql} AS DOUBLE) {spark} {r.sql})"
    near = f"{i.sql} BETWEEN -{EXACT}L AND {EXACT}L"
    held = f"{r.sql} < 9223372036854775808D AND {r.sql} >= -9223372036854775808D"
    whole = f"CASE WHEN {held} THEN CAST({r.sql} AS BIGINT) END"
    equal = f"(CAST({i.sql} AS DOUBLE) = {r.sql} AND ({near} OR {i.sql} = {whole}))"
    if op in ("is", "is not"):
        return f"(({i.sql} IS NULL AND {r.sql} IS NULL) OR coalesce({equal}, FALSE))"
    if op == "=":
        return equal
    if op == "<>":
        return f"(NOT {equal})"
    beyond = f"CASE WHEN {r.sql} >= 9223372036854775808D THEN {str(op in ('<', '<=')).upper()} WHEN {r.sql} < -9223372036854775808D THEN {str(op in ('>', '>=')).upper()} ELSE {i.sql} {op} {whole} END"
    return f"(CASE WHEN {near} THEN CAST({i.sql} AS DOUBLE) {op} {r.sql} ELSE {beyond} END)"


def compare(op: str, a: E, b: E) -> E:
    """``=``, ``<>``, ``<``, ``<=``, ``>``, ``>=``, ``is`` or ``is not``."""
    a, b, coll = comparable(a, b)
    spark = {"is": "<=>", "is not": "<=>", "=": "=", "<>": "<>"}.get(op, op)
    if "NULL" in (a.cls, b.cls):
        if op in ("is", "is not"):
            other = b if a.cls == "NULL" else a
            sql = "TRUE" if a.cls == b.cls else f"({other.sql} IS NULL)"
            return E(f"(NOT {sql})" if op == "is not" else sql, "BOOL")
        return E("CAST(NULL AS BOOLEAN)", "BOOL")
    if "ANY" in (a.cls, b.cls):
        x, y = (key(E(any_of(s), "ANY", None, coll)) for s in (a, b))
        sql = f"({x} {spark} {y})"
        return E(f"(NOT {sql})" if op == "is not" else sql, "BOOL")
    if RANK[a.cls] != RANK[b.cls]:
        less = RANK[a.cls] < RANK[b.cls]
        if op in ("is", "is not"):
            both = f"({a.sql} IS NULL AND {b.sql} IS NULL)"
            return E(f"(NOT {both})" if op == "is not" else both, "BOOL")
        result = {"=": False, "<>": True, "<": less, "<=": less, ">": not less, ">=": not less}[op]
        return E(f"CASE WHEN {a.sql} IS NOT NULL AND {b.sql} IS NOT NULL THEN {str(result).upper()} END", "BOOL")
    native = _timestamps(op, a, b, coll)
    if native:
        return E(native, "BOOL")
    if a.cls != b.cls:
        sql = compare_mixed(op, a, b) if a.cls == "INT" else compare_mixed(FLIPPED.get(op, op), b, a)
    elif a.cls == "TEXT":
        sql = f"({collation_key(a.sql, coll)} {spark} {collation_key(b.sql, coll)})"
    else:
        sql = f"({a.sql} {spark} {b.sql})"
    return E(f"(NOT {sql})" if op == "is not" else sql, "BOOL")


def _timestamps(op: str, a: E, b: E, coll: str | None) -> str | None:
    """Compare a timestamp's text with a date or time literal on the timestamp itself, so that scans can skip by it."""
    import re

    if b.ts and a.is_const:
        a, b, op = b, a, FLIPPED.get(op, op)
    if a.ts and b.ts and op in ("=", "<", "<=", ">", ">=") and coll in (None, "BINARY"):
        return None
    if not a.ts or not b.is_const or coll not in (None, "BINARY"):
        return None
    v = b.const
    if re.fullmatch(r"\d{4}-\d\d-\d\d", v or ""):
        # A date is less than every time of its day.
        return {"<": f"({a.ts} < TIMESTAMP_NTZ '{v} 00:00:00')", "<=": f"({a.ts} < TIMESTAMP_NTZ '{v} 00:00:00')", ">": f"({a.ts} >= TIMESTAMP_NTZ '{v} 00:00:00')", ">=": f"({a.ts} >= TIMESTAMP_NTZ '{v} 00:00:00')"}.get(op)
    if re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", v or "") and op in ("<", ">="):
        return f"({a.ts} {op} TIMESTAMP_NTZ '{v}')"
    return None


def unify(items: list[E]) -> tuple[list[str], str]:
    """Branches of one result brought to one class."""
    classes = {e.cls for e in items} - {"NULL"}
    if classes <= {"BOOL"} and classes:
        cls = "BOOL"
    elif classes <= {"BOOL", "INT"}:
        cls = "INT" if classes else "NULL"
    else:  # an integer among reals stays one: a class for each row
        cls = next(iter(classes)) if len(classes) == 1 else "ANY"
    out = []
    for e in items:
        if e.cls == "NULL":
            out.append(NULLS[cls])
        elif cls == "ANY":
            out.append(any_of(e))
        else:
            out.append(value(e).sql if cls != "BOOL" else e.sql)
    return out, cls
