"""Scalar functions: arity and lowering."""

from __future__ import annotations

from dataclasses import replace

from brindle.plans.errors import DialectError

from . import moments, texts
from .values import E, LOWER, UPPER, any_integer, any_of, collation_key, compare, comparable, integer, key, literal, number, real, text, truth, unify, value

INT, REAL, TEXT, BLOB = "INT", "REAL", "TEXT", "BLOB"


def null_guard(sql: str, *args: E) -> str:
    return f"CASE WHEN {' OR '.join(f'{a.sql} IS NULL' for a in args)} THEN NULL ELSE {sql} END"


def _abs(a: E) -> E:
    if a.cls == "ANY":  # integers stay integers, all else counts as a real
        is_int = f"{a.sql}.c = 1 AND {a.sql}.k = 0"
        return E(f"CASE WHEN {is_int} THEN {any_of(E(f'abs({any_integer(a.sql)})', INT))} ELSE {any_of(E(f'abs({number(a).sql})', REAL))} END", "ANY")
    n = number(a)
    if a.cls in ("TEXT", "BLOB"):
        n = E(real(a), REAL)
    return E(f"abs({n.sql})", n.cls)


def _length(a: E) -> E:
    if a.cls == BLOB:
        return E(f"CAST(octet_length({a.sql}) AS BIGINT)", INT)
    if a.cls == "ANY":
        return E(f"if({a.sql}.c = 3, CAST(octet_length({a.sql}.b) AS BIGINT), CAST(char_length({text(a)}) AS BIGINT))", INT)
    return E(f"CAST(char_length(substring_index({text(a)}, char(0), 1)) AS BIGINT)", INT)


def _substr(a: E, start: E, size: E | None = None) -> E:
    """Start 0 stands before the first character; a negative length takes what precedes the start."""
    blob = a.cls == BLOB
    if a.ts and start.const == 1 and size is not None and size.is_const and isinstance(size.const, int) and 1 <= size.const <= 10:
        return E(f"substring(CAST(CAST({a.ts} AS DATE) AS STRING), 1, {size.const})", TEXT)  # the date alone, without a formatter
    x, s = (a.sql if blob else text(a)), integer(start)
    n = f"{'octet_length' if blob else 'char_length'}({x})"
    if size is None:
        sql = f"substring({x}, CAST(CASE WHEN {s} > 0 THEN least({s}, 2147483647L) WHEN {s} = 0 THEN 1L WHEN -{s} > {n} THEN 1L ELSE {s} END AS INT))"
    else:
        z = integer(size)
        # First and last position (from 1) before clipping, the start counted from the end if it is negative.
        at = f"CASE WHEN {s} < 0 THEN {s} + {n} + 1 ELSE {s} END"
        low = f"(CASE WHEN {z} < 0 THEN ({at}) + {z} ELSE {at} END)"
        high = f"(CASE WHEN {z} < 0 THEN ({at}) - 1 ELSE ({at}) + {z} - 1 END)"
        sql = f"CASE WHEN {high} < 1 OR {high} < {low} THEN {chr(39) * 2 if not blob else 'X' + chr(39) * 2} ELSE substring({x}, CAST(greatest({low}, 1L) AS INT), CAST(least({high}, CAST({n} AS BIGINT)) - greatest({low}, 1L) + 1 AS INT)) END"
        sql = null_guard(sql, a, start, size)
    return E(sql, BLOB if blob else TEXT)


def _trim(kind: str):
    def lower(a: E, chars: E | None = None) -> E:
        x = text(a)
        if chars is None:
            return E(f"{kind}({x})" if kind != "trim" else f"trim({x})", TEXT)
        c = text(chars)
        where = {"trim": "BOTH", "ltrim": "LEADING", "rtrim": "TRAILING"}[kind]
        return E(f"if({c} = '', {x}, trim({where} {c} FROM {x}))", TEXT)

    return lower


def _round(a: E, digits: E | None = None) -> E:
    if digits is None:
        return E(f"round({real(a)}, 0)", REAL)
    if digits.is_const and isinstance(digits.const, int):
        n = max(0, min(30, digits.const))
        x = real(a)
        return E(f"if(abs({x}) >= 4503599627370496D, {x}, round({x}, {n}))", REAL)
    # Spark's round() takes constant digits only: the format of so many digits rounds half away from zero too.
    x, n = real(a), f"CAST(least(greatest({integer(digits)}, 0L), 30L) AS INT)"
    return E(null_guard(f"if(abs({x}) >= 4503599627370496D, {x}, CAST(format_string(concat('%.', {n}, 'f'), {x}) AS DOUBLE))", a, digits), REAL)


def _sign(a: E) -> E:
    if a.cls in ("TEXT", "BLOB", "NULL"):
        if a.is_const:
            return literal(None)
        return E(f"CAST(signum(CASE WHEN rlike({text(a)}, '{texts.LOOKS_NUMERIC}') THEN {real(a)} END) AS BIGINT)", INT)
    return E(f"CAST(signum({number(a).sql}) AS BIGINT)", INT)


def _instr(a: E, b: E) -> E:
    if a.cls == BLOB and b.cls == BLOB:
        return E(f"CAST(instr(decode({a.sql}, 'ISO-8859-1'), decode({b.sql}, 'ISO-8859-1')) AS BIGINT)", INT)
    return E(f"CAST(instr({text(a)}, {text(b)}) AS BIGINT)", INT)


def _quote(a: E) -> E:
    a = value(a)
    if a.cls == "NULL":
        return literal("NULL")
    if a.cls == TEXT:
        body = f"concat('\\'', replace({a.sql}, '\\'', '\\'\\''), '\\'')"
    elif a.cls == BLOB:
        body = f"concat('X\\'', hex({a.sql}), '\\'')"
    elif a.cls == "ANY":
        parts = {2: _quote(E(f"{a.sql}.t", TEXT)).sql, 3: _quote(E(f"{a.sql}.b", BLOB)).sql}
        body = f"CASE WHEN {a.sql}.c = 2 THEN {parts[2]} WHEN {a.sql}.c = 3 THEN {parts[3]} ELSE {text(a)} END"
    elif a.cls == REAL:
        body = f"CASE WHEN {a.sql} = CAST('Infinity' AS DOUBLE) THEN '9.0e+999' WHEN {a.sql} = CAST('-Infinity' AS DOUBLE) THEN '-9.0e+999' ELSE {text(a)} END"
    else:
        body = text(a)
    return E(f"coalesce({body}, 'NULL')", TEXT)


def _extreme(kind: str):
    def lower(*args: E) -> E:
        args = tuple(value(a) for a in args)
        if all(a.cls == TEXT for a in args):
            coll = next((a.coll for a in args if a.coll not in (None, "BINARY")), None)
            if coll:
                pairs = ", ".join(f"struct({collation_key(a.sql, coll)} AS k, {i} AS i, {a.sql} AS v)" for i, a in enumerate(args))
                return E(null_guard(f"{'greatest' if kind == 'max' else 'least'}({pairs}).v", *args), TEXT)
        items, cls = unify(list(args))
        return E(null_guard(f"{'greatest' if kind == 'max' else 'least'}({', '.join(items)})", *args), cls)

    return lower


def _nullif(a: E, b: E) -> E:
    a = value(a)
    return E(f"CASE WHEN {compare('=', replace(a, aff=None), replace(value(b), aff=None)).sql} THEN NULL ELSE {a.sql} END", a.cls)


def _coalesce(*args: E) -> E:
    items, cls = unify([value(a) for a in args])
    return E(f"coalesce({', '.join(items)})", cls)


def _iif(c: E, a: E, b: E | None = None) -> E:
    items, cls = unify([value(a), value(b) if b is not None else literal(None)])
    return E(f"CASE WHEN {truth(c)} THEN {items[0]} ELSE {items[1]} END", cls)


def _typeof(a: E) -> E:
    if a.cls == "ANY":
        return E(f"CASE WHEN {a.sql} IS NULL THEN 'null' WHEN {a.sql}.c = 2 THEN 'text' WHEN {a.sql}.c = 3 THEN 'blob' WHEN {a.sql}.k = 0 THEN 'integer' ELSE 'real' END", TEXT)
    name = {"INT": "integer", "BOOL": "integer", "REAL": "real", "TEXT": "text", "BLOB": "blob", "NULL": "null"}[a.cls]
    return literal("null") if a.cls == "NULL" else E(f"if({a.sql} IS NULL, 'null', '{name}')", TEXT)


def _nan_to_null(sql: str) -> str:
    return f"nullif({sql}, CAST('NaN' AS DOUBLE))"


def _math(name: str):
    return lambda a: E(_nan_to_null(f"{name}({real(a)})"), REAL)


def _log(a: E, b: E | None = None) -> E:
    if b is None:
        return E(f"CASE WHEN {real(a)} > 0D THEN log10({real(a)}) END", REAL)
    return E(f"CASE WHEN {real(a)} > 0D AND {real(a)} <> 1D AND {real(b)} > 0D THEN ln({real(b)}) / ln({real(a)}) END", REAL)


def _rounding(name: str):
    def lower(a: E) -> E:
        n = number(a)
        if n.cls == INT:
            return n
        x = n.sql
        sql = {"ceil": f"CASE WHEN abs({x}) < 9e15D THEN CAST(ceil({x}) AS DOUBLE) ELSE {x} END", "floor": f"CASE WHEN abs({x}) < 9e15D THEN CAST(floor({x}) AS DOUBLE) ELSE {x} END", "trunc": f"CASE WHEN abs({x}) < 9e15D THEN CAST(CAST({x} AS BIGINT) AS DOUBLE) ELSE {x} END"}[name]
        return E(sql, REAL)

    return lower


def _replace(a: E, b: E, c: E) -> E:
    return E(null_guard(f"if({text(b)} = '', {text(a)}, replace({text(a)}, {text(b)}, {text(c)}))", a, b, c), TEXT)


def _unhex(a: E, ignore: E | None = None) -> E:
    x = text(a) if ignore is None else f"translate({text(a)}, {text(ignore)}, '')"
    return E(f"CASE WHEN rlike({x}, '^([0-9A-Fa-f][0-9A-Fa-f])*$') THEN unhex({x}) END", BLOB)


def _hex(a: E) -> E:
    x = a.sql if a.cls == BLOB else text(a)
    return E(f"coalesce(hex({x}), '')", TEXT)


def _concat_ws(sep: E, *args: E) -> E:
    return E(f"concat_ws({text(sep)}, {', '.join(text(a) for a in args)})", TEXT)


def _like(pattern: E, x: E, escape: E | None = None) -> E:
    return texts.like(x, pattern, escape)


FUNCTIONS: dict[str, tuple[int, int, object]] = {
    "typeof": (1, 1, _typeof),
    "abs": (1, 1, _abs),
    "char": (0, 999, lambda *a: texts.char(*a)),
    "coalesce": (2, 999, _coalesce),
    "ifnull": (2, 2, _coalesce),
    "concat": (1, 999, lambda *a: E(f"concat_ws('', {', '.join(text(x) for x in a)})", TEXT)),
    "concat_ws": (2, 999, _concat_ws),
    "format": (0, 999, lambda *a: texts.printf(*a)),
    "printf": (0, 999, lambda *a: texts.printf(*a)),
    "glob": (2, 2, lambda p, x: texts.glob(x, p)),
    "like": (2, 3, _like),
    "hex": (1, 1, _hex),
    "unhex": (1, 2, _unhex),
    "instr": (2, 2, _instr),
    "length": (1, 1, _length),
    "octet_length": (1, 1, lambda a: E(f"CAST(octet_length({a.sql if a.cls == BLOB else text(a)}) AS BIGINT)", INT)),
    "likelihood": (2, 2, lambda a, b: value(a)),
    "likely": (1, 1, value),
    "unlikely": (1, 1, value),
    "lower": (1, 1, lambda a: E(f"translate({text(a)}, '{UPPER}', '{LOWER}')", TEXT)),
    "upper": (1, 1, lambda a: E(f"translate({text(a)}, '{LOWER}', '{UPPER}')", TEXT)),
    "trim": (1, 2, _trim("trim")),
    "ltrim": (1, 2, _trim("ltrim")),
    "rtrim": (1, 2, _trim("rtrim")),
    "max": (2, 999, _extreme("max")),
    "min": (2, 999, _extreme("min")),
    "nullif": (2, 2, _nullif),
    "quote": (1, 1, _quote),
    "replace": (3, 3, _replace),
    "round": (1, 2, _round),
    "sign": (1, 1, _sign),
    "substr": (2, 3, _substr),
    "substring": (2, 3, _substr),
    "unicode": (1, 1, lambda a: E(f"CASE WHEN {text(a)} <> '' THEN CAST(ascii({text(a)}) AS BIGINT) END", INT)),
    "zeroblob": (1, 1, lambda a: E(f"unhex(repeat('00', CAST(greatest({integer(a)}, 0L) AS INT)))", BLOB)),
    "iif": (2, 3, _iif),
    "if": (2, 3, _iif),
    **{n: (1, 1, _math(n)) for n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh", "exp", "sqrt", "degrees", "radians")},
    "atan2": (2, 2, lambda a, b: E(f"atan2({real(a)}, {real(b)})", REAL)),
    "pow": (2, 2, lambda a, b: E(_nan_to_null(f"power({real(a)}, {real(b)})"), REAL)),
    "power": (2, 2, lambda a, b: E(_nan_to_null(f"power({real(a)}, {real(b)})"), REAL)),
    "ln": (1, 1, lambda a: E(f"CASE WHEN {real(a)} > 0D THEN ln({real(a)}) END", REAL)),
    "log10": (1, 1, lambda a: E(f"CASE WHEN {real(a)} > 0D THEN log10({real(a)}) END", REAL)),
    "log2": (1, 1, lambda a: E(f"CASE WHEN {real(a)} > 0D THEN log2({real(a)}) END", REAL)),
    "log": (1, 2, _log),
    "mod": (2, 2, lambda a, b: E(f"{real(a)} % nullif({real(b)}, 0D)", REAL)),
    "ceil": (1, 1, _rounding("ceil")),
    "ceiling": (1, 1, _rounding("ceil")),
    "floor": (1, 1, _rounding("floor")),
    "trunc": (1, 1, _rounding("trunc")),
    "pi": (0, 0, lambda: E("pi()", REAL)),
    "date": (0, 999, lambda *a: moments.render("date", *a)),
    "time": (0, 999, lambda *a: moments.render("time", *a)),
    "datetime": (0, 999, lambda *a: moments.render("datetime", *a)),
    "julianday": (0, 999, lambda *a: moments.render("julianday", *a)),
    "unixepoch": (0, 999, lambda *a: moments.render("unixepoch", *a)),
    "strftime": (1, 999, lambda *a: moments.strftime(*a)),
    "timediff": (2, 2, lambda a, b: moments.timediff(a, b)),
}


def call(name: str, args: list[E]) -> E:
    if name not in FUNCTIONS:
        raise DialectError(f"no such function: {name}")
    low, high, lower = FUNCTIONS[name]
    if not low <= len(args) <= high:
        raise DialectError(f"wrong number of arguments to function {name}()")
    return lower(*args)


__all__ = ["FUNCTIONS", "call", "comparable", "key"]
