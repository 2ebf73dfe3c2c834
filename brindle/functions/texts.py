"""Patterns, code points and printf."""

from __future__ import annotations

import re

from brindle.plans.errors import DialectError, Unsupported

from . import formats
from .values import E, LOOKS_NUMERIC, LOWER, UPPER, integer, literal, quoted, real, shortest, text, value

__all__ = ["LOOKS_NUMERIC", "char", "glob", "like", "printf"]


def like(x: E, pattern: E, escape: E | None = None) -> E:
    """LIKE without regard to the case of A-Z; no character escapes unless one is given."""
    fold = lambda e: f"translate({text(e)}, '{UPPER}', '{LOWER}')"
    if escape is not None:
        if not escape.is_const or not isinstance(escape.const, str):
            raise Unsupported("an escape character that varies by row")
        if len(escape.const) != 1:
            raise DialectError("ESCAPE expression must be a single character")
        mark = escape.const
        if mark in "%_" or mark.lower() != mark or not pattern.is_const:
            if not pattern.is_const or not isinstance(pattern.const, str):
                raise Unsupported("this escape character with a pattern that varies by row")
        if pattern.is_const and isinstance(pattern.const, str):
            return E(f"rlike({fold(x)}, {quoted(_like_regex(pattern.const, mark))})", "BOOL")
        return E(f"({fold(x)} LIKE {fold(pattern)} ESCAPE {quoted(mark)})", "BOOL")
    if pattern.is_const and isinstance(pattern.const, str):
        # In the pattern the escape character stands for itself where it is doubled.
        p = pattern.const.translate(str.maketrans(UPPER, LOWER)).replace("\x01", "\x01\x01")
        return E(f"({fold(x)} LIKE {quoted(p)} ESCAPE '\x01')", "BOOL")
    return E(f"({fold(x)} LIKE replace({fold(pattern)}, '\x01', '\x01\x01') ESCAPE '\x01')", "BOOL")


def _like_regex(pattern: str, mark: str) -> str:
    out, i = ["^(?s)"], 0
    while i < len(pattern):
        c = pattern[i]
        if c == mark:
            i += 1
            if i < len(pattern):
                out.append(_plain(pattern[i].translate(str.maketrans(UPPER, LOWER))))
        else:
            out.append(".*" if c == "%" else "." if c == "_" else _plain(c.translate(str.maketrans(UPPER, LOWER))))
        i += 1
    return "".join(out) + "\\z"


def _plain(c: str) -> str:
    return "\\" + c if re.match(r"[\\^$.|?*+()\[\]{}]", c) else c


def glob_regex(pattern: str) -> str | None:
    """The regular expression of a GLOB pattern; None if it can't match anything."""
    out, i = ["^(?s)"], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            negated = i < len(pattern) and pattern[i] == "^"
            i += negated
            chars = []
            if i < len(pattern) and pattern[i] == "]":
                chars.append("\\]")
                i += 1
            while i < len(pattern) and pattern[i] != "]":
                if pattern[i] == "-" and chars and i + 1 < len(pattern) and pattern[i + 1] != "]":
                    chars.append("-")
                else:
                    chars.append("\\" + pattern[i] if re.match(r"[\\^\[\]&\-]", pattern[i]) else pattern[i])
                i += 1
            if i >= len(pattern):
                return None
            i += 1
            out.append("[" + "^" * negated + "".join(chars) + "]")
        else:
            out.append(_plain(c))
    return "".join(out) + "\\z"


def glob(x: E, pattern: E) -> E:
    """GLOB, case-sensitive. A pattern that varies by row is turned into a regular expression by replacements."""
    if pattern.is_const and isinstance(pattern.const, str):
        r = glob_regex(pattern.const)
        return E(f"rlike({text(x)}, {quoted(r)})" if r is not None else f"if({x.sql} IS NULL, NULL, FALSE)", "BOOL")
    p = text(pattern)
    marks = f"regexp_replace({p}, '([\\\\\\\\.+(){{}}|$])', '\\\\\\\\$1')"
    return E(f"rlike({text(x)}, concat('^(?s)', replace(replace({marks}, '*', '.*'), '?', '.'), '\\\\z'))", "BOOL")


def char(*args: E) -> E:
    """Text of code points: their UTF-8 bytes are put together and decoded."""
    parts = []
    for a in args:
        n = f"coalesce({integer(a)}, 0L)"
        n = f"if({n} < 0L OR {n} > 1114111L, 65533L, {n})"
        # UTF-32, big-endian, is four bytes a code point.
        parts.append(f"unhex(lpad(hex({n}), 8, '0'))")
    return E("decode(concat(" + ", ".join(parts) + "), 'UTF-32')", "TEXT") if parts else literal("")


_SPEC = re.compile(r"%([-+ 0#,!]*)(\*|\d+)?(\.(?:\*|\d*))?([hlqLjzt]*(?=[diufeEgGxXosqQwc%]))?(.)?", re.DOTALL)


def printf(*args: E) -> E:
    """printf: each conversion of a constant format as an expression of its own."""
    if not args:
        return literal(None)
    fmt, rest = args[0], list(args[1:])
    if not fmt.is_const:
        return _by_row(fmt, rest)
    if fmt.const is None:
        return literal(None)
    out, at, used = [], 0, 0
    source = fmt.const if isinstance(fmt.const, str) else text(fmt).strip("'")

    def take() -> E | None:
        nonlocal used
        used += 1
        return value(rest[used - 1]) if used <= len(rest) else None

    while at < len(source):
        m = _SPEC.match(source, at) if source[at] == "%" else None
        if m is None:
            end = source.find("%", at)
            end = len(source) if end < 0 else end
            out.append(quoted(source[at:end]))
            at = end
            continue
        flags, width, precision, _, kind = m.groups()
        at = m.end()
        if kind is None or kind not in "diufeEgGxXosqQwcp%":
            break
        if kind == "%":
            out.append("'%'")
            continue
        if width == "*":
            w = take()
            width_sql = f"CAST({integer(w)} AS INT)" if w else "0"
            if w is not None and w.is_const and isinstance(w.const, int):
                flags += "-" * (w.const < 0)
                width_sql = str(abs(w.const))
        else:
            width_sql = width
        if precision == ".*":
            p = take()
            if p is not None and not p.is_const:
                return _by_row(fmt, rest)
            p = abs(p.const) if p is not None and isinstance(p.const, int) else 0
        else:
            p = None if precision is None else int(precision[1:] or 0)
        out.append(_conversion(kind, flags, width_sql, p, take()))
    return E(f"concat({', '.join(out)})", "TEXT") if out else literal("")


def _by_row(fmt: E, rest: list[E]) -> E:
    def tagged(e: E) -> str:
        e = value(e)
        if e.cls == "ANY":
            kind = f"CASE WHEN {e.sql}.c <> 1 THEN 't' WHEN {e.sql}.k = 0 THEN 'i' ELSE 'r' END"
        else:
            kind = {"INT": "'i'", "REAL": "'r'"}.get(e.cls, "'t'")
        return f"coalesce(concat({kind}, {text(e)}), 'n')"

    given = ", ".join(map(tagged, rest))
    return E(f"{formats.NAME}({text(fmt)}, CAST(array({given}) AS ARRAY<STRING>))", "TEXT")


def _pad(body: str, flags: str, width: str | None) -> str:
    if not width or width == "0":
        return body
    side = "rpad" if "-" in flags else "lpad"
    return f"{side}({body}, greatest(char_length({body}), {width}), ' ')"


def _number_pad(sign: str, digits: str, flags: str, width: str | None) -> str:
    if "0" in flags and "-" not in flags and width:
        return f"concat({sign}, lpad({digits}, greatest(char_length({digits}), {width} - char_length({sign})), '0'))"
    return _pad(f"concat({sign}, {digits})", flags, width)


def _sign(negative: str, flags: str) -> str:
    plain = "'+'" if "+" in flags else "' '" if " " in flags else "''"
    return f"if({negative}, '-', {plain})"


def _grouped(digits: str) -> str:
    """A comma before every third digit from the right."""
    return f"regexp_replace({digits}, '(?<=[0-9])(?=(?:[0-9]{{3}})+$)', ',')"


def _conversion(kind: str, flags: str, width: str | None, p: int | None, a: E | None) -> str:
    if kind in "di":
        x = f"coalesce({integer(a)}, 0L)" if a else "0L"
        digits = f"replace(CAST({x} AS STRING), '-', '')"
        if p:
            digits = f"lpad({digits}, greatest(char_length({digits}), {p}), '0')"
        return _number_pad(_sign(f"{x} < 0L", flags), _grouped(digits) if "," in flags else digits, flags, width)
    if kind == "u":
        x = f"coalesce({integer(a)}, 0L)" if a else "0L"
        digits = f"CAST(if({x} < 0L, CAST({x} AS DECIMAL(20,0)) + 18446744073709551616BD, CAST({x} AS DECIMAL(20,0))) AS STRING)"
        return _number_pad("''", digits, flags, width)
    if kind in "xXop":
        x = f"coalesce({integer(a)}, 0L)" if a else "0L"
        digits = f"hex({x})" if kind != "o" else f"conv(CAST({x} AS STRING), 10, 8)"
        if kind in "xp":
            digits = f"lower({digits})"
        if p:
            digits = f"lpad({digits}, greatest(char_length({digits}), {p}), '0')"
        lead = {"x": "'0x'", "X": "'0X'", "o": "'0'"}.get(kind, "''")
        return _number_pad(f"if({x} <> 0L, {lead}, '')" if "#" in flags else "''", digits, flags, width)
    if kind in "feEgG":
        x = f"coalesce({real(a)}, 0D)" if a else "0D"
        p = 6 if p is None else p
        sign = _sign(f"{x} < 0D", flags)
        big = f"abs({x})"
        if kind == "f":
            # Ties round away from zero on the shortest digits of the number.
            digits = f"CAST(CAST(round(CAST({shortest(big)} AS DECIMAL(38, {min(18, p + 3)})), {p}) AS DECIMAL(38, {min(18, p)})) AS STRING)"
            if p == 0 and "#" in flags:
                digits = f"concat({digits}, '.')"
            if "," in flags:
                digits = f"concat({_grouped(f'substring_index({digits}, {quoted(chr(46))}, 1)')}, {f'concat({quoted(chr(46))}, substring_index({digits}, {quoted(chr(46))}, -1))' if p else quoted('')})"
            digits = f"if({big} = CAST('Infinity' AS DOUBLE), 'Inf', {digits})"
            return _number_pad(sign, digits, flags, width)
        if kind in "eE":
            java = f"format_string('%.{p}e', {big})"
            return _number_pad(sign, f"upper({java})" if kind == "E" else java, flags, width)
        p = p or 1
        # %g: plain notation while the exponent lies in -4 .. p - 1, without trailing zeros.
        exponent = f"CAST(substring_index(format_string('%.{p - 1}e', {big}), 'e', -1) AS INT)"
        plain = f"CAST(CAST(CAST({big} AS STRING) AS DECIMAL(38, 18)) AS STRING)"
        plain = f"CASE {' '.join(f'WHEN {exponent} = {k} THEN format_string({quoted(f"%.{max(0, p - 1 - k)}f")}, {big})' for k in range(-4, p))} ELSE {plain} END"
        power = f"format_string('%.{p - 1}e', {big})"
        if "#" not in flags:
            plain = f"regexp_replace(regexp_replace({plain}, '(\\\\.[0-9]*?)0+$', '$1'), '\\\\.$', '')"
            power = f"regexp_replace(regexp_replace({power}, '(\\\\.[0-9]*?)0+e', '$1e'), '\\\\.e', 'e')"
        digits = f"if({exponent} < -4 OR {exponent} >= {p}, {power}, {plain})"
        return _number_pad(sign, f"upper({digits})" if kind == "G" else digits, flags, width)
    if kind == "c":
        body = f"coalesce(substring({text(a)}, 1, 1), '')" if a else "''"
        return _pad(f"repeat({body}, {p})" if p and p > 1 else body, flags, width)
    x = text(a) if a else "CAST(NULL AS STRING)"
    if kind == "s":
        body = f"coalesce({x}, '')"
    elif kind == "w":
        body = f"replace(coalesce({x}, '(NULL)'), '\"', '\"\"')"
    elif kind == "q":
        body = f"replace(coalesce({x}, '(NULL)'), '\\'', '\\'\\'')"
    else:
        body = f"coalesce(concat('\\'', replace({x}, '\\'', '\\'\\''), '\\''), 'NULL')"
    if p is not None:
        body = f"substring({body}, 1, {p})"
    return _pad(body, flags, width)

