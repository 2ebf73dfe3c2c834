"""Date and time functions on milliseconds since 1970-01-01, kept in BIGINT expressions."""

from __future__ import annotations

import re

from brindle.plans.errors import Unsupported

from .values import E, let, literal, quoted, real, text, value

DAY = 86_400_000
JULIAN_EPOCH = 2440587.5


def _from_text(x: str) -> str:
    """Milliseconds of ISO-8601 text or of a Julian day number in text; null if it is neither."""
    date = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})"
    clock = r"([0-9]{2}):([0-9]{2})(?::([0-9]{2})(\\.[0-9]+)?)?"
    zone = r"[ ]*(Z|z|[+-][0-9]{2}:[0-9]{2})?[ ]*$"
    full = f"{date}(?:[ T]+{clock})?{zone}"
    only = f"^{clock}{zone}"

    def part(pattern: str, i: int) -> str:
        return f"nullif(regexp_extract({x}, '{pattern}', {i}), '')"

    def of(pattern: str, first: int, day: str) -> str:
        h, m, s, f, z = (part(pattern, first + i) for i in range(5))
        parts = f"CAST({h} AS INT) BETWEEN 0 AND 23 AND CAST({m} AS INT) BETWEEN 0 AND 59 AND coalesce(CAST({s} AS INT), 0) BETWEEN 0 AND 59"
        clock_ms = f"(CAST({h} AS BIGINT) * 3600000L + CAST({m} AS BIGINT) * 60000L + coalesce(CAST({s} AS BIGINT), 0L) * 1000L + coalesce(CAST(floor(CAST({f} AS DOUBLE) * 1000D + 0.5D) AS BIGINT), 0L))"
        shift = f"CASE WHEN {z} IS NULL OR upper({z}) = 'Z' THEN 0L ELSE (CAST(concat(substring({z}, 1, 1), '1') AS BIGINT) * (CAST(substring({z}, 2, 2) AS BIGINT) * 60L + CAST(substring({z}, 5, 2) AS BIGINT)) * 60000L) END"
        return f"CASE WHEN {h} IS NULL THEN {day} WHEN {parts} THEN {day} + {clock_ms} - {shift} END"

    y, mo, d = (part(full, i) for i in (1, 2, 3))
    first = f"try_cast(concat({y}, '-', {mo}, '-01') AS DATE)"
    day = f"CASE WHEN CAST({d} AS INT) BETWEEN 1 AND 31 THEN (CAST(unix_date({first}) AS BIGINT) + CAST({d} AS BIGINT) - 1L) * {DAY}L END"
    numeric = f"try_cast({x} AS DOUBLE)"
    return f"CASE WHEN rlike({x}, '{full}') THEN {of(full, 4, day)} WHEN rlike({x}, '{only}') THEN {of(only, 1, f'{10957 * DAY}L')} WHEN {numeric} >= 0D AND {numeric} < 5373484.5D THEN {_from_julian(numeric)} END"


def _from_julian(x: str) -> str:
    return f"CAST(floor(({x} - {JULIAN_EPOCH}D) * {DAY}D + 0.5D) AS BIGINT)"


def _start(e: E, mode: str | None) -> str:
    e = value(e)
    if e.ts and mode is None:
        return f"CAST(timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {e.ts}) AS BIGINT)"
    if e.cls == "NULL":
        return "CAST(NULL AS BIGINT)"
    if mode == "unixepoch":
        return f"CAST(floor({real(e)} * 1000D + 0.5D) AS BIGINT)" if e.cls != "INT" else f"({e.sql} * 1000L)"
    if e.cls in ("INT", "REAL"):
        x = real(e)
        if mode == "auto":
            return f"CASE WHEN {x} >= 0D AND {x} < 5373484.5D THEN {_from_julian(x)} WHEN {x} BETWEEN -210866760000D AND 253402300799D THEN CAST(floor({x} * 1000D + 0.5D) AS BIGINT) END"
        return f"CASE WHEN {x} >= 0D AND {x} < 5373484.5D THEN {_from_julian(x)} END"
    return _from_text(text(e))


def _days(ms: str) -> str:
    return f"CAST(floor({ms} / {DAY}D) AS INT)"


def _months(ms: str, months: str, floor: bool = False) -> str:
    """So many months on; a day beyond the month's end runs into the next month, or stays at its end with ``floor``."""

    def body(v: str) -> str:
        d = f"date_from_unix_date({_days(v)})"
        first = f"add_months(trunc({d}, 'MM'), CAST({months} AS INT))"
        day = f"day({d})"
        if floor:
            day = f"least({day}, day(last_day({first})))"
        return f"(CAST(unix_date({first}) AS BIGINT) + {day} - 1L) * {DAY}L + pmod({v}, {DAY}L)"

    return let(ms, body)


_UNITS = {"day": DAY, "hour": 3_600_000, "minute": 60_000, "second": 1000}


def _modify(ms: str, mod: str) -> str | None:
    """Milliseconds after one modifier; None if it isn't one."""
    m = mod.strip().lower()
    if n := re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s+(day|hour|minute|second|month|year)s?", m):
        amount, unit = float(n[1]), n[2]
        if unit in _UNITS:
            shift = amount * _UNITS[unit]
            return f"({ms} + {int(shift + (0.5 if shift >= 0 else -0.5))}L)"
        months = int(amount) * (12 if unit == "year" else 1)
        out = _months(ms, str(months))
        rest = (amount - int(amount)) * (365.0 if unit == "year" else 30.0) * DAY
        return f"({out} + {int(rest)}L)" if int(rest) else out
    if n := re.fullmatch(r"([+-])(\d{2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?", m):
        shift = (int(n[2]) * 3600 + int(n[3]) * 60 + float(n[4] or 0)) * 1000
        return f"({ms} {n[1]} {int(shift + 0.5)}L)"
    if n := re.fullmatch(r"([+-])(\d{4})-(\d{2})-(\d{2})(?:\s+(\d{2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?)?", m):
        sign = -1 if n[1] == "-" else 1
        out = _months(ms, str(sign * (int(n[2]) * 12 + int(n[3]))))
        shift = int(n[4]) * DAY + int(n[5] or 0) * 3_600_000 + int(n[6] or 0) * 60_000 + int(float(n[7] or 0) * 1000)
        return f"({out} + {sign * shift}L)"
    if m == "start of day":
        return let(ms, lambda v: f"{v} - pmod({v}, {DAY}L)")
    if m in ("start of month", "start of year"):
        unit = "MM" if m.endswith("month") else "YYYY"
        return f"CAST(unix_date(trunc(date_from_unix_date({_days(ms)}), '{unit}')) AS BIGINT) * {DAY}L"
    if n := re.fullmatch(r"weekday\s+(\d)(?:\.0*)?", m):
        w = int(n[1])
        if w > 6:
            return None
        # 1970-01-01 was a Thursday, weekday 4.
        return let(ms, lambda v: f"{v} + pmod({w} - pmod({_days(v)} + 4, 7), 7) * {DAY}L")
    return None


def moment(args: tuple[E, ...]) -> tuple[str | None, bool]:
    """(milliseconds or None for an invalid modifier, whether fractions of seconds are wanted)."""
    mods = []
    for a in args[1:]:
        if not a.is_const:
            raise Unsupported("a date modifier that varies by row")
        if a.const is None:
            return None, False
        mods.append(str(a.const))
    subsec = False
    mode = None
    if mods and mods[0].strip().lower() in ("unixepoch", "julianday", "auto"):
        mode = mods.pop(0).strip().lower()
        if args[0].cls == "TEXT" and not args[0].ts and mode == "julianday":
            mode = None
    ms = _start(args[0], mode)
    i = 0
    while i < len(mods):
        m = mods[i].strip().lower()
        i += 1
        if m in ("subsec", "subsecond"):
            subsec = True
        elif m in ("ceiling", "floor"):
            continue
        else:
            floor = i < len(mods) and mods[i].strip().lower() == "floor"
            n = re.fullmatch(r"([+-]?\d+)\s+(month|year)s?", m)
            ms = _months(ms, str(int(n[1]) * (12 if n[2] == "year" else 1)), True) if floor and n else _modify(ms, m)
            if ms is None:
                return None, False
    return f"CASE WHEN {ms} BETWEEN -210866760000000L AND 253402300799999L THEN {ms} END" if len(ms) < 4000 else ms, subsec


def _stamp(ms: str) -> str:
    return f"timestampadd(MILLISECOND, {ms}, TIMESTAMP_NTZ '1970-01-01 00:00:00')"


def render(name: str, *args: E) -> E:
    if not args:
        raise Unsupported("the current time")
    if name in ("date", "time", "datetime") and len(args) == 1 and args[0].ts:
        return E(f"date_format({args[0].ts}, '{_FORMATS[name]}')", "TEXT")
    ms, subsec = moment(args)
    if ms is None:
        return literal(None)
    if name == "julianday":
        return E(f"(CAST({ms} AS DOUBLE) / {DAY}D + {JULIAN_EPOCH}D)", "REAL")
    if name == "unixepoch":
        return E(f"(CAST({ms} AS DOUBLE) / 1000D)", "REAL") if subsec else E(f"CAST(floor({ms} / 1000D) AS BIGINT)", "INT")
    fmt = _FORMATS[name] + (".SSS" if subsec and name != "date" else "")
    return E(f"date_format({_stamp(ms)}, '{fmt}')", "TEXT")


_FORMATS = {"date": "yyyy-MM-dd", "time": "HH:mm:ss", "datetime": "yyyy-MM-dd HH:mm:ss"}
#: Conversions with a pattern of Spark's own.
_PATTERNS = {"d": "dd", "H": "HH", "I": "hh", "m": "MM", "M": "mm", "S": "ss", "Y": "yyyy", "F": "yyyy-MM-dd", "R": "HH:mm", "T": "HH:mm:ss", "f": "ss.SSS"}


def strftime(fmt: E, *args: E) -> E:
    if (fmt.is_const and fmt.const is None) or not args:
        return literal(None)
    if len(args) == 1 and args[0].ts:
        t, ms = args[0].ts, _start(args[0], None)
    else:
        ms, _ = moment(args)
        if ms is None:
            return literal(None)
        t = _stamp(ms)
    date = f"CAST({t} AS DATE)"
    sunday = f"(dayofweek({date}) - 1)"
    special = {
        "e": f"lpad(CAST(day({date}) AS STRING), 2, ' ')",
        "k": f"lpad(CAST(hour({t}) AS STRING), 2, ' ')",
        "l": f"lpad(CAST((hour({t}) + 11) % 12 + 1 AS STRING), 2, ' ')",
        "j": f"lpad(CAST(dayofyear({date}) AS STRING), 3, '0')",
        "J": f"regexp_replace(CAST(CAST({ms} AS DOUBLE) / {DAY}D + {JULIAN_EPOCH}D AS STRING), '\\\\.0$', '')",
        "p": f"if(hour({t}) < 12, 'AM', 'PM')",
        "P": f"if(hour({t}) < 12, 'am', 'pm')",
        "s": f"CAST(CAST(floor({ms} / 1000D) AS BIGINT) AS STRING)",
        "u": f"CAST(if({sunday} = 0, 7, {sunday}) AS STRING)",
        "w": f"CAST({sunday} AS STRING)",
        "U": f"lpad(CAST((dayofyear({date}) + 6 - {sunday}) div 7 AS STRING), 2, '0')",
        "W": f"lpad(CAST((dayofyear({date}) + 6 - pmod({sunday} + 6, 7)) div 7 AS STRING), 2, '0')",
        "V": f"lpad(CAST(weekofyear({date}) AS STRING), 2, '0')",
        "G": f"CAST(extract(YEAROFWEEK FROM {date}) AS STRING)",
        "g": f"lpad(CAST(extract(YEAROFWEEK FROM {date}) % 100 AS STRING), 2, '0')",
    }
    if not fmt.is_const:  # each conversion is replaced where a row's format has it
        known = {c: f"date_format({t}, '{p}')" for c, p in _PATTERNS.items()} | special
        made = f"replace({text(fmt)}, '%%', '\\u0001')"
        for c, sql in known.items():
            made = f"replace({made}, '%{c}', {sql})"
        return E(f"CASE WHEN rlike(replace({text(fmt)}, '%%', ''), '^(?s)([^%]|%[{''.join(known)}])*\\\\z') THEN replace({made}, '\\u0001', '%') END", "TEXT")
    out, i, source = [], 0, str(fmt.const)
    while i < len(source):
        if source[i] != "%":
            j = source.find("%", i)
            j = len(source) if j < 0 else j
            out.append(quoted(source[i:j]))
            i = j
            continue
        c = source[i + 1 : i + 2]
        i += 2
        if c == "%":
            out.append("'%'")
        elif c in _PATTERNS and c:
            out.append(f"date_format({t}, '{_PATTERNS[c]}')")
        elif c in special and c:
            out.append(special[c])
        else:
            return literal(None)
    return E(f"concat({', '.join(out)})", "TEXT") if out else E(f"if({t} IS NULL, NULL, '')", "TEXT")


def timediff(a: E, b: E) -> E:
    """(+|-)YYYY-MM-DD HH:MM:SS.SSS: what added to ``b`` gives ``a``, whole months first."""
    x, y = moment((a,))[0], moment((b,))[0]

    def body(v: str) -> str:
        hi, lo = f"greatest({v}.a, {v}.b)", f"least({v}.a, {v}.b)"
        dh, dl = f"date_from_unix_date({_days(hi)})", f"date_from_unix_date({_days(lo)})"
        months = f"((year({dh}) - year({dl})) * 12 + month({dh}) - month({dl}))"
        # From a: the earlier moment is reached back from the later, or forward from the earlier, by the sign.
        forward = f"({v}.a >= {v}.b)"
        moved = lambda n: f"if({forward}, {_shift(lo, n)}, {_shift(hi, f'-({n})')})"
        fits = f"if({forward}, {moved(months)} <= {hi}, {moved(months)} >= {lo})"
        n = f"({months} - if({fits}, 0, 1))"
        rest = f"if({forward}, {hi} - {moved(n)}, {moved(n)} - {lo})"
        return f"CASE WHEN {v}.a IS NULL OR {v}.b IS NULL THEN NULL ELSE concat(if({forward}, '+', '-'), lpad(CAST({n} div 12 AS STRING), 4, '0'), '-', lpad(CAST({n} % 12 AS STRING), 2, '0'), '-', lpad(CAST({rest} div {DAY}L AS STRING), 2, '0'), ' ', date_format(timestampadd(MILLISECOND, pmod({rest}, {DAY}L), TIMESTAMP_NTZ '1970-01-01 00:00:00'), 'HH:mm:ss.SSS')) END"

    return E(let(f"named_struct('a', {x}, 'b', {y})", body), "TEXT")


def _shift(ms: str, months: str) -> str:
    d = f"date_from_unix_date({_days(ms)})"
    return f"((CAST(unix_date(add_months(trunc({d}, 'MM'), CAST({months} AS INT))) AS BIGINT) + day({d}) - 1L) * {DAY}L + pmod({ms}, {DAY}L))"

