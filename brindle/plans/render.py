"""Values as the script protocol prints them."""

from __future__ import annotations

import math


def real(x: float) -> str:
    if x == 0:
        return "0.0"
    if math.isinf(x):
        return "Inf" if x > 0 else "-Inf"
    sign, digits, point = _parts(abs(x))
    sign = "-" if x < 0 else sign
    exponent = point - 1
    if -5 < exponent < 16:
        if point <= 0:
            return f"{sign}0.{'0' * -point}{digits}"
        if point >= len(digits):
            return f"{sign}{digits}{'0' * (point - len(digits))}.0"
        return f"{sign}{digits[:point]}.{digits[point:]}"
    return f"{sign}{digits[0]}.{digits[1:] or '0'}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"


def _parts(x: float) -> tuple[str, str, int]:
    """Shortest digits and the place of the decimal point."""
    mantissa, _, power = f"{x!r}".lower().partition("e")
    whole, _, fraction = mantissa.partition(".")
    fraction = "" if fraction == "0" else fraction
    digits, point = whole + fraction, len(whole) + int(power or 0)
    stripped = digits.lstrip("0")
    point -= len(digits) - len(stripped)
    return "", stripped.rstrip("0") or "0", point


def cell(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else real(v)
    if isinstance(v, bytes | bytearray):
        return f"X'{bytes(v).hex().upper()}'"
    return str(v)


def line(row: tuple) -> str:
    return "|".join(cell(v) for v in row)
