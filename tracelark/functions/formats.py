"""Numbers and times as the legend shows them. Rounding works on the exact binary value, halves away from zero."""

from __future__ import annotations

import math
from datetime import UTC, datetime, timedelta
from decimal import ROUND_HALF_UP, Context, Decimal

DIGITS = 7


def decimal_places(value: float) -> int:
    """Digits after the point of the shortest decimal form."""
    if not math.isfinite(value) or value == 0:
        return 0
    _, digits, exponent = Decimal(repr(abs(value))).normalize().as_tuple()
    return max(0, -exponent)


def to_fixed(value: float, decimals: int) -> str:
    exact = Decimal(value).quantize(Decimal(1).scaleb(-decimals), rounding=ROUND_HALF_UP, context=Context(prec=400))
    text = f"{exact:f}"
    return text[1:] if value == 0 and text.startswith("-") else text


def to_precision(value: float, digits: int = DIGITS) -> float:
    if value == 0 or not math.isfinite(value):
        return value
    return float(Context(prec=digits, rounding=ROUND_HALF_UP).create_decimal(Decimal(value)))


def to_exponential(value: float, digits: int) -> str:
    rounded = Context(prec=digits + 1, rounding=ROUND_HALF_UP).create_decimal(Decimal(value))
    mantissa, exponent = f"{rounded:.{digits}e}".split("e")
    return f"{mantissa}e{'-' if exponent.startswith('-') else '+'}{abs(int(exponent))}"


def shortest(value: float) -> str:
    """The shortest form that reads back as the same number, without a trailing .0."""
    text = repr(value)
    if "e" in text:
        text = f"{Decimal(text):f}"
    return text[:-2] if text.endswith(".0") else text


def round_to_resolution(value: float, factor: float, offset: float) -> float:
    decimals = max(decimal_places(factor), decimal_places(offset))
    return value if decimals > 100 or not math.isfinite(value) else float(to_fixed(value, decimals))


def number(value: float | None, factor: float | None, offset: float = 0.0) -> str:
    """At most seven significant digits; with a factor, as many decimals as factor and offset resolve."""
    if value is None or not math.isfinite(value):
        return "-"
    if value == 0:
        return "0"
    size = abs(value)
    if size >= 1_000_000 or size < 1e-6:
        return to_exponential(value, DIGITS - 1)
    if factor is None:
        return shortest(to_precision(value))
    resolved = max(decimal_places(factor), decimal_places(offset))
    whole = math.floor(math.log10(size)) + 1 if size >= 1 else 1
    return to_fixed(value, min(resolved, max(0, DIGITS - whole)))


def seconds(value: float) -> str:
    if value < 60:
        return f"{to_fixed(value, 3)}s"
    minutes = math.floor(value / 60)
    return f"{minutes}m {to_fixed(value - minutes * 60, 3)}s"


def duration(milliseconds: float) -> str:
    if not math.isfinite(milliseconds):
        return ""
    return ("-" if milliseconds < 0 else "") + seconds(abs(milliseconds) / 1000)


def axis_time(milliseconds: float, measurement_start_ms: int | None = None, absolute: bool = False) -> str:
    """A time on the axis: since the start, or, if asked for and known, the time of day (UTC)."""
    if not math.isfinite(milliseconds):
        return ""
    if absolute and measurement_start_ms is not None:
        at = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=math.floor(measurement_start_ms + milliseconds))
        return f"{at:%H:%M:%S}.{at.microsecond // 1000:03d}"
    return seconds(milliseconds / 1000) if milliseconds >= 0 else f"{to_fixed(milliseconds / 1000, 3)}s"


def axis_value(value: float) -> str | None:
    """A value on the axis: fewer decimals the larger it is, powers of ten where it is very large or small."""
    if not math.isfinite(value):
        return None
    size = abs(value)
    if size < 1e-12:
        return "0"
    if not 1e-3 <= size < 1e6:
        return to_exponential(value, 2)
    text = to_fixed(value, 0 if size >= 100 else 1 if size >= 10 else 3)
    return text.rstrip("0").rstrip(".") if "." in text else text
