"""Column functions with the semantics the study needs where Spark's own differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a decimal number with optional sign and exponent, white space around it.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def lenient_numeric(c: Column) -> Column:
    """Text as double; null where it isn't a plain number (a bare cast would accept 12d and NaN)."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def sentinel_null(c: Column) -> Column:
    """Negative values are missing."""
    return F.when(c >= 0, c)


def range_null(c: Column, lo: float, hi: float) -> Column:
    """Values outside [lo, hi] are missing; the row stays."""
    return F.when(c.between(lo, hi), c)


def contains_any_case(c: Column, pattern: str) -> Column:
    """Case-insensitive regular expression; null is no match."""
    return F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))


def elapsed_minutes(start: Column, end: Column, exact: bool = True) -> Column:
    """Minutes from start to end. exact: from microseconds; otherwise seconds / 3600 * 60, as floats."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return micros / F.lit(6e7) if exact else (micros / F.lit(1e6)) / F.lit(3600.0) * F.lit(60.0)


def on_the_hour(ts: Column) -> Column:
    """1.0 within the first five minutes of an hour."""
    return (F.minute(ts) < 5).cast("double")


def bin_2h(hour: Column) -> Column:
    """06-08 for hours 6 and 7."""
    lo = (F.floor(hour / 2) * 2).cast("int")
    return F.format_string("%02d-%02d", lo, lo + 2)


def time_hour(c: Column) -> Column:
    """Hour of a text HH:MM:SS; null where it isn't one."""
    return F.hour(F.try_to_timestamp(c, F.lit("HH:mm:ss")))


def topcoded(c: Column, code: str = "> 89", value: str = "90") -> Column:
    """A top-coded text stands for value; everything else is parsed."""
    return lenient_numeric(F.when(c == code, F.lit(value)).otherwise(c))


def fahrenheit_to_celsius(c: Column) -> Column:
    return (c - 32) * 5 / 9


def signed(c: Column, negate: Column) -> Column:
    """Positive values that are to be negated, negated."""
    return F.when(negate & (c > 0), -c).otherwise(c)


def tail_value(low: Column, high: Column, tail: str, centre: float | None = None) -> Column:
    """The end of a range [low, high] on the scored tail: upper, lower, or both (farther from centre; equally far: high)."""
    ends = {"upper": high, "lower": low}
    if centre is not None:
        ends["both"] = F.when(high - centre >= centre - low, high).otherwise(low)
    if tail not in ends:
        raise ValueError(f"no tail {tail!r} with centre {centre}; known here: {', '.join(ends)}")
    return ends[tail]


def complete_sum(*columns: Column) -> Column:
    """Sum if every part is there, else null."""
    return reduce(lambda a, b: a + b, columns)


def any_one(a: Column, b: Column) -> Column:
    """1 if either is 1; null only if both are null; else 0."""
    one = lambda c: F.coalesce(c == 1, F.lit(False))
    return F.when(a.isNull() & b.isNull(), None).otherwise((one(a) | one(b)).cast("int"))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return a / F.nullif(b, F.lit(0))
