"""Scalar semantics that differ between engines, pinned in one place.

Every helper is a Column expression, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half(c: str | Column, digits: int = 0) -> Column:
    """Round half away from zero on the scaled double; negative zero becomes zero.

    Noise below a millionth of the last digit is cut off first, so that sums in another order round alike.
    """
    scale = float(10**digits)
    return F.round(F.round(_col(c) * F.lit(scale), 6), 0) / F.lit(scale) + F.lit(0.0)


def trunc_ts(unit: str, c: str | Column) -> Column:
    """date_trunc that keeps timestamps without zone."""
    return F.date_trunc(unit, _col(c)).cast("timestamp_ntz")


def epoch_seconds(c: str | Column) -> Column:
    """Whole seconds since 1970, fractions cut off towards the past."""
    return F.unix_timestamp(F.date_trunc("second", _col(c)).cast("timestamp"))


def boundary_diff(unit: str, start: str | Column, end: str | Column) -> Column:
    """Boundaries of a unit crossed between two timestamps (not whole units elapsed)."""
    n = _UNITS[unit]
    return F.floor(epoch_seconds(end) / n) - F.floor(epoch_seconds(start) / n)


def bucket(c: str | Column, seconds: int, origin: str = "1970-01-01 00:00:00") -> Column:
    """Start of the slot of so many seconds, counted from an origin."""
    zero = F.unix_timestamp(F.lit(origin))
    at = epoch_seconds(c) - zero
    return F.timestamp_seconds(zero + at - F.pmod(at, F.lit(seconds))).cast("timestamp_ntz")


def upper_median(c: str | Column) -> Column:
    """Element n div 2 of the sorted values: no mean of the middle pair."""
    x = F.sort_array(F.collect_list(_col(c)))
    return F.get(x, (F.size(x) / 2).cast("int"))


def frame_median(c: str | Column) -> Column:
    """Median that also accepts a window frame."""
    return F.percentile(_col(c), F.lit(0.5))


def share(flag: Column) -> Column:
    """Mean of a condition as a number."""
    return F.avg(F.when(flag, 1.0).otherwise(0.0))


def month_of(c: str | Column) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


def on_days(df, first: str, last: str, day: str = "day", ts: str = "timestamp"):
    """Days from first to last: on the day column, so that partitions are pruned, and as a half-open range of the time,
    which reaches the scan where the day is derived from it."""
    out = df.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    if ts in df.columns:
        edge = lambda d, n: F.date_add(F.lit(d).cast("date"), n).cast("timestamp_ntz")
        out = out.where((F.col(ts) >= edge(first, 0)) & (F.col(ts) < edge(last, 1)))
    return out


def bit_distance(a: str | Column, b: str | Column) -> Column:
    """Different bits of two hexadecimal digests of 64 digits."""
    out = F.lit(0)
    for k in range(0, 64, 8):
        part = lambda c: F.conv(F.substring(_col(c), k + 1, 8), 16, 10).cast("long")  # noqa: B023, E731
        out = out + F.bit_count(part(a).bitwiseXOR(part(b)))
    return out
