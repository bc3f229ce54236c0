"""Clock-free time helpers.

``now`` is always a parameter: a string, a ``datetime`` or a Column.  All
timestamps stay ``timestamp_ntz`` so results do not depend on the session zone.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts(value) -> Column:
    """A ``timestamp_ntz`` literal (or pass a Column through)."""
    if isinstance(value, Column):
        return value
    if isinstance(value, _dt.datetime):
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


def plus_seconds(t, seconds) -> Column:
    """``t + seconds`` (whole seconds, Column or int)."""
    secs = seconds if isinstance(seconds, Column) else F.lit(int(seconds))
    return F.timestamp_add("SECOND", secs, ts(t))


def cutoff(now, days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0) -> Column:
    """``now - interval``."""
    total = ((days * 24 + hours) * 60 + minutes) * 60 + seconds
    return F.timestamp_add("SECOND", F.lit(-total), ts(now))


def elapsed_seconds(start, end) -> Column:
    """Whole seconds from ``start`` to ``end``, truncated toward zero."""
    return F.timestamp_diff("SECOND", ts(start), ts(end))


def backoff_seconds(retry_count) -> Column:
    """Retry delay ``2^retry_count`` seconds (count already incremented)."""
    return F.pow(F.lit(2), retry_count).cast("int")


def capped_backoff_ms(attempt, base_ms: int = 1000, cap_ms: int = 30000) -> Column:
    """Exponential policy ``min(base * 2^attempt, cap)`` in milliseconds."""
    return F.least(F.lit(base_ms) * F.pow(F.lit(2), attempt), F.lit(cap_ms)).cast("bigint")


_EPOCH = "1970-01-01 00:00:00"


def ntz_micros(col) -> Column:
    """Microseconds since 1970-01-01 of a ``timestamp_ntz`` (no zone involved)."""
    return F.timestamp_diff("MICROSECOND", ts(_EPOCH), ts(col))


def as_instant(col) -> Column:
    """A ``timestamp_ntz`` read as UTC, as a ``timestamp`` (for watermarks),
    independent of the session time zone."""
    return F.timestamp_micros(ntz_micros(col))


def as_ntz(col) -> Column:
    """Inverse of ``as_instant``: a ``timestamp`` back to UTC wall time."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(col), ts(_EPOCH))
