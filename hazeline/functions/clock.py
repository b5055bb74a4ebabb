"""Local wall-clock (UTC+05:30, no daylight saving) helpers on TIMESTAMP_NTZ columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _ref(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 on the same wall clock."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), _ref(ts))


def hour_number(ts: Column | str) -> Column:
    """Whole hours since 1970-01-01."""
    return F.timestamp_diff("HOUR", F.expr(EPOCH), _ref(ts))


def hour_floor(ts: Column | str) -> Column:
    """Start of the clock hour; stays NTZ, whatever the session zone."""
    return F.timestamp_add("HOUR", hour_number(ts), F.expr(EPOCH))


def minute_floor(ts: Column | str, minutes: int) -> Column:
    """Start of the `minutes`-long slot."""
    n = F.timestamp_diff("MINUTE", F.expr(EPOCH), _ref(ts))
    return F.timestamp_add("MINUTE", n - F.pmod(n, F.lit(minutes)), F.expr(EPOCH))


def plus_hours(ts: Column | str, hours: Column | int) -> Column:
    n = F.lit(hours) if isinstance(hours, int) else hours
    return F.timestamp_add("HOUR", n, _ref(ts))


def reporting_date(ts: Column | str) -> Column:
    """Day whose 17:00 (day before) .. 16:00 window holds the timestamp."""
    return F.date_add(F.to_date(F.timestamp_add("SECOND", F.lit(-57601), _ref(ts))), 1)


def to_local(raw: Column | str, naive: str = "UTC") -> Column:
    """ISO text to local wall time: an offset is honoured, naive text is `naive`."""
    c = _ref(raw)
    has_zone = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    body = F.regexp_replace(c, r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")
    sign = F.when(c.rlike(r"-\d{2}:?\d{2}$"), -1).otherwise(1)
    hh = F.regexp_extract(c, r"[+-](\d{2}):?\d{2}$", 1).try_cast("int")
    mm = F.regexp_extract(c, r"[+-]\d{2}:?(\d{2})$", 1).try_cast("int")
    offset = F.when(has_zone, F.coalesce(sign * (hh * 60 + mm), F.lit(0))).otherwise(
        F.lit(0 if naive == "UTC" else 330)
    )
    return F.timestamp_add("MINUTE", F.lit(330) - offset, body)


def utc_to_local(ts: Column | str) -> Column:
    """UTC wall time to local wall time."""
    return F.timestamp_add("MINUTE", F.lit(330), _ref(ts))


def utc_hhmm_to_local_hour(hhmm: Column | str) -> Column:
    """UTC HHMM (number or text) to the local hour 0..23."""
    n = _ref(hhmm).try_cast("int")
    minute_of_day = F.floor(n / 100).cast("int") * 60 + F.pmod(n, F.lit(100)) + 330
    return F.floor(F.pmod(minute_of_day, F.lit(1440)) / 60).cast("int")


def cyclic(c: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a periodic quantity."""
    angle = c.cast("double") * (2.0 * math.pi) / period
    return F.sin(angle), F.cos(angle)


def winter_label(ts: Column | str) -> Column:
    """'y-(y+1)' for Oct-Dec, '(y-1)-y' for Jan-Feb, else 'Other'."""
    y, m = F.year(_ref(ts)), F.month(_ref(ts))
    start = F.when(m >= 10, y).when(m <= 2, y - 1)
    return F.when(start.isNull(), "Other").otherwise(
        F.concat_ws("-", start.cast("string"), (start + 1).cast("string"))
    )
