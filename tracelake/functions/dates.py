"""Day numbers since 1899-12-30 with a separate part of a second, as recordings store time.

Python functions work on microseconds since 1970 (UTC); the column functions on timestamps.
"""

from __future__ import annotations

import math
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.errors import LimitError

#: 1899-12-30 in seconds since 1970.
EPOCH_SECONDS = -2_209_161_600
DAY = 86_400
#: Years 1678 to 2261, which a clock of nanoseconds in 64 bits can tell.
CLOCK_SECONDS = 9_223_372_036


def round_half_away(x: float) -> int:
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def to_micros(date: float, fraction: float) -> int:
    """Microseconds since 1970 of a day number and a part of a second.  Whole seconds in the
    fraction move to the date; a negative fraction and times beyond the clock are limit errors."""
    if not fraction >= 0:
        raise LimitError(f"negative or undefined part of a second: {fraction}")
    if not (math.isfinite(date) and math.isfinite(fraction)):
        raise LimitError(f"infinite date {date} or fraction {fraction}")
    whole = math.floor(fraction)
    days = (date * DAY + whole) / DAY
    part = fraction - whole
    if not math.isfinite(days) or abs(EPOCH_SECONDS + days * DAY + part) >= CLOCK_SECONDS - 3600:
        raise LimitError(f"date {date} is beyond the clock")
    return (EPOCH_SECONDS + round_half_away(days * DAY)) * 1_000_000 + round_half_away(part * 1e6)


def from_micros(us: int) -> tuple[float, float]:
    """Day number and part of a second: seconds are rounded down, also before 1899."""
    span = us - EPOCH_SECONDS * 1_000_000
    return (span // 1_000_000) / DAY, (span % 1_000_000) / 1e6


def datetime_of(us: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=UTC).replace(tzinfo=None) + timedelta(microseconds=us)


def micros_of(t: datetime) -> int:
    """Microseconds since 1970; times without a zone are UTC."""
    t = t.replace(tzinfo=UTC) if t.tzinfo is None else t
    d = t - datetime(1970, 1, 1, tzinfo=UTC)
    return (d.days * DAY + d.seconds) * 1_000_000 + d.microseconds


def day_number(t: Column) -> Column:
    """Day number of a timestamp."""
    return F.floor((F.unix_micros(t.cast("timestamp")) - F.lit(EPOCH_SECONDS * 1_000_000)) / 1_000_000).cast("double") / DAY


def second_part(t: Column) -> Column:
    """Part of a second of a timestamp."""
    return F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(1_000_000)).cast("double") / 1e6


def timestamp_of(date: Column, fraction: Column) -> Column:
    """Timestamp of a day number and a part of a second; null for a negative or undefined part and
    for times beyond the clock."""
    whole = F.floor(fraction)
    seconds = F.round(date * DAY + whole).cast("double")
    inside = (fraction >= 0) & ~F.isnan(date) & ~F.isnan(fraction) & (F.abs(date) < CLOCK_SECONDS / DAY) & (fraction < CLOCK_SECONDS)
    us = (seconds.cast("long") + EPOCH_SECONDS) * 1_000_000 + F.round((fraction - whole) * 1e6).cast("long")
    return F.when(inside, F.timestamp_micros(F.when(inside, us)))


def valid_civil_time(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """True if the numbers name a time of the calendar (seconds up to 60); null counts as false."""
    last = F.day(F.last_day(F.try_make_timestamp(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0.0))))
    return F.coalesce(month.between(1, 12) & day.between(1, last) & hour.between(0, 23) & minute.between(0, 59) & second.between(0, 60), F.lit(False))


def micros_of_civil(year: int, month: int, day: int, hour: int = 0, minute: int = 0, second: int = 0) -> int:
    """Microseconds since 1970 of a time of the calendar; second 60 is the next minute's first.  A
    limit error for what is none, or beyond the clock."""
    try:
        if not 0 <= second <= 60:
            raise ValueError(f"second {second}")
        us = micros_of(datetime(year, month, day, hour, minute)) + second * 1_000_000
    except ValueError as e:
        raise LimitError(f"no time of the calendar: {e}") from None
    if abs(us) >= CLOCK_SECONDS * 1_000_000:
        raise LimitError(f"year {year} is beyond the clock")
    return us


def civil_of(t: Column) -> Column:
    """year, month, day, hour, minute, second of a timestamp (UTC); seconds are rounded down."""
    us = F.unix_micros(t.cast("timestamp"))
    seconds = F.floor(us / 1_000_000).cast("long")
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / DAY).cast("int"))
    rest = F.pmod(seconds, F.lit(DAY)).cast("int")
    parts = {"year": F.year(date), "month": F.month(date), "day": F.day(date), "hour": rest / 3600, "minute": rest % 3600 / 60, "second": rest % 60}
    return F.struct(*[F.floor(v).cast("int").alias(k) for k, v in parts.items()])


def timestamp_of_civil(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Timestamp (UTC) of a time of the calendar; null for what is none.  Second 60 is the next
    minute's first."""
    date = F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0.0))
    days = F.datediff(date, F.lit("1970-01-01").cast("date")).cast("long")
    us = (((days * 24 + hour) * 60 + minute) * 60 + second) * 1_000_000
    return F.when(valid_civil_time(year, month, day, hour, minute, second), F.timestamp_micros(us))


def as_text(t: Column) -> Column:
    """A timestamp as ``2024-01-31 12:34:56:000123456000``: date, time, and nanoseconds in twelve
    digits (UTC)."""
    c = civil_of(t)
    part = F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(1_000_000)) * 1000
    form = lambda n, *xs: F.format_string(n, *xs)
    return form("%04d-%02d-%02d %02d:%02d:%02d:%012d", *[c[k] for k in ("year", "month", "day", "hour", "minute", "second")], part)
