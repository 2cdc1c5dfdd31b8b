"""Time expressions: ages, anchors, ISO text and schedules. All times are UTC without a zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"

# Length in milliseconds of one unit of an age expression.
AGE_UNITS_MS = {
    "minutes": 60_000,
    "hours": 3_600_000,
    "days": 86_400_000,
    "months": 31 * 86_400_000,
    "years": 366 * 86_400_000,
}
# Week days as Spark's dayofweek numbers them.
WEEK_DAYS = {"SUN": 1, "MON": 2, "TUE": 3, "WED": 4, "THU": 5, "FRI": 6, "SAT": 7}


def moment(at: datetime) -> Column:
    """A zone-free timestamp literal, whatever the session's or the machine's time zone."""
    return F.expr(f"TIMESTAMP_NTZ '{at.replace(tzinfo=None).isoformat(sep=' ')}'")


def age_ms(expression: Column) -> Column:
    """``days(3)`` to milliseconds; anything else is null."""
    unit = F.regexp_extract(expression, "^\\s*([a-z]+)\\(\\s*(\\d+)\\s*\\)\\s*$", 1)
    digits = F.regexp_extract(expression, "^\\s*([a-z]+)\\(\\s*(\\d+)\\s*\\)\\s*$", 2)
    amount = F.when(digits != "", digits).cast("bigint")
    size = None
    for word, ms in AGE_UNITS_MS.items():
        size = F.when(unit == word, F.lit(ms)) if size is None else size.when(unit == word, F.lit(ms))
    return amount * size


def _shift(start: Column, days: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    # spelled as one SQL interval so that zone-free timestamps stay zone-free
    return start + F.expr(f"INTERVAL '{days * 1440 + hours * 60 + minutes}' MINUTE")


def _to_unit(unit: str, now: Column) -> Column:
    return F.date_trunc(unit, now).cast("timestamp_ntz")


def now_at(now: Column, hours: int = 0, minutes: int = 0) -> Column:
    return _shift(now, 0, hours, minutes)


def today(now: Column, hours: int = 0, minutes: int = 0) -> Column:
    return _shift(_to_unit("day", now), 0, hours, minutes)


def yesterday(now: Column, hours: int = 0, minutes: int = 0) -> Column:
    return _shift(_to_unit("day", now), -1, hours, minutes)


def current_month(now: Column, day: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    return _shift(_to_unit("month", now), day, hours, minutes)


def last_month(now: Column, day: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    return _shift(_to_unit("month", now) - F.expr("INTERVAL '1' MONTH"), day, hours, minutes)


def current_week(now: Column, week_day: str, hours: int = 0, minutes: int = 0) -> Column:
    """The latest given week day that is not after today."""
    back = F.pmod(F.dayofweek(now) - F.lit(WEEK_DAYS[week_day.upper()]), F.lit(7))
    start = F.date_sub(now.cast("date"), back).cast("timestamp_ntz")
    return _shift(start, 0, hours, minutes)


def last_week(now: Column, week_day: str, hours: int = 0, minutes: int = 0) -> Column:
    return _shift(current_week(now, week_day, hours, minutes), -7)


def current_year(now: Column, month: int = 0, day: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    return _shift(_to_unit("year", now) + F.expr(f"INTERVAL '{month}' MONTH"), day, hours, minutes)


def last_year(now: Column, month: int = 0, day: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    return current_year(now, month - 12, day, hours, minutes)


def parse_iso(text: Column) -> Column:
    """ISO text to a time; text of another form is null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"), text.try_cast("timestamp_ntz"))


def format_iso(time: Column) -> Column:
    return F.date_format(time, ISO_FORMAT)


def run_times(start: Column, end: Column, frequency_seconds: Column, horizon: Column) -> Column:
    """Array of run times from ``start`` each ``frequency_seconds`` to ``end``, or to ``horizon`` for an open end."""
    last = F.coalesce(end, horizon)
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), frequency_seconds.cast("decimal(18,6)"))
    return F.when(last >= start, F.sequence(start, last, step)).otherwise(
        F.array().cast("array<timestamp_ntz>"))


def is_last_run(end: Column, now: Column, frequency_seconds: Column) -> Column:
    """No further run fits before the policy ends."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), frequency_seconds.cast("decimal(18,6)"))
    return F.coalesce(end < now + step, F.lit(False))
