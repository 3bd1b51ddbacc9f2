"""Time helpers: naive (UTC) timestamp literals, truncation, calendars, labels.

All event times are TIMESTAMP_NTZ.  ``date_trunc`` returns a zoned timestamp,
so truncation casts back to NTZ; with the session zone pinned to UTC this is
exact.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

# groupBy value of the period reports -> (bucket unit of the grouped series)
# Fixed values of the reference's period reports.
SERIES_UNIT = {"day": "hour", "week": "day", "month": "day", "year": "month"}
GROUP_BY_VALUES = ("day", "week", "month", "year")


def parse_ts(value) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(str(value))


def ntz(value) -> Column:
    """A TIMESTAMP_NTZ literal (independent of the session zone)."""
    return F.to_timestamp_ntz(F.lit(parse_ts(value).strftime("%Y-%m-%d %H:%M:%S.%f")))


def date_lit(value) -> Column:
    d = parse_ts(value).date()
    return F.to_date(F.lit(d.isoformat()))


def trunc_ntz(unit: str, c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_trunc(unit, c.cast("timestamp_ntz")).cast("timestamp_ntz")


def py_trunc(unit: str, t: dt.datetime) -> dt.datetime:
    """Python twin of date_trunc for literal bounds (Monday weeks, as PG/Spark)."""
    t = parse_ts(t)
    if unit == "hour":
        return t.replace(minute=0, second=0, microsecond=0)
    if unit == "day":
        return t.replace(hour=0, minute=0, second=0, microsecond=0)
    if unit == "week":
        d = t.replace(hour=0, minute=0, second=0, microsecond=0)
        return d - dt.timedelta(days=d.weekday())
    if unit == "month":
        return t.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    if unit == "year":
        return t.replace(month=1, day=1, hour=0, minute=0, second=0, microsecond=0)
    raise ValueError(f"unknown unit {unit}")


def validate_group_by(group_by: str) -> str:
    """The reference answers 400 'Invalid groupBy value' outside day/week/month/year."""
    if group_by not in GROUP_BY_VALUES:
        raise ValueError(f"Invalid groupBy value: {group_by!r}")
    return group_by


def series_window(group_by: str, as_of) -> tuple[str, dt.datetime, dt.datetime]:
    """(unit, start, end) of the dense period reports.

    day: hourly from as_of-24h; week: daily from as_of-6d; month: daily from
    as_of-27d; year: monthly from the start of the year.  End is as_of.
    """
    validate_group_by(group_by)
    now = parse_ts(as_of)
    unit = SERIES_UNIT[group_by]
    start = {
        "day": now - dt.timedelta(hours=24),
        "week": now - dt.timedelta(days=6),
        "month": now - dt.timedelta(days=27),
        "year": py_trunc("year", now),
    }[group_by]
    return unit, start, now


def calendar(base: DataFrame, group_by: str, as_of, col: str = "period") -> DataFrame:
    """Gap-free bucket calendar (generate_series + truncation) for every row of ``base``.

    ``base`` holds the grouping keys (one row per tenant, or a one-row frame for
    the global report).  The series is produced by ``explode(sequence(...))``
    on each row, so its size is rows(base) x buckets and needs no join.
    """
    unit, start, end = series_window(group_by, as_of)
    step = F.expr(f"INTERVAL 1 {unit.upper()}")
    points = F.explode(F.sequence(ntz(start), ntz(end), step))
    return (base.select("*", points.alias("_p"))
                .select(*base.columns, trunc_ntz(unit, "_p").alias(col)))


def period_label(period: Column, group_by: str, as_of) -> Column:
    """Label of a bucket: 'h a' for hours, Today / Yesterday / 'MMM d' for days, 'MMM' for months."""
    if group_by == "day":
        return F.date_format(period, "h a")
    if group_by in ("week", "month"):
        today = parse_ts(as_of).date()
        d = F.to_date(period)
        return (F.when(d == date_lit(today), F.lit("Today"))
                 .when(d == date_lit(today - dt.timedelta(days=1)), F.lit("Yesterday"))
                 .otherwise(F.date_format(period, "MMM d")))
    if group_by == "year":
        return F.date_format(period, "MMM")
    raise ValueError(group_by)
