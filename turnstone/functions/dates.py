"""Date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of the snowflake ids' epoch, 2015-01-01.
SNOWFLAKE_EPOCH_MS = 1420070400000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def preset_range(preset: str, today: Column) -> tuple[Column, Column]:
    """Inclusive bounds of a relative range; last_24_hours goes two days back, as a day's evening may be yesterday's."""
    month, week, year = F.trunc(today, "month"), F.trunc(today, "week"), F.trunc(today, "year")
    table = {
        "today": (today, today),
        "yesterday": (F.date_sub(today, 1), F.date_sub(today, 1)),
        "last_24_hours": (F.date_sub(today, 2), today),
        "last_7_days": (F.date_sub(today, 7), today),
        "last_30_days": (F.date_sub(today, 30), today),
        "last_90_days": (F.date_sub(today, 90), today),
        "this_week": (week, today),
        "last_week": (F.date_sub(week, 7), F.date_sub(week, 1)),
        "this_month": (month, today),
        "last_month": (F.add_months(month, -1), F.date_sub(month, 1)),
        "this_year": (year, today),
    }
    return table[preset]


PRESETS = ("today", "yesterday", "last_24_hours", "last_7_days", "last_30_days", "last_90_days", "this_week", "last_week", "this_month", "last_month", "this_year")


def parse_session_date(c: Column | str) -> Column:
    """ISO, month-day-year, day-month-year or month-year; null if none fits."""
    text = F.trim(_col(c))
    formats = ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM yyyy")
    return F.coalesce(*(F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats))


def snowflake_time(c: Column | str) -> Column:
    return F.timestamp_millis(F.shiftright(_col(c).cast("long"), 22) + SNOWFLAKE_EPOCH_MS)


def temporal_bonus(date: Column, target: Column, near: Column) -> Column:
    """Falls by .35 for each day off the target; more on the day itself, and for a match that is near."""
    off = F.abs(F.datediff(date, target))
    return F.round(F.greatest(F.lit(0.0), 2.5 - 0.35 * off) + F.when(off == 0, 3.0).otherwise(0.0) + F.when(near, 1.25).otherwise(0.25), 6)


def recency(date: Column, now: Column) -> Column:
    return F.round(0.1 * F.greatest(F.lit(0.0), 1 - F.datediff(now, date) / 365.0), 6)
