"""Date and categorical encodings.

One-hot columns have a fixed domain, so every data set gets the same columns.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The span of the holiday calendar, the weekend days in it that
# were working days, and the weekdays in it that were days off.
CALENDAR_START = dt.date(2016, 1, 1)
CALENDAR_END = dt.date(2016, 7, 31)
WORKING_WEEKEND_DAYS = ["2016-02-06", "2016-02-14", "2016-06-12"]
WEEKDAYS_OFF = [
    "2016-01-01",
    "2016-02-08",
    "2016-02-09",
    "2016-02-10",
    "2016-02-11",
    "2016-02-12",
    "2016-04-04",
    "2016-05-02",
    "2016-06-09",
    "2016-06-10",
]

DISTANCE_BANDS = range(-1, 11)


def _dates(texts: list[str]) -> list[Column]:
    return [F.lit(dt.date.fromisoformat(text)) for text in texts]


def week(day: Column) -> Column:
    """Weekday with Monday = 0."""
    return F.weekday(day)


def weekday(day: Column) -> Column:
    """Weekday with Monday = 1, null kept."""
    return F.weekday(day) + 1


def is_weekend(day: Column) -> Column:
    """1 on Saturday and Sunday, else 0 (null counts as 0)."""
    return F.coalesce(F.weekday(day) >= 5, F.lit(False)).cast("int")


def is_holiday(day: Column) -> Column:
    """1 on a day off in the 2016 calendar, else 0 (null counts as 0).

    Weekends of the span are off except the working ones; the listed weekdays
    are off as well.
    """
    in_span = day.between(F.lit(CALENDAR_START), F.lit(CALENDAR_END))
    weekend_off = (F.weekday(day) >= 5) & ~day.isin(_dates(WORKING_WEEKEND_DAYS))
    off = in_span & (weekend_off | day.isin(_dates(WEEKDAYS_OFF)))
    return F.coalesce(off, F.lit(False)).cast("int")


def day_of_month(day: Column) -> Column:
    return F.dayofmonth(day)


def week_columns(day: Column) -> list[Column]:
    """``week_0`` (Monday) to ``week_6``."""
    return [F.coalesce(F.weekday(day) == i, F.lit(False)).cast("int").alias(f"week_{i}") for i in range(7)]


def weekday_columns(day: Column) -> list[Column]:
    """``weekday_1`` (Monday) to ``weekday_7``; all 0 for null."""
    return [F.coalesce(F.weekday(day) + 1 == i, F.lit(False)).cast("int").alias(f"weekday_{i}") for i in range(1, 8)]


def distance_columns(distance: Column) -> list[Column]:
    """``distance__-1`` (unknown) and ``distance__0`` to ``distance__10``."""
    return [F.coalesce(distance == i, F.lit(False)).cast("int").alias(f"distance__{i}") for i in DISTANCE_BANDS]
