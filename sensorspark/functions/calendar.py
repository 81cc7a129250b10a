"""Calendar and cyclic features of a timestamp column (UTC session)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_timestamp(text: Column) -> Column:
    """Full or date-only timestamp text; text that is unreadable or names no date gives NULL."""
    return F.when(text.rlike(r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"), F.try_to_timestamp(text))


def weekday_number(ts: Column) -> Column:
    """Sunday = 1 … Saturday = 7."""
    return F.dayofweek(ts)


def weekday_label(ts: Column) -> Column:
    return F.date_format(ts, "E")


def weekday_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def monday_first(ts: Column) -> Column:
    """Sort key of full weekday names: Monday = 0 … Sunday = 6."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return F.dayofweek(ts).isin(1, 7)


def time_of_day(hour: Column) -> Column:
    return (
        F.when((hour >= 6) & (hour < 12), "Morning")
        .when((hour >= 12) & (hour < 18), "Afternoon")
        .when((hour >= 18) & (hour < 22), "Evening")
        .otherwise("Night")
    )


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer")
        .when(month.isin(9, 10, 11), "Fall")
    )


def month_floor(ts: Column) -> Column:
    return F.date_trunc("month", ts)


def hour_sin(hour: Column) -> Column:
    return F.sin(2 * math.pi * hour / 24)


def hour_cos(hour: Column) -> Column:
    return F.cos(2 * math.pi * hour / 24)


def add_calendar(df: DataFrame, ts: str = "timestamp", weekdays: bool = True) -> DataFrame:
    """hour, day, month, date and, unless switched off, weekday and is_weekend."""
    c = F.col(ts)
    features = {
        "hour": F.hour(c),
        "day": F.dayofmonth(c),
        "month": F.month(c),
        "date": F.to_date(c),
    }
    if weekdays:
        features["weekday"] = weekday_label(c)
        features["is_weekend"] = is_weekend(c)
    return df.withColumns(features)


def hourly_keys(ts: str = "timestamp") -> list[Column]:
    """The calendar columns a rollup carries; all are functions of the timestamp."""
    c = F.col(ts)
    return [
        F.hour(c).alias("hour"),
        F.to_date(c).alias("date"),
        weekday_label(c).alias("weekday"),
        is_weekend(c).alias("is_weekend"),
    ]
