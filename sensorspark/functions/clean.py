"""Range rules, required columns and the per-feed cleaners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sensorspark.functions import calendar


def range_or_null(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Keep values inside the inclusive range, NULL otherwise."""
    inside = F.lit(True)
    if lo is not None:
        inside = inside & (c >= lo)
    if hi is not None:
        inside = inside & (c <= hi)
    return F.when(inside, c)


def clamp(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Move values outside the range to its bound; NULL stays NULL."""
    out = c
    if lo is not None:
        out = F.when(c < lo, F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(c > hi, F.lit(hi)).otherwise(out)
    return out


def nonnegative_or_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: range_or_null(F.col(c), lo=0) for c in columns})


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows that lack any of ``columns``."""
    return df.dropna(how="any", subset=columns)


def complete_cases(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=columns)


def _stamp(raw: DataFrame) -> Column:
    """The timestamp column as a timestamp; text is parsed, unreadable text becomes NULL."""
    c = F.col("timestamp")
    is_text = raw.schema["timestamp"].dataType == StringType()
    return calendar.parse_timestamp(c) if is_text else c.cast("timestamp")


def clean_traffic(raw: DataFrame) -> DataFrame:
    ranged = raw.withColumns(
        {
            "timestamp": _stamp(raw),
            "vehicle_count": range_or_null(F.col("vehicle_count"), lo=0),
            "average_speed": range_or_null(F.col("average_speed"), lo=0, hi=120),
        }
    )
    kept = require(ranged, ["vehicle_count", "average_speed"])
    return calendar.add_calendar(kept).withColumn(
        "time_of_day", calendar.time_of_day(F.col("hour"))
    )


def clean_air_quality(raw: DataFrame) -> DataFrame:
    ranged = nonnegative_or_null(raw, ["PM25", "PM10", "NO2", "O3", "AQI"]).withColumns(
        {
            "timestamp": _stamp(raw),
            "temperature": range_or_null(F.col("temperature"), lo=-50, hi=60),
            "humidity": range_or_null(F.col("humidity"), lo=0, hi=100),
        }
    )
    return calendar.add_calendar(require(ranged, ["PM25", "PM10", "AQI"]))


def clean_energy(raw: DataFrame) -> DataFrame:
    ranged = nonnegative_or_null(raw, ["energy_consumption_kwh", "peak_demand_kw"]).withColumns(
        {
            "timestamp": _stamp(raw),
            "renewable_percent": range_or_null(F.col("renewable_percent"), lo=0, hi=100),
        }
    )
    kept = calendar.add_calendar(require(ranged, ["energy_consumption_kwh"]))
    return kept.withColumn("season", calendar.season(F.col("month")))


def clean_weather(raw: DataFrame) -> DataFrame:
    ranged = raw.withColumns(
        {
            "timestamp": _stamp(raw),
            "temperature": range_or_null(F.col("temperature"), lo=-50, hi=60),
            "humidity": range_or_null(F.col("humidity"), lo=0, hi=100),
            "wind_speed": range_or_null(F.col("wind_speed"), lo=0, hi=150),
            "precipitation_mm": clamp(F.col("precipitation_mm"), lo=0.0),
        }
    )
    return calendar.add_calendar(require(ranged, ["temperature", "humidity"]), weekdays=False)
