"""Hourly, daily, weekday and month rollups, and the join into one wide hourly table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.functions import calendar

WEATHER_COLUMNS = [
    "temperature",
    "humidity",
    "wind_speed",
    "precipitation_mm",
    "pressure_hpa",
    "condition",
]


def sum_or_zero(c: Column | str) -> Column:
    """Sum that skips NULL and gives 0 for an all-NULL group."""
    return F.coalesce(F.sum(c), F.lit(0))


def by_timestamp(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Group on the timestamp alone.

    The calendar columns are functions of the timestamp, so they are derived after the
    aggregation instead of widening the grouping key.  Readings are combined before the shuffle:
    each map task ships at most one row per timestamp it saw, however hot that timestamp is.
    """
    grouped = df.groupBy("timestamp").agg(*aggregates)
    return grouped.select("timestamp", *calendar.hourly_keys(), *grouped.columns[1:])


AIR_MEASURES = ["PM25", "PM10", "NO2", "O3", "AQI", "temperature", "humidity"]


def _measure(feed: str | None, name: str) -> Column:
    """A feed's column: of its own table, or a field of its struct in a mixed one."""
    return F.col(name) if feed is None else F.col(feed)[name]


def _traffic_measures(feed: str | None = None) -> list[Column]:
    return [
        sum_or_zero(_measure(feed, "vehicle_count")).alias("total_vehicles"),
        F.avg(_measure(feed, "average_speed")).alias("avg_speed"),
        F.count_if(_measure(feed, "congestion_level") == "High").alias("high_congestion_zones"),
    ]


def _air_measures(feed: str | None = None) -> list[Column]:
    return [F.avg(_measure(feed, c)).alias(f"avg_{c}") for c in AIR_MEASURES]


def _energy_measures(feed: str | None = None) -> list[Column]:
    return [
        sum_or_zero(_measure(feed, "energy_consumption_kwh")).alias("total_energy_kwh"),
        F.avg(_measure(feed, "peak_demand_kw")).alias("avg_peak_demand"),
        F.avg(_measure(feed, "renewable_percent")).alias("avg_renewable_percent"),
        sum_or_zero(_measure(feed, "cost_usd")).alias("total_cost"),
    ]


def traffic_hourly(traffic: DataFrame) -> DataFrame:
    return by_timestamp(traffic, *_traffic_measures())


def air_quality_hourly(air: DataFrame) -> DataFrame:
    return by_timestamp(air, *_air_measures())


def energy_hourly(energy: DataFrame) -> DataFrame:
    return by_timestamp(energy, *_energy_measures())


def mixed_hourly(readings: DataFrame, *more: Column) -> DataFrame:
    """The wide table of one mixed feed, by one aggregate in place of rollups and joins.

    ``readings`` has timestamp and the structs ``traffic``, ``air`` and ``energy`` with their feeds'
    measures; a struct is null where the reading has none of that kind.  Like the joined table it has the
    hours with traffic, and null in a feed's columns where the hour has none of its readings.
    ``more`` are further aggregates.
    """
    energy = _energy_measures("energy")
    grouped = by_timestamp(
        readings,
        *_traffic_measures("traffic"),
        *_air_measures("air"),
        *energy,
        F.count("traffic").alias("_traffic"),
        F.count("energy").alias("_energy"),
        *more,
    )
    sums = {c: F.when(F.col("_energy") > 0, F.col(c)) for c in ("total_energy_kwh", "total_cost")}
    return grouped.where(F.col("_traffic") > 0).withColumns(sums).drop("_traffic", "_energy")


def master_join(
    traffic: DataFrame, air: DataFrame, energy: DataFrame, weather: DataFrame
) -> DataFrame:
    """Left joins on the timestamp; the left side keeps its calendar columns.

    The rollups leave the shuffle hash-partitioned on the timestamp, so the joins need no second
    exchange for them.
    """
    keys = ["hour", "date", "weekday", "is_weekend"]
    return (
        traffic.join(air.drop(*keys), "timestamp", "left")
        .join(energy.drop(*keys), "timestamp", "left")
        .join(weather.select("timestamp", *WEATHER_COLUMNS), "timestamp", "left")
    )


def monthly_cost(master: DataFrame) -> DataFrame:
    return master.groupBy(calendar.month_floor(F.col("timestamp")).alias("month")).agg(
        sum_or_zero("total_cost").alias("total_cost")
    )


def daily_patterns(master: DataFrame) -> DataFrame:
    """One row per day; ``peak_hour`` is the earliest hour that reaches the day's maximum."""
    earliest_max = F.struct("total_vehicles", -F.unix_micros("timestamp"))
    return master.groupBy("date").agg(
        sum_or_zero("total_vehicles").alias("total_traffic"),
        F.avg("avg_AQI").alias("avg_aqi"),
        sum_or_zero("total_energy_kwh").alias("total_energy"),
        F.max("total_vehicles").alias("max_traffic"),
        F.max_by("hour", F.when(F.col("total_vehicles").isNotNull(), earliest_max)).alias(
            "peak_hour"
        ),
        F.max("is_weekend").alias("is_weekend"),
    )


def weekday_patterns(master: DataFrame) -> DataFrame:
    """One row per weekday; ``peak_hour`` is the most frequent hour among the rows that reach the
    weekday's maximum, the smallest such hour on a tie.

    Both broadcast tables hold one row per weekday.
    """
    peaks = master.groupBy("weekday").agg(F.max("total_vehicles").alias("weekday_top"))
    means = master.groupBy("weekday").agg(
        F.avg("total_vehicles").alias("avg_traffic"),
        F.avg("avg_AQI").alias("avg_aqi"),
        F.avg("total_energy_kwh").alias("avg_energy"),
        F.stddev_samp("total_vehicles").alias("traffic_variability"),
    )
    at_peak = (
        master.select("weekday", "hour", "total_vehicles")
        .join(F.broadcast(peaks), "weekday")
        .where(F.col("total_vehicles") == F.col("weekday_top"))
        .groupBy("weekday", "hour")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("weekday")
        .agg(F.max_by("hour", F.struct("n", -F.col("hour"))).alias("peak_hour"))
    )
    return means.join(F.broadcast(at_peak), "weekday", "left")
