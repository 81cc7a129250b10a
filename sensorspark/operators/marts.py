"""Parameterised filter-and-aggregate marts: the queries behind the dashboard's tiles and charts.

Each takes a table, an inclusive range of calendar days and an optional entity; ``"All"`` or
``None`` switches the entity predicate off before the plan is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.functions import scores
from sensorspark.operators import profile
from sensorspark.operators.rollup import sum_or_zero
from sensorspark.session import with_scalars


def in_days(df: DataFrame, first: str, last: str, ts: str = "timestamp") -> DataFrame:
    """Half-open range on the bare column, so the filter reaches the scan."""
    start = F.lit(first).cast("timestamp")
    end = F.lit(last).cast("timestamp") + F.expr("interval 1 day")
    return df.where((F.col(ts) >= start) & (F.col(ts) < end))


def only(df: DataFrame, column: str, choice: str | None) -> DataFrame:
    return df if choice in (None, "All") else df.where(F.col(column) == choice)


def hour_means(df: DataFrame, means: dict[str, str], ts: str = "timestamp") -> DataFrame:
    return profile.mean_profile(df, [F.hour(ts).alias("hour")], means)


def traffic_by_hour(
    traffic: DataFrame, first: str, last: str, zone: str | None = None
) -> DataFrame:
    rows = only(in_days(traffic, first, last), "zone", zone)
    return hour_means(rows, {"avg_vehicles": "vehicle_count"})


def energy_by_hour(
    energy: DataFrame, first: str, last: str, building: str | None = None
) -> DataFrame:
    rows = only(in_days(energy, first, last), "building_type", building)
    return hour_means(rows, {"avg_energy": "energy_consumption_kwh"})


def pollutants_by_hour(
    air: DataFrame, first: str, last: str, station: str | None = None
) -> DataFrame:
    rows = only(in_days(air, first, last), "station_id", station)
    return hour_means(rows, {p: p for p in ("PM25", "PM10", "NO2", "O3")})


def aqi_series(
    air: DataFrame, first: str, last: str, station: str | None = None, rows: int = 2000
) -> DataFrame:
    """The first ``rows`` readings of the range in order of time, station and value."""
    chosen = only(in_days(air, first, last), "station_id", station)
    return chosen.select("timestamp", "station_id", "AQI").orderBy("timestamp", "station_id", "AQI").limit(rows)


def air_kpis(air: DataFrame, first: str, last: str, station: str | None = None) -> DataFrame:
    rows = only(in_days(air, first, last), "station_id", station)
    kpis = rows.agg(
        F.avg("AQI").alias("mean_aqi"),
        F.avg("PM25").alias("mean_pm25"),
        F.avg("PM10").alias("mean_pm10"),
        F.avg("NO2").alias("mean_no2"),
    )
    return kpis.withColumn("color", scores.traffic_light(F.round("mean_aqi", 1)))


def energy_kpis(
    energy: DataFrame, first: str, last: str, building: str | None = None
) -> DataFrame:
    rows = only(in_days(energy, first, last), "building_type", building)
    return rows.agg(
        (sum_or_zero("energy_consumption_kwh") / 1000).alias("total_mwh"),
        F.avg("renewable_percent").alias("mean_renewable"),
        sum_or_zero("cost_usd").alias("total_cost"),
    )


def speed_volume_sample(
    traffic: DataFrame, key: str, first: str, last: str, zone: str | None = None, n: int = 1000
) -> DataFrame:
    rows = only(in_days(traffic, first, last), "zone", zone)
    return profile.sample_rows(rows, key, n)


def overlay_series(master: DataFrame, n: int = 2000, scale: float = 50) -> DataFrame:
    """Sampled rows with the AQI scaled for a shared axis."""
    rows = master.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("_key"),
        "timestamp",
        "total_vehicles",
        (F.col("avg_AQI") * scale).alias("aqi_scaled"),
    )
    return profile.sample_rows(rows, "_key", n).drop("_key")


def label_rows(row: DataFrame, cells: list[tuple[str, Column]], names: tuple[str, str, str]):
    """A one-row frame as (position, label, text) rows."""
    position, label, value = names
    structs = [
        F.struct(
            F.lit(i).alias(position), F.lit(text).alias(label), column.cast("string").alias(value)
        )
        for i, (text, column) in enumerate(cells, 1)
    ]
    return row.select(F.inline(F.array(*structs)))


def peak_hours_text(master: DataFrame) -> DataFrame:
    """One row: the hours at the maximum of the three mean profiles, as comma-separated text."""
    by_hour = profile.mean_profile(master, ["hour"], profile.THREE_MEANS)
    peaks = profile.peak_groups(
        by_hour, "hour", {m: m for m in ("avg_vehicles", "avg_aqi", "avg_energy")}
    )

    def hours(measure: str) -> Column:
        # At most 24 hours per measure.
        found = F.array_sort(F.collect_list(F.when(F.col("measure") == measure, F.col("hour"))))
        return F.array_join(F.transform(found, lambda h: h.cast("string")), ", ")

    return peaks.agg(
        hours("avg_vehicles").alias("peak_traffic"),
        hours("avg_aqi").alias("peak_aqi"),
        hours("avg_energy").alias("peak_energy"),
    )


def quick_statistics(master: DataFrame) -> DataFrame:
    """The overview's key/value table."""
    bounds = master.agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.round(F.avg("temperature"), 1).alias("mean_temperature"),
    )
    row = with_scalars(bounds, peak_hours_text(master))
    clock = F.lit(":00")
    cells = [
        ("Date Range", F.concat_ws(" to ", "first_date", "last_date")),
        ("Peak Traffic Hour", F.concat("peak_traffic", clock)),
        ("Worst AQI Hour", F.concat("peak_aqi", clock)),
        ("Peak Energy Hour", F.concat("peak_energy", clock)),
        ("Avg Temperature", F.concat(F.col("mean_temperature").cast("string"), F.lit(" C"))),
    ]
    return label_rows(row, cells, ("position", "metric", "value"))


def worst_text(groups: DataFrame, key: str, measure: str, name: str) -> DataFrame:
    """One row: the groups at the maximum of a measure, as comma-separated text."""
    worst = profile.peak_groups(groups, key, {measure: measure})
    # Only the groups tied at the maximum are listed.
    return worst.agg(F.array_join(F.array_sort(F.collect_list(key)), ", ").alias(name))


def findings(master: DataFrame, zones: DataFrame, stations: DataFrame) -> DataFrame:
    """The key findings of the exploratory report as (position, key, value)."""
    bounds = master.agg(
        F.count(F.lit(1)).alias("records"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    row = with_scalars(bounds, peak_hours_text(master))
    row = with_scalars(row, worst_text(zones, "zone", "congestion_rate", "worst_zone"))
    row = with_scalars(row, worst_text(stations, "station_id", "avg_aqi", "worst_station"))
    clock = F.lit(":00")
    cells = [
        ("Records", F.format_number("records", 0)),
        ("Date Range", F.concat_ws(" to ", "first_date", "last_date")),
        ("Peak Traffic Hour", F.concat("peak_traffic", clock)),
        ("Worst Air Quality Hour", F.concat("peak_aqi", clock)),
        ("Peak Energy Hour", F.concat("peak_energy", clock)),
        ("Most Congested Zone", F.col("worst_zone")),
        ("Worst AQI Station", F.col("worst_station")),
    ]
    return label_rows(row, cells, ("position", "key", "value"))


def combine(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
