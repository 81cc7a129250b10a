"""Cleaning rules, calendar features, bins and labels on hand-built edge rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sensorspark.functions import calendar, clean, scores


def values(df, column):
    return [row[column] for row in df.collect()]


def test_range_rules_keep_the_bounds(spark):
    df = spark.createDataFrame([(-0.1,), (0.0,), (120.0,), (120.1,), (None,)], "v double")
    out = df.select(clean.range_or_null(F.col("v"), 0, 120).alias("v"))
    assert values(out, "v") == [None, 0.0, 120.0, None, None]


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(-5.0,), (3.0,), (99.0,), (None,)], "v double")
    one = df.select(clean.clamp(F.col("v"), lo=0.0).alias("v"))
    two = df.select(clean.clamp(F.col("v"), 0.0, 10.0).alias("v"))
    assert values(one, "v") == [0.0, 3.0, 99.0, None]
    assert values(two, "v") == [0.0, 3.0, 10.0, None]


def test_traffic_cleaner_parses_text_and_drops_bad_rows(spark):
    rows = [
        ("2025-03-01 06:30:00", "A", 0, 120.0, "Low"),
        ("2025-03-02", "A", 5, 0.0, "High"),
        ("2025-03-03 01:00:00", "A", -1, 10.0, "Low"),
        ("2025-03-03 02:00:00", "A", 1, 120.5, "Low"),
        ("2025-03-03 03:00:00", "A", None, 10.0, "Low"),
    ]
    raw = spark.createDataFrame(
        rows,
        "timestamp string, zone string, vehicle_count int, average_speed double, "
        "congestion_level string",
    )
    out = {r["timestamp"]: r for r in clean.clean_traffic(raw).collect()}
    assert set(out) == {datetime(2025, 3, 1, 6, 30), datetime(2025, 3, 2)}
    first = out[datetime(2025, 3, 1, 6, 30)]
    assert (first["weekday"], first["is_weekend"], first["time_of_day"]) == ("Sat", True, "Morning")


def test_air_cleaner_keeps_rows_with_optional_gaps(spark):
    raw = spark.createDataFrame(
        [
            (datetime(2025, 1, 1), "S", 1.0, 1.0, -1.0, -1.0, 61.0, 101.0, 10, "Good"),
            (datetime(2025, 1, 2), "S", -1.0, 1.0, 1.0, 1.0, 60.0, 100.0, 10, "Good"),
        ],
        "timestamp timestamp, station_id string, PM25 double, PM10 double, NO2 double, O3 double, "
        "temperature double, humidity double, AQI int, AQI_category string",
    )
    (row,) = clean.clean_air_quality(raw).collect()
    assert (row["NO2"], row["O3"], row["temperature"], row["humidity"]) == (None,) * 4


def test_weather_cleaner(spark):
    raw = spark.createDataFrame(
        [
            (datetime(2025, 1, 1), -50.0, 0.0, 150.5, -2.0, 1000.0, "Clear"),
            (datetime(2025, 1, 2), -50.5, 0.0, 1.0, 0.0, 1000.0, "Clear"),
        ],
        "timestamp timestamp, temperature double, humidity double, wind_speed double, "
        "precipitation_mm double, pressure_hpa double, condition string",
    )
    (row,) = clean.clean_weather(raw).collect()
    assert (row["wind_speed"], row["precipitation_mm"]) == (None, 0.0)
    assert "weekday" not in row.asDict()


@pytest.mark.parametrize(
    "hour,bucket",
    [(0, "Night"), (5, "Night"), (6, "Morning"), (11, "Morning"), (12, "Afternoon"),
     (17, "Afternoon"), (18, "Evening"), (21, "Evening"), (22, "Night"), (23, "Night")],
)
def test_time_of_day(spark, hour, bucket):
    df = spark.range(1).select(calendar.time_of_day(F.lit(hour)).alias("b"))
    assert values(df, "b") == [bucket]


def test_seasons_and_missing_hour(spark):
    df = spark.createDataFrame([(m,) for m in range(1, 13)], "m int")
    got = values(df.orderBy("m").select(calendar.season(F.col("m")).alias("s")), "s")
    assert got == ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + ["Fall"] * 3 + ["Winter"]
    night = spark.range(1).select(calendar.time_of_day(F.lit(None).cast("int")).alias("b"))
    assert values(night, "b") == ["Night"]


def test_weekday_numbers(spark):
    df = spark.createDataFrame([(datetime(2025, 1, d),) for d in (4, 5, 6)], "t timestamp")
    t = F.col("t")
    out = df.orderBy("t").select(
        calendar.weekday_number(t).alias("n"),
        calendar.monday_first(t).alias("m"),
        calendar.is_weekend(t).alias("w"),
        calendar.weekday_name(t).alias("name"),
    )
    assert [tuple(r) for r in out.collect()] == [
        (7, 5, True, "Saturday"), (1, 6, True, "Sunday"), (2, 0, False, "Monday"),
    ]


def test_aqi_bins_are_left_closed(spark):
    data = [-1.0, 0.0, 49.9, 50.0, 100.0, 150.0, 200.0, 300.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "i int, v double")
    got = values(df.orderBy("i").select(scores.aqi_category(F.col("v")).alias("c")), "c")
    assert got == [
        None, "Good", "Good", "Moderate", "Unhealthy_Sensitive", "Unhealthy", "Very_Unhealthy",
        "Hazardous", None,
    ]


def test_row_max_carries_null(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, None, 3)], "a int, b int, c int")
    assert values(df.select(scores.row_max(*map(F.col, "abc")).alias("m")), "m") == [3, None]


def test_severity_labels(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 5, None)], "s int")
    got = values(df.select(scores.severity_label(F.col("s")).alias("l")), "l")
    assert got == ["Normal", "Low", "Medium", "High", "Critical", "Critical", None]


def test_cluster_and_silhouette_labels(spark):
    df = spark.createDataFrame([(0, 0.8), (3, 0.6), (1, 0.3), (2, 0.1)], "c int, s double")
    out = df.select(scores.cluster_label(F.col("c")).alias("c"),
                    scores.silhouette_band(F.col("s")).alias("s"))
    assert [tuple(r) for r in out.collect()] == [
        ("Anomaly", "strong"), ("Cluster 3", "reasonable"), ("Cluster 1", "weak"),
        ("Cluster 2", "none"),
    ]
