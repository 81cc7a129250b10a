"""Row numbers and halo windows against a single unpartitioned window."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorspark.operators import anomaly, features, rollup, sequence


def series(spark, n, seed=0, gaps=0.1):
    rng = np.random.default_rng(seed)
    rows = [
        (int(i), None if rng.random() < gaps else float(rng.normal()), float(rng.normal()))
        for i in rng.permutation(n)
    ]
    return spark.createDataFrame(rows, "t int, x double, y double")


@pytest.mark.parametrize("n_partitions", [1, 4, 32])
def test_row_ids_are_dense_and_ordered(spark, partitions, n_partitions):
    partitions(n_partitions)
    got = sequence.with_row_id(series(spark, 1000).repartition(9), ["t"]).orderBy("t").collect()
    assert [r["row_id"] for r in got] == list(range(1, 1001))


def test_a_hot_leading_key_is_numbered_by_the_next_key(spark, partitions):
    partitions(16)
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("a"), F.col("id").alias("b")
    )
    got = sequence.with_row_id(df.repartition(5), ["a", "b"]).collect()
    want = sorted((r["a"], r["b"]) for r in got)
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["row_id"])] == want
    assert sorted(r["row_id"] for r in got) == list(range(1, 3001))


@pytest.mark.parametrize("n,block_rows", [(300, 25), (300, 24), (24, 24), (25, 30), (10, 64)])
def test_windows_equal_the_unpartitioned_ones(spark, n, block_rows):
    numbered = sequence.with_row_id(series(spark, n), ["t"])
    w = Window.orderBy("row_id")
    seven = w.rowsBetween(-6, 0)
    past = w.rowsBetween(-24, -1)
    sd = F.stddev_samp("x").over(past)
    want = numbered.select(
        "row_id",
        F.lag("x", 1).over(w).alias("l1"),
        F.lag("x", 24).over(w).alias("l24"),
        F.when(F.count("x").over(seven) == 7, F.avg("x").over(seven)).alias("m7"),
        F.when(F.col("row_id") <= 24, F.lit(False))
        .when(sd.isNull() | (sd <= 0), F.lit(False))
        .otherwise(F.abs(F.col("x") - F.avg("x").over(past)) > 2 * sd)
        .alias("flag"),
    )
    lagged = sequence.lagged(numbered, {"l1": ("x", 1), "l24": ("x", 24)}, block_rows)
    rolled = sequence.rolling_means(lagged, {"m7": "x"}, block_rows=block_rows)
    flagged = anomaly.trailing_flags(rolled, {"x": "x"}, block_rows=block_rows)
    got = flagged.select("row_id", "l1", "l24", "m7", F.col("x_anomaly_ma").alias("flag"))
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])
    for mine, theirs in zip(rows(got), rows(want), strict=True):
        assert mine == pytest.approx(theirs, nan_ok=True)


def test_leak_free_mean_ends_before_the_current_row(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "t int, x double")
    numbered = sequence.with_row_id(df, ["t"])
    got = sequence.rolling_means(numbered, {"m": "x"}, leak_free=True).orderBy("t").collect()
    assert [r["m"] for r in got] == [None] * 7 + [3.0, 4.0, 5.0]


def test_block_shorter_than_halo_is_refused(spark):
    with pytest.raises(ValueError):
        sequence.HaloFrames(spark.range(3).toDF("row_id"), 24, 10)


def test_split_is_disjoint_and_ordered(spark):
    numbered = sequence.with_row_id(series(spark, 101), ["t"])
    split = sequence.chronological_split(numbered).collect()
    train = [r["t"] for r in split if r["is_train"]]
    test = [r["t"] for r in split if not r["is_train"]]
    assert len(train) == 80 and len(test) == 21 and max(train) < min(test)
    assert sorted(r["t"] for r in sequence.first_rows(numbered, 5).collect()) == [0, 1, 2, 3, 4]


def test_model_inputs_are_listed_once():
    sizes = {m: len(inputs) for m, (_, inputs) in features.MODELS.items()}
    assert sizes == {"traffic": 12, "aqi": 13, "energy": 11}
    assert all(label not in inputs for label, inputs in features.MODELS.values())


def test_master_join_fans_out_and_keeps_gaps(spark):
    traffic = spark.sql(
        "select timestamp'2025-01-01 00:00:00' as timestamp, 5 as vehicle_count, 10.0D as "
        "average_speed, 'High' as congestion_level union all "
        "select timestamp'2025-01-01 01:00:00', null, null, null"
    )
    air = spark.sql(
        "select timestamp'2025-01-01 00:00:00' as timestamp, 1D as PM25, 1D as PM10, 1D as NO2, "
        "1D as O3, 50 as AQI, 1D as temperature, 1D as humidity"
    )
    energy = spark.sql(
        "select timestamp'2025-01-01 02:00:00' as timestamp, 1D as energy_consumption_kwh, "
        "1D as peak_demand_kw, 1D as renewable_percent, 1D as cost_usd"
    )
    weather = spark.sql(
        "select timestamp'2025-01-01 00:00:00' as timestamp, t as temperature, 1D as humidity, "
        "1D as wind_speed, 0D as precipitation_mm, 1D as pressure_hpa, 'Clear' as condition "
        "from values (1D), (2D) as v(t)"
    )
    got = rollup.master_join(
        rollup.traffic_hourly(traffic), rollup.air_quality_hourly(air),
        rollup.energy_hourly(energy), weather,
    ).orderBy("timestamp", "temperature").collect()
    assert [r["total_vehicles"] for r in got] == [5, 5, 0]
    assert [r["temperature"] for r in got] == [1.0, 2.0, None]
    assert all(r["total_energy_kwh"] is None for r in got)
    assert got[2]["avg_speed"] is None and got[2]["high_congestion_zones"] == 0


def test_daily_peak_takes_the_first_of_tied_hours(spark):
    df = spark.sql(
        "select make_timestamp(2025, 1, 1, h, 0, 0) as timestamp, h as hour, date'2025-01-01' as "
        "date, v as total_vehicles, 1D as avg_AQI, 1D as total_energy_kwh, false as is_weekend, "
        "'Wed' as weekday from values (3, 9), (1, 9), (2, 4), (0, null) as t(h, v)"
    )
    (row,) = rollup.daily_patterns(df).collect()
    assert (row["peak_hour"], row["max_traffic"], row["total_traffic"]) == (1, 9, 22)
    (week,) = rollup.weekday_patterns(df).collect()
    assert week["peak_hour"] == 1
