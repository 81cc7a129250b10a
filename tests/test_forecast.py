"""Forecast metrics, importances, scenarios and the streaming scorer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorspark.operators import features, forecast, sequence
from sensorspark.session import scratch_path
from sensorspark.sources import tables
from sensorspark.streaming import stream


@pytest.fixture(scope="module")
def split(spark):
    rng = np.random.default_rng(0)
    hours = spark.range(400).withColumn(
        "timestamp", F.timestamp_seconds(F.lit(1_735_689_600) + F.col("id") * 3600)
    )
    wave = F.sin(F.col("id") * 2 * np.pi / 24)
    noise = lambda i: F.rand(int(rng.integers(1000)) + i)
    master = hours.select(
        "timestamp",
        F.hour("timestamp").alias("hour"),
        F.dayofweek("timestamp").isin(1, 7).alias("is_weekend"),
        (1000 + 300 * wave + 5 * noise(1)).alias("total_vehicles"),
        (60 + 10 * wave + noise(2)).alias("avg_AQI"),
        (500 + 90 * wave + noise(3)).alias("total_energy_kwh"),
        (20 + 5 * wave + noise(4)).alias("temperature"),
        (50 + noise(5)).alias("humidity"),
        (10 + noise(6)).alias("wind_speed"),
        noise(7).alias("precipitation_mm"),
        (30 + noise(8)).alias("avg_NO2"),
    )
    numbered = sequence.with_row_id(master, ["timestamp"])
    return numbered, features.split_frame(numbered)


def test_metrics_are_errors_and_squared_correlation(spark):
    df = spark.createDataFrame([("m", 1.0, 3.0), ("m", 2.0, 5.0), ("m", 3.0, 7.0)],
                               "model string, actual double, predicted double")
    (row,) = forecast.metrics(df).collect()
    assert row["r2"] == pytest.approx(1.0)
    assert row["mae"] == pytest.approx(3.0) and row["rmse"] == pytest.approx(np.sqrt(29 / 3))


def test_forest_importance_and_series(spark, split):
    numbered, frame = split
    train_rows, test_rows = forecast.split_parts(frame)
    assert train_rows.count() == int(0.8 * 376) and test_rows.count() == 376 - int(0.8 * 376)
    fitted = forecast.train(train_rows, "traffic")
    predictions = forecast.predict(fitted, test_rows, "traffic")
    (row,) = forecast.metrics(predictions).collect()
    assert row["r2"] > 0.9
    series = forecast.test_series(predictions, frame, n=10).orderBy("time").collect()
    assert [r["time"] for r in series] == list(range(1, 11))
    impurity = forecast.impurity_importance(spark, fitted, "traffic").collect()
    assert len(impurity) == 5
    shuffled = forecast.permutation_importance(train_rows, "traffic", top=12).collect()
    assert len(shuffled) == 12 and shuffled[0]["importance"] > 0
    noise = {r["feature"]: r["importance"] for r in shuffled}
    assert noise["precipitation_mm"] < shuffled[0]["importance"]


def test_stream_scores_equal_batch_scores(spark, split):
    _, frame = split
    train_rows, test_rows = forecast.split_parts(frame)
    fitted = forecast.train(train_rows, "energy")
    path = scratch_path(spark, "arriving")
    tables.write_table(test_rows, path)
    arriving = stream.read_stream(spark, path, test_rows.schema)
    result = stream.run_available(stream.scores(arriving, fitted, ["row_id"]), "scores")
    got = {r["row_id"]: r["predicted"] for r in stream.read_result(spark, result).collect()}
    want = {r["row_id"]: r["predicted"]
            for r in forecast.predict(fitted, test_rows, "energy").collect()}
    assert got == want


def test_scenarios_out_of_range_are_refused(spark, split):
    numbered, frame = split
    fitted = forecast.train(forecast.split_parts(frame)[0], "energy")
    good = spark.createDataFrame([(0, True, 20.0, 50.0), (23, False, -10.0, 100.0)],
                                 "hour int, weekend boolean, temperature double, humidity double")
    rows = forecast.score_scenarios({"energy": fitted}, good, numbered).collect()
    assert len(rows) == 2 and all(r["predicted_energy"] > 0 for r in rows)
    bad = good.withColumn("hour", F.lit(24))
    with pytest.raises(Exception, match="hour must lie in"):
        forecast.score_scenarios({"energy": fitted}, bad, numbered).collect()


def test_training_on_nothing_is_refused(split):
    _, frame = split
    with pytest.raises(ValueError):
        forecast.train(frame.where("false"), "traffic")


def test_scenarios_keep_their_types_and_refuse_bad_values(spark):
    good = spark.createDataFrame([(5, True, 20.0, 50.0)], "hour int, weekend boolean, temperature double, humidity double")
    assert dict(forecast.checked_scenarios(good).dtypes)["hour"] == "int"
    for row in ((24, True, 20.0, 50.0), (5, True, 41.0, 50.0), (5, True, None, 50.0)):
        with pytest.raises(Exception, match="must lie in|is missing"):
            forecast.checked_scenarios(spark.createDataFrame([row], good.schema)).collect()
