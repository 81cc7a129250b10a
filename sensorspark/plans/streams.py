"""Streaming queries: each runs over the whole input with an available-now trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorspark.operators import anomaly, features, forecast
from sensorspark.operators.anomaly import METRICS
from sensorspark.plans import adapters as a
from sensorspark.plans.anomalies import _FEATURE_SQL, SCORED, _flags, _VALUES, numbered_master
from sensorspark.plans.registry import query, r, rs
from sensorspark.session import scratch_path
from sensorspark.sources import tables
from sensorspark.streaming import stream


def _readings(spark: SparkSession, d: str) -> DataFrame:
    schema = a.table(spark, d, "events").schema
    return a.readings_of(stream.read_stream(spark, d, schema, "events.parquet"))


def _closed_hours(spark: SparkSession, d: str):
    return stream.run_available(
        stream.hourly_rollup(_readings(spark, d), "entity", "x"), "stream-hourly"
    )


CLOSED = f"""{a.READINGS}, closed AS (
  SELECT date_trunc('hour', timestamp) AS timestamp, entity, count(*) AS n, sum(x) AS total,
         avg(x) AS mean
  FROM readings
  WHERE date_trunc('hour', timestamp) + INTERVAL 1 HOUR
        <= (SELECT max(timestamp) FROM readings) - INTERVAL 2 HOUR
  GROUP BY 1, 2)"""


@query(
    "stream_hourly_rollup",
    f"WITH {CLOSED} SELECT timestamp, entity, n, {rs('total', 'mean')} FROM closed",
)
def stream_hourly_rollup(spark: SparkSession, d: str) -> DataFrame:
    return stream.read_result(spark, _closed_hours(spark, d))


@query(
    "stream_trailing_flags",
    f"""WITH {CLOSED}, w AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY timestamp) AS rn,
         avg(total) OVER p AS m, stddev_samp(total) OVER p AS s FROM closed
  WINDOW p AS (PARTITION BY entity ORDER BY timestamp ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT timestamp, entity, {rs('total')},
       CASE WHEN rn <= 24 OR s IS NULL OR s <= 0 THEN false ELSE abs(total - m) > 2 * s END
         AS is_anomaly
FROM w""",
)
def stream_trailing_flags(spark: SparkSession, d: str) -> DataFrame:
    path, schema = _closed_hours(spark, d)
    hourly = stream.read_stream(spark, path, schema)
    flagged = stream.trailing_flags(hourly, "entity", "total")
    return stream.read_result(spark, stream.run_available(flagged, "stream-trailing"))


@query(
    "stream_hour_flags",
    f"WITH {SCORED} SELECT timestamp, {_VALUES}, {_flags('time_anomaly')} FROM scored",
)
def stream_hour_flags(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "master")
    tables.write_table(a.hourly(spark, d), path)
    master = tables.read_table(spark, path)
    flagged = stream.hour_flags(
        stream.read_stream(spark, path, master.schema), anomaly.hour_profile_sd(master)
    ).select("timestamp", *METRICS.values(), *[f"{m}_time_anomaly" for m in METRICS])
    return stream.read_result(spark, stream.run_available(flagged, "stream-hours"))


@query(
    "stream_scores",
    f"""WITH {_FEATURE_SQL}, p AS (
  SELECT timestamp, total_energy_kwh, row_number() OVER (ORDER BY timestamp) AS rn,
         count(*) OVER () AS n FROM model)
SELECT timestamp, {r('total_energy_kwh', 'total_energy_kwh')}, CAST(0 AS DOUBLE) AS off_batch
FROM p WHERE rn > floor(0.8 * n)""",
)
def stream_scores(spark: SparkSession, d: str) -> DataFrame:
    """The test rows arrive as a stream; the forest was trained on the earlier part.

    ``off_batch`` is how far each streamed prediction lies from the batch prediction of its row.
    """
    split = features.split_frame(numbered_master(spark, d))
    train_rows, test_rows = forecast.split_parts(split)
    fitted = forecast.train(train_rows, "energy")
    path = scratch_path(spark, "test-rows")
    tables.write_table(test_rows, path)
    arriving = stream.read_stream(spark, path, test_rows.schema)
    scored = stream.scores(arriving, fitted, ["row_id", "timestamp", "total_energy_kwh"])
    out = stream.read_result(spark, stream.run_available(scored, "stream-scores"))
    batch = forecast.predict(fitted, tables.read_table(spark, path), "energy").select(
        "row_id", F.col("predicted").alias("in_batch")
    )
    return out.join(batch, "row_id", "full").select(
        "timestamp", "total_energy_kwh", F.abs(F.col("predicted") - F.col("in_batch")).alias("off_batch")
    )
