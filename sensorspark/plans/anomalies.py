"""Ordered-series features, detectors, severity and the anomaly marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorspark.operators import anomaly, features, sequence
from sensorspark.operators.anomaly import CHI2_999_DF3, METRICS
from sensorspark.plans import adapters as a
from sensorspark.plans.registry import query, r, rs
from sensorspark.plans.relational import MASTER_OUT
from sensorspark.session import materialize


def numbered_master(spark: SparkSession, d: str) -> DataFrame:
    """The wide hourly table, written once in time order with its row numbers."""
    return sequence.with_row_id(a.hourly(spark, d), ["timestamp"], "master")


def scored_master(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.score_all(numbered_master(spark, d))


# --- SQL pieces ------------------------------------------------------------------------------


def _each(template: str, sep: str = ", ") -> str:
    return sep.join(template.format(m=m, c=c) for m, c in METRICS.items())


SCORED = f"""{a.HOURLY}, st AS (
  SELECT {_each('avg({c}) AS {m}_avg, stddev_samp({c}) AS {m}_std, '
                'quantile_cont(CAST({c} AS DOUBLE), 0.25) AS {m}_q1, '
                'quantile_cont(CAST({c} AS DOUBLE), 0.75) AS {m}_q3')}
  FROM hourly),
hp AS (
  SELECT hour AS hh, {_each('avg({c}) AS {m}_hm, stddev_samp({c}) AS {m}_hs')}
  FROM hourly GROUP BY hour),
seq AS (
  SELECT *, row_number() OVER (ORDER BY timestamp) AS row_id,
         {_each('avg({c}) OVER w AS {m}_wm, stddev_samp({c}) OVER w AS {m}_ws')}
  FROM hourly
  WINDOW w AS (ORDER BY timestamp ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
cv AS (
  SELECT count(*) AS n, avg(total_vehicles) AS m0, avg(avg_AQI) AS m1,
         avg(total_energy_kwh) AS m2, var_samp(total_vehicles) AS s00,
         covar_samp(total_vehicles, avg_AQI) AS s01,
         covar_samp(total_vehicles, total_energy_kwh) AS s02, var_samp(avg_AQI) AS s11,
         covar_samp(avg_AQI, total_energy_kwh) AS s12, var_samp(total_energy_kwh) AS s22
  FROM hourly
  WHERE total_vehicles IS NOT NULL AND avg_AQI IS NOT NULL AND total_energy_kwh IS NOT NULL),
dt AS (
  SELECT *, s00 * (s11 * s22 - s12 * s12) - s01 * (s01 * s22 - s12 * s02)
            + s02 * (s01 * s12 - s11 * s02) AS det FROM cv),
flagged AS (
  SELECT seq.*, {_each('abs(({c} - {m}_avg) / nullif({m}_std, 0)) > 3 AS {m}_anomaly')},
         {_each('({c} < {m}_q1 - 1.5 * ({m}_q3 - {m}_q1) OR '
                '{c} > {m}_q3 + 1.5 * ({m}_q3 - {m}_q1)) AS {m}_anomaly_iqr')},
         {_each('CASE WHEN row_id <= 24 THEN false '
                'WHEN {m}_ws IS NULL OR {m}_ws <= 0 THEN false '
                'ELSE abs({c} - {m}_wm) > 2 * {m}_ws END AS {m}_anomaly_ma')},
         {_each('abs({c} - {m}_hm) > 2 * {m}_hs AS {m}_time_anomaly')},
         CASE WHEN n > 10 AND det > 1e-10 THEN (
           power(total_vehicles - m0, 2) * (s11 * s22 - s12 * s12)
           + power(avg_AQI - m1, 2) * (s00 * s22 - s02 * s02)
           + power(total_energy_kwh - m2, 2) * (s00 * s11 - s01 * s01)
           + 2 * (total_vehicles - m0) * (avg_AQI - m1) * (s02 * s12 - s01 * s22)
           + 2 * (total_vehicles - m0) * (total_energy_kwh - m2) * (s01 * s12 - s02 * s11)
           + 2 * (avg_AQI - m1) * (total_energy_kwh - m2) * (s01 * s02 - s00 * s12)) / det
         END AS mahalanobis_distance
  FROM seq LEFT JOIN hp ON seq.hour = hp.hh, st, dt),
sev AS (
  SELECT *, coalesce(mahalanobis_distance > {CHI2_999_DF3}, false) AS multivariate_anomaly,
         {_each('CAST({m}_anomaly AS INT) + CAST({m}_anomaly_iqr AS INT) '
                '+ CAST({m}_anomaly_ma AS INT) + CAST({m}_time_anomaly AS INT) AS {m}_severity')}
  FROM flagged),
ovr AS (
  SELECT *, CASE WHEN traffic_severity IS NOT NULL AND aqi_severity IS NOT NULL
                  AND energy_severity IS NOT NULL
             THEN greatest(traffic_severity, aqi_severity, energy_severity) END
           AS overall_severity
  FROM sev),
scored AS (
  SELECT *, CASE WHEN overall_severity = 0 THEN 'Normal' WHEN overall_severity = 1 THEN 'Low'
                 WHEN overall_severity = 2 THEN 'Medium' WHEN overall_severity = 3 THEN 'High'
                 WHEN overall_severity >= 4 THEN 'Critical' END AS severity_level
  FROM ovr)"""

_VALUES = rs(*METRICS.values())


def _flags(suffix: str) -> str:
    return ", ".join(f"{m}_{suffix}" for m in METRICS)


SEVERITY_OUT = (
    f"{_flags('anomaly')}, {_flags('anomaly_iqr')}, {_flags('anomaly_ma')}, "
    f"{_flags('time_anomaly')}, multivariate_anomaly, {r('mahalanobis_distance', 'mahalanobis_distance')}, "
    f"{_flags('severity')}, overall_severity, severity_level"
)


def _keep(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("timestamp", *METRICS.values(), *extra)


# --- ordered series --------------------------------------------------------------------------

LAGS = features.LAGS
_LAG_SQL = ", ".join(
    f"{r(f'lag({c}, {k}) OVER (ORDER BY timestamp)', name)}" for name, (c, k) in LAGS.items()
)
_MA_CELL = (
    "CASE WHEN count({0}) OVER w7 = 7 THEN avg({0}) OVER w7 END"
)
_W7 = "WINDOW w7 AS (ORDER BY timestamp ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


@query(
    "row_positions",
    f"""WITH {a.READINGS}
SELECT event_id, timestamp, row_number() OVER (ORDER BY timestamp, event_id) AS row_id
FROM readings""",
)
def row_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = a.readings(spark, d).select("event_id", "timestamp")
    return sequence.with_row_id(rows, ["timestamp", "event_id"], "readings")


@query("lag_features", f"WITH {a.HOURLY} SELECT timestamp, {_LAG_SQL} FROM hourly")
def lag_features(spark: SparkSession, d: str) -> DataFrame:
    lagged = sequence.lagged(numbered_master(spark, d), LAGS)
    return lagged.select("timestamp", *LAGS)


@query(
    "rolling_mean7",
    f"WITH {a.HOURLY} SELECT timestamp, "
    + ", ".join(r(_MA_CELL.format(c), n) for n, c in features.ROLLING.items())
    + f" FROM hourly {_W7}",
)
def rolling_mean7(spark: SparkSession, d: str) -> DataFrame:
    rolled = sequence.rolling_means(numbered_master(spark, d), features.ROLLING)
    return rolled.select("timestamp", *features.ROLLING)


@query(
    "rolling_mean_events",
    f"""WITH {a.READINGS}
SELECT event_id, {r('CASE WHEN count(x) OVER w7 = 7 THEN avg(x) OVER w7 END', 'x_ma7')},
       {r('lag(x, 24) OVER (ORDER BY timestamp, event_id)', 'x_lag24')}
FROM readings
WINDOW w7 AS (ORDER BY timestamp, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def rolling_mean_events(spark: SparkSession, d: str) -> DataFrame:
    """The windows over every single reading rather than over the hourly table."""
    rows = a.readings(spark, d).select("timestamp", "event_id", "x")
    numbered = sequence.with_row_id(rows, ["timestamp", "event_id"], "readings")
    frames = sequence.HaloFrames(numbered, 24)
    windowed = frames.rows.withColumns(
        {
            "x_ma7": sequence.full_mean("x", frames, 7),
            "x_lag24": F.lag("x", 24).over(frames.ordered()),
        }
    )
    return frames.own(windowed).select("event_id", "x_ma7", "x_lag24")


_FEATURE_SQL = f"""{a.HOURLY}, feats AS (
  SELECT *, {', '.join(f'lag({c}, {k}) OVER (ORDER BY timestamp) AS {n}'
                        for n, (c, k) in LAGS.items())},
         {', '.join(f'{_MA_CELL.format(c)} AS {n}' for n, c in features.ROLLING.items())},
         sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos,
         CAST(is_weekend AS INT) AS is_weekend_num, dayofweek(timestamp) + 1 AS weekday_num
  FROM hourly {_W7}),
model AS (
  SELECT * FROM feats WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [
      'avg_AQI', 'total_energy_kwh', 'temperature', 'wind_speed',
      *LAGS, *features.ROLLING])})"""


@query(
    "model_features",
    f"WITH {_FEATURE_SQL} SELECT {MASTER_OUT}, "
    + ", ".join(r(c, c) for c in [*LAGS, *features.ROLLING, "hour_sin", "hour_cos"])
    + ", is_weekend_num, weekday_num FROM model",
)
def model_features(spark: SparkSession, d: str) -> DataFrame:
    return features.model_frame(numbered_master(spark, d)).drop("row_id")


@query(
    "chrono_split_counts",
    f"""WITH {_FEATURE_SQL}, p AS (
  SELECT timestamp, row_number() OVER (ORDER BY timestamp) AS rn, count(*) OVER () AS n
  FROM model)
SELECT rn <= floor(0.8 * n) AS is_train, count(*) AS count, min(timestamp) AS first,
       max(timestamp) AS last FROM p GROUP BY 1""",
)
def chrono_split_counts(spark: SparkSession, d: str) -> DataFrame:
    split = features.split_frame(numbered_master(spark, d))
    return split.groupBy("is_train").agg(
        F.count(F.lit(1)).alias("count"),
        F.min("timestamp").alias("first"),
        F.max("timestamp").alias("last"),
    )


# --- detectors -------------------------------------------------------------------------------


@query("zscore_flags", f"WITH {SCORED} SELECT timestamp, {_VALUES}, {_flags('anomaly')} FROM scored")
def zscore_flags(spark: SparkSession, d: str) -> DataFrame:
    flagged = anomaly.zscore_flags(materialize(a.hourly(spark, d), "master"))
    return _keep(flagged, *[f"{m}_anomaly" for m in METRICS])


@query("iqr_flags", f"WITH {SCORED} SELECT timestamp, {_VALUES}, {_flags('anomaly_iqr')} FROM scored")
def iqr_flags(spark: SparkSession, d: str) -> DataFrame:
    flagged = anomaly.iqr_flags(materialize(a.hourly(spark, d), "master"))
    return _keep(flagged, *[f"{m}_anomaly_iqr" for m in METRICS])


@query(
    "trailing_flags", f"WITH {SCORED} SELECT timestamp, {_VALUES}, {_flags('anomaly_ma')} FROM scored"
)
def trailing_flags(spark: SparkSession, d: str) -> DataFrame:
    flagged = anomaly.trailing_flags(numbered_master(spark, d))
    return _keep(flagged, *[f"{m}_anomaly_ma" for m in METRICS])


@query(
    "hour_of_day_flags",
    f"WITH {SCORED} SELECT timestamp, {_VALUES}, {_flags('time_anomaly')} FROM scored",
)
def hour_of_day_flags(spark: SparkSession, d: str) -> DataFrame:
    flagged = anomaly.hour_of_day_flags(materialize(a.hourly(spark, d), "master"))
    return _keep(flagged, *[f"{m}_time_anomaly" for m in METRICS])


@query(
    "hour_profile_sd",
    f"WITH {a.HOURLY} SELECT hour, "
    + _each("round(avg({c}) + 1e-10, 6) + 0.0 AS {m}_mean")
    + ", "
    + _each("round(stddev_samp({c}) + 1e-10, 6) + 0.0 AS {m}_sd")
    + " FROM hourly GROUP BY hour",
)
def hour_profile_sd(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.hour_profile_sd(a.hourly(spark, d))


@query(
    "mahalanobis_flags",
    f"WITH {SCORED} SELECT timestamp, {_VALUES}, multivariate_anomaly, "
    f"{r('mahalanobis_distance', 'mahalanobis_distance')} FROM scored",
)
def mahalanobis_flags(spark: SparkSession, d: str) -> DataFrame:
    flagged = anomaly.mahalanobis_flags(materialize(a.hourly(spark, d), "master"))
    return _keep(flagged, "multivariate_anomaly", "mahalanobis_distance")


@query("severity_scored", f"WITH {SCORED} SELECT {MASTER_OUT}, row_id, {SEVERITY_OUT} FROM scored")
def severity_scored(spark: SparkSession, d: str) -> DataFrame:
    return scored_master(spark, d)


# --- marts -----------------------------------------------------------------------------------


@query(
    "severity_distribution",
    f"""WITH {SCORED} SELECT severity_level AS level, count(*) AS count FROM scored
WHERE severity_level IS NOT NULL GROUP BY 1""",
)
def severity_distribution(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.severity_distribution(scored_master(spark, d))


@query(
    "severity_summary",
    f"""WITH {SCORED} SELECT severity_level, count(*) AS count,
       {r('avg(total_vehicles)', 'avg_traffic')}, {r('avg(avg_AQI)', 'avg_aqi')},
       {r('avg(total_energy_kwh)', 'avg_energy')} FROM scored GROUP BY severity_level""",
)
def severity_summary(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.severity_summary(scored_master(spark, d))


@query(
    "severity_heatmap",
    f"""WITH {SCORED} SELECT isodow(date) - 1 AS day_index, strftime(date, '%A') AS day_of_week,
       hour, {r('avg(overall_severity)', 'avg_severity')},
       count(*) FILTER (WHERE overall_severity > 0) AS anomaly_count
FROM scored GROUP BY 1, 2, 3""",
)
def severity_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.severity_heatmap(scored_master(spark, d))


@query(
    "method_summary",
    f"WITH {SCORED} "
    + " UNION ALL ".join(
        f"""SELECT '{label}' AS metric, count(*) FILTER (WHERE {m}_anomaly) AS zscore_anomalies,
       count(*) FILTER (WHERE {m}_anomaly_iqr) AS iqr_anomalies,
       count(*) FILTER (WHERE {m}_anomaly_ma) AS moving_avg_anomalies,
       count(*) FILTER (WHERE {m}_time_anomaly) AS time_based_anomalies,
       count(*) FILTER (WHERE multivariate_anomaly) AS multivariate_anomalies FROM scored"""
        for m, label in (("traffic", "Traffic"), ("aqi", "Air Quality"), ("energy", "Energy"))
    ),
)
def method_summary(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.method_summary(scored_master(spark, d))


RECORDS_SQL = f"""SELECT timestamp, date, hour, strftime(date, '%A') AS day_of_week, {_VALUES},
       {_flags('anomaly')}, multivariate_anomaly, {_flags('severity')}, overall_severity,
       severity_level, {r('mahalanobis_distance', 'mahalanobis_distance')}
FROM scored WHERE overall_severity > 0"""


@query("anomaly_records", f"WITH {SCORED} {RECORDS_SQL}")
def anomaly_records(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.anomaly_records(scored_master(spark, d))


@query(
    "high_severity_points",
    f"""WITH {SCORED} SELECT timestamp, {rs('total_vehicles')}, overall_severity FROM scored
WHERE overall_severity >= 3""",
)
def high_severity_points(spark: SparkSession, d: str) -> DataFrame:
    points = anomaly.high_severity_points(scored_master(spark, d))
    return points.select("timestamp", "total_vehicles", "overall_severity")


@query(
    "anomaly_points_labelled",
    f"WITH {SCORED} "
    + " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, timestamp, {r(c, 'value')},
       coalesce(severity_level, 'Unscored') AS label FROM scored WHERE {m}_anomaly"""
        for m, c in METRICS.items()
    ),
)
def anomaly_points_labelled(spark: SparkSession, d: str) -> DataFrame:
    """The z-score points of all three metrics: one pass, one row per (row, flagged metric)."""
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(c).alias("value"),
                F.col(f"{m}_anomaly").alias("_flag"),
            )
            for m, c in METRICS.items()
        ]
    )
    scored = scored_master(spark, d)
    return (
        scored.select("timestamp", "severity_level", F.inline(cells))
        .where("_flag")
        .select(
            "metric",
            "timestamp",
            "value",
            F.coalesce("severity_level", F.lit("Unscored")).alias("label"),
        )
    )
