"""Cleaning, rollups, profiles, joins and mart queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorspark.functions import calendar, clean, scores
from sensorspark.operators import marts, profile, rollup, stats
from sensorspark.plans import adapters as a
from sensorspark.plans.registry import query, r, rs
from sensorspark.session import materialize
from sensorspark.sources import tables

CORR_COLUMNS = [
    "total_vehicles",
    "avg_speed",
    "avg_PM25",
    "avg_PM10",
    "avg_NO2",
    "avg_AQI",
    "total_energy_kwh",
    "avg_renewable_percent",
    "temperature",
    "humidity",
    "wind_speed",
]
KEY_COLUMNS = [
    "total_vehicles",
    "avg_AQI",
    "total_energy_kwh",
    "temperature",
    "humidity",
    "wind_speed",
    "precipitation_mm",
]
KEY_PAIRS = [
    ("total_vehicles", "total_energy_kwh"),
    ("total_vehicles", "avg_AQI"),
    ("temperature", "total_energy_kwh"),
]
METRICS = ["total_vehicles", "avg_AQI", "total_energy_kwh"]
SUMMARY_COLUMNS = [
    "total_vehicles",
    "avg_speed",
    "avg_AQI",
    "total_energy_kwh",
    "temperature",
]
POLLUTANTS = ["PM25", "PM10", "NO2", "O3"]

TIME_OF_DAY = (
    "CASE WHEN hour({0}) >= 6 AND hour({0}) < 12 THEN 'Morning' "
    "WHEN hour({0}) >= 12 AND hour({0}) < 18 THEN 'Afternoon' "
    "WHEN hour({0}) >= 18 AND hour({0}) < 22 THEN 'Evening' ELSE 'Night' END"
)
SEASON = (
    "CASE WHEN month({0}) IN (12, 1, 2) THEN 'Winter' WHEN month({0}) IN (3, 4, 5) THEN 'Spring' "
    "WHEN month({0}) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END"
)


# --- cleaning and calendar -------------------------------------------------------------------


@query(
    "clean_traffic",
    f"""WITH {a.READINGS}, raw AS (
  SELECT timestamp, event_id, entity AS zone, x - 5 AS v, k * CAST(1.25 AS DOUBLE) AS s,
         {a.LEVEL} AS congestion_level FROM readings)
SELECT timestamp, event_id, zone, {r('v', 'vehicle_count')}, {r('s', 'average_speed')},
       congestion_level, {a.calendar_sql('timestamp')},
       {TIME_OF_DAY.format('timestamp')} AS time_of_day
FROM raw WHERE v >= 0 AND s BETWEEN 0 AND 120""",
)
def clean_traffic(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_traffic(a.traffic_raw(spark, d))


@query(
    "clean_air_quality",
    f"""WITH {a.AIR}, raw AS (
  SELECT timestamp, station_id, PM25 - 1 AS PM25, PM10, NO2 - 3 AS NO2, O3,
         temperature * 3 AS temperature, humidity + 10 AS humidity, AQI, AQI_category FROM air)
SELECT timestamp, station_id, {rs('PM25', 'PM10')},
       {r('CASE WHEN NO2 >= 0 THEN NO2 END', 'NO2')}, {r('CASE WHEN O3 >= 0 THEN O3 END', 'O3')},
       {r('CASE WHEN temperature BETWEEN -50 AND 60 THEN temperature END', 'temperature')},
       {r('CASE WHEN humidity BETWEEN 0 AND 100 THEN humidity END', 'humidity')},
       {rs('AQI')}, AQI_category, {a.calendar_sql('timestamp')}
FROM raw WHERE PM25 >= 0 AND PM10 >= 0 AND AQI >= 0""",
)
def clean_air_quality(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_air_quality(a.air_raw(spark, d))


@query(
    "clean_energy",
    f"""WITH {a.ENERGY_DAILY}, raw AS (
  SELECT timestamp, building_type, energy_consumption_kwh - 3 AS kwh, peak_demand_kw - 10 AS kw,
         renewable_percent * 12 AS ren, cost_usd FROM energy_daily)
SELECT timestamp, building_type, {r('kwh', 'energy_consumption_kwh')},
       {r('CASE WHEN kw >= 0 THEN kw END', 'peak_demand_kw')},
       {r('CASE WHEN ren BETWEEN 0 AND 100 THEN ren END', 'renewable_percent')},
       {r('cost_usd', 'cost_usd')}, {a.calendar_sql('timestamp')},
       {SEASON.format('timestamp')} AS season
FROM raw WHERE kwh >= 0""",
)
def clean_energy(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_energy(a.energy_raw(spark, d))


@query(
    "clean_weather",
    f"""WITH {a.READINGS}
SELECT timestamp, {r('k - 60', 'temperature')}, {r('k + 5', 'humidity')},
       {r('CASE WHEN x * 1.5 BETWEEN 0 AND 150 THEN x * CAST(1.5 AS DOUBLE) END', 'wind_speed')},
       {r('CASE WHEN x - 10 < 0 THEN 0 ELSE x - 10 END', 'precipitation_mm')},
       {r('k / 10 + 1000', 'pressure_hpa')}, {a.LEVEL} AS condition,
       hour(timestamp) AS hour, day(timestamp) AS day, month(timestamp) AS month,
       CAST(timestamp AS DATE) AS date
FROM readings WHERE k - 60 BETWEEN -50 AND 60 AND k + 5 BETWEEN 0 AND 100""",
)
def clean_weather(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_weather(a.weather_raw(spark, d))


@query(
    "calendar_features",
    f"""WITH {a.READINGS}
SELECT event_id, timestamp, {a.calendar_sql('timestamp')},
       dayofweek(timestamp) + 1 AS weekday_num, strftime(timestamp, '%A') AS weekday_name,
       isodow(timestamp) - 1 AS monday_first,
       CAST(dayofweek(timestamp) IN (0, 6) AS INT) AS is_weekend_num,
       {TIME_OF_DAY.format('timestamp')} AS time_of_day, {SEASON.format('timestamp')} AS season,
       CAST(date_trunc('month', timestamp) AS TIMESTAMP) AS month_start,
       {r('sin(2 * pi() * hour(timestamp) / 24)', 'hour_sin')},
       {r('cos(2 * pi() * hour(timestamp) / 24)', 'hour_cos')}
FROM readings""",
)
def calendar_features(spark: SparkSession, d: str) -> DataFrame:
    rows = a.readings(spark, d).select("event_id", "timestamp")
    ts = F.col("timestamp")
    featured = calendar.add_calendar(rows)
    return featured.withColumns(
        {
            "weekday_num": calendar.weekday_number(ts),
            "weekday_name": calendar.weekday_name(ts),
            "monday_first": calendar.monday_first(ts),
            "is_weekend_num": F.col("is_weekend").cast("int"),
            "time_of_day": calendar.time_of_day(F.col("hour")),
            "season": calendar.season(F.col("month")),
            "month_start": calendar.month_floor(ts),
            "hour_sin": calendar.hour_sin(F.col("hour")),
            "hour_cos": calendar.hour_cos(F.col("hour")),
        }
    )


@query(
    "parsed_timestamps",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN NULL
       ELSE CAST(o_orderdate AS TIMESTAMP) END AS timestamp,
       CASE o_orderpriority WHEN '5-LOW' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date
FROM orders""",
)
def parsed_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Text stamps: full, date-only and unreadable ones."""
    orders = a.table(spark, d, "orders")
    priority, day = F.col("o_orderpriority"), F.col("o_orderdate").cast("timestamp")
    text = (
        F.when(priority == "5-LOW", "not a date")
        .when(priority == "1-URGENT", F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
    )
    parsed = calendar.parse_timestamp(text)
    return orders.select(
        "o_orderkey", parsed.alias("timestamp"), F.to_date(parsed).alias("date")
    )


@query(
    "bin_aqi",
    f"""WITH {a.READINGS}
SELECT event_id, {r('x', 'aqi')}, {a.AQI_CATEGORY.format('x')} AS category FROM readings""",
)
def bin_aqi(spark: SparkSession, d: str) -> DataFrame:
    rows = a.readings(spark, d)
    return rows.select(
        "event_id", F.col("x").alias("aqi"), scores.aqi_category(F.col("x")).alias("category")
    )


@query(
    "traffic_light",
    f"""WITH {a.AIR}
SELECT station_id, round(avg(AQI), 1) AS mean_aqi,
       CASE WHEN round(avg(AQI), 1) < 50 THEN 'green' WHEN round(avg(AQI), 1) < 100 THEN 'yellow'
            ELSE 'red' END AS color
FROM air GROUP BY station_id""",
)
def traffic_light(spark: SparkSession, d: str) -> DataFrame:
    means = a.air(spark, d).groupBy("station_id").agg(F.round(F.avg("AQI"), 1).alias("mean_aqi"))
    return means.withColumn("color", scores.traffic_light(F.col("mean_aqi")))


@query(
    "simple_aqi_cost",
    f"""WITH {a.READINGS}
SELECT event_id, {r('greatest(x / 2 * 2, x * 0.75 * 1.5, k * 1.8)', 'simple_aqi')},
       {r('x * 0.12', 'cost_usd')}
FROM readings""",
)
def simple_aqi_cost(spark: SparkSession, d: str) -> DataFrame:
    rows = a.readings(spark, d)
    x, k = F.col("x"), F.col("k")
    return rows.select(
        "event_id",
        scores.simple_aqi(x / 2, x * 0.75, k).alias("simple_aqi"),
        scores.energy_cost(x).alias("cost_usd"),
    )


# --- rollups and the wide table --------------------------------------------------------------

_TRAFFIC_OUT = f"{rs('total_vehicles', 'avg_speed')}, high_congestion_zones"
_AIR_OUT = rs(
    "avg_PM25", "avg_PM10", "avg_NO2", "avg_O3", "avg_AQI", "avg_temperature", "avg_humidity"
)
_ENERGY_OUT = rs("total_energy_kwh", "avg_peak_demand", "avg_renewable_percent", "total_cost")
_WEATHER_OUT = rs("temperature", "humidity", "wind_speed", "precipitation_mm", "pressure_hpa")
MASTER_OUT = (
    f"timestamp, hour, date, weekday, is_weekend, {_TRAFFIC_OUT}, {_AIR_OUT}, {_ENERGY_OUT}, "
    f"{_WEATHER_OUT}, condition"
)


@query(
    "hourly_rollup",
    f"WITH {a.HOURLY} SELECT ts AS timestamp, {a.keys_sql('ts')}, {_TRAFFIC_OUT} FROM traffic_h",
)
def hourly_rollup(spark: SparkSession, d: str) -> DataFrame:
    return a.hourly_parts(spark, d)["traffic"]


@query(
    "air_rollup",
    f"WITH {a.HOURLY} SELECT ts AS timestamp, {a.keys_sql('ts')}, {_AIR_OUT} FROM air_h",
)
def air_rollup(spark: SparkSession, d: str) -> DataFrame:
    return a.hourly_parts(spark, d)["air"]


@query(
    "energy_rollup",
    f"""WITH {a.ENERGY_DAILY}
SELECT timestamp, {a.keys_sql('timestamp')},
       {r('coalesce(sum(energy_consumption_kwh), 0)', 'total_energy_kwh')},
       {r('avg(peak_demand_kw)', 'avg_peak_demand')},
       {r('avg(renewable_percent)', 'avg_renewable_percent')},
       {r('coalesce(sum(cost_usd), 0)', 'total_cost')}
FROM energy_daily GROUP BY timestamp""",
)
def energy_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollup.energy_hourly(a.energy_daily(spark, d))


@query("master_join", f"WITH {a.HOURLY} SELECT {MASTER_OUT} FROM hourly")
def master_join(spark: SparkSession, d: str) -> DataFrame:
    return a.joined_hourly(spark, d)


@query("mixed_master", f"WITH {a.HOURLY} SELECT {MASTER_OUT} FROM hourly")
def mixed_master(spark: SparkSession, d: str) -> DataFrame:
    """The same table from one mixed feed."""
    return a.hourly(spark, d)


@query(
    "daily_master",
    f"""WITH {a.ENERGY_DAILY}, {a.AIR_DAILY}, e AS (
  SELECT timestamp, sum(energy_consumption_kwh) AS total_energy_kwh, sum(cost_usd) AS total_cost,
         avg(renewable_percent) AS avg_renewable_percent
  FROM energy_daily GROUP BY timestamp), q AS (
  SELECT timestamp, avg(AQI) AS avg_AQI, avg(PM25) AS avg_PM25 FROM air_daily GROUP BY timestamp)
SELECT e.timestamp, {rs('total_energy_kwh', 'total_cost', 'avg_renewable_percent', 'avg_AQI',
                        'avg_PM25')}
FROM e LEFT JOIN q ON e.timestamp = q.timestamp""",
)
def daily_master(spark: SparkSession, d: str) -> DataFrame:
    energy = rollup.energy_hourly(a.energy_daily(spark, d)).select(
        "timestamp", "total_energy_kwh", "total_cost", "avg_renewable_percent"
    )
    air = (
        a.air_daily(spark, d)
        .groupBy("timestamp")
        .agg(F.avg("AQI").alias("avg_AQI"), F.avg("PM25").alias("avg_PM25"))
    )
    return energy.join(air, "timestamp", "left")


@query(
    "monthly_cost",
    f"""WITH {a.ENERGY_DAILY}
SELECT CAST(date_trunc('month', timestamp) AS TIMESTAMP) AS month,
       {r('coalesce(sum(cost_usd), 0)', 'total_cost')}
FROM energy_daily GROUP BY 1""",
)
def monthly_cost(spark: SparkSession, d: str) -> DataFrame:
    costs = a.energy_daily(spark, d).withColumnRenamed("cost_usd", "total_cost")
    return rollup.monthly_cost(costs)


@query(
    "daily_patterns",
    f"""WITH {a.HOURLY}
SELECT date, {r('coalesce(sum(total_vehicles), 0)', 'total_traffic')},
       {r('avg(avg_AQI)', 'avg_aqi')}, {r('coalesce(sum(total_energy_kwh), 0)', 'total_energy')},
       {r('max(total_vehicles)', 'max_traffic')},
       arg_max(hour, (total_vehicles, -epoch_us(timestamp))) AS peak_hour,
       bool_or(is_weekend) AS is_weekend
FROM hourly GROUP BY date""",
)
def daily_patterns(spark: SparkSession, d: str) -> DataFrame:
    return rollup.daily_patterns(a.hourly(spark, d))


@query(
    "weekday_patterns",
    f"""WITH {a.HOURLY}, m AS (
  SELECT weekday, avg(total_vehicles) AS avg_traffic, avg(avg_AQI) AS avg_aqi,
         avg(total_energy_kwh) AS avg_energy, stddev_samp(total_vehicles) AS traffic_variability,
         max(total_vehicles) AS top FROM hourly GROUP BY weekday), c AS (
  SELECT h.weekday, h.hour, count(*) AS n FROM hourly h JOIN m ON h.weekday = m.weekday
  WHERE h.total_vehicles = m.top GROUP BY 1, 2), p AS (
  SELECT weekday, arg_max(hour, (n, -hour)) AS peak_hour FROM c GROUP BY weekday)
SELECT m.weekday, {rs('avg_traffic', 'avg_aqi', 'avg_energy', 'traffic_variability')}, peak_hour
FROM m JOIN p ON m.weekday = p.weekday""",
)
def weekday_patterns(spark: SparkSession, d: str) -> DataFrame:
    return rollup.weekday_patterns(materialize(a.hourly(spark, d), "master"))


# --- overview, summary, missing data ---------------------------------------------------------


@query(
    "dataset_overview",
    f"""WITH {a.HOURLY}
SELECT count(*) AS records, 25 AS variables, min(date) AS first_date, max(date) AS last_date,
       {r('avg(total_vehicles)', 'mean_hourly_vehicles')}, {r('avg(avg_speed)', 'mean_speed')},
       {r('avg(avg_AQI)', 'mean_aqi')}, {r('avg(avg_PM25)', 'mean_pm25')},
       {r('avg(avg_PM10)', 'mean_pm10')}, {r('avg(total_energy_kwh)', 'mean_hourly_energy')},
       {r('avg(avg_renewable_percent)', 'mean_renewable')},
       {r('avg(total_cost)', 'mean_hourly_cost')}, {r('avg(temperature)', 'mean_temperature')},
       {r('coalesce(sum(total_energy_kwh), 0) / 1000', 'total_energy_mwh')}
FROM hourly""",
)
def dataset_overview(spark: SparkSession, d: str) -> DataFrame:
    return profile.dataset_overview(a.hourly(spark, d))


@query(
    "six_number_summary",
    f"WITH {a.HOURLY} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, {r(f'min({c})', 'min')}, {r(f'avg({c})', 'mean')},
       {r(f'max({c})', 'max')}, count(*) FILTER (WHERE {c} IS NULL) AS na_count,
       {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)', 'q1')},
       {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 'median')},
       {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)', 'q3')} FROM hourly"""
        for c in SUMMARY_COLUMNS
    ),
)
def six_number_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.six_number_summary(materialize(a.hourly(spark, d), "master"), SUMMARY_COLUMNS)


@query(
    "missing_profile",
    f"WITH {a.HOURLY}, m AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
        "count(*) AS n FROM hourly"
        for c in [
            "avg_PM25", "avg_PM10", "avg_NO2", "avg_O3", "avg_AQI", "avg_temperature",
            "avg_humidity", "total_energy_kwh", "avg_peak_demand", "avg_renewable_percent",
            "total_cost", "temperature", "humidity", "wind_speed", "precipitation_mm",
            "pressure_hpa", "condition", "timestamp", "hour", "date", "weekday", "is_weekend",
            "total_vehicles", "avg_speed", "high_congestion_zones",
        ]
    )
    + """) SELECT variable, missing_count,
       round(round(missing_count / n * 100, 2), 6) AS missing_percent
FROM m WHERE missing_count > 0""",
)
def missing_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.missing_profile(a.hourly(spark, d))


# --- profiles --------------------------------------------------------------------------------

_THREE = (
    f"{r('avg(total_vehicles)', 'avg_vehicles')}, {r('avg(avg_AQI)', 'avg_aqi')}, "
    f"{r('avg(total_energy_kwh)', 'avg_energy')}"
)


def _three_means_sql(key: str) -> str:
    return f"WITH {a.HOURLY} SELECT {key}, {_THREE} FROM hourly GROUP BY {key}"


@query("hour_profile", _three_means_sql("hour"))
def hour_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.mean_profile(a.hourly(spark, d), ["hour"], profile.THREE_MEANS)


@query("weekday_profile", _three_means_sql("weekday"))
def weekday_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.mean_profile(a.hourly(spark, d), ["weekday"], profile.THREE_MEANS)


@query("weekend_profile", _three_means_sql("is_weekend"))
def weekend_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.mean_profile(a.hourly(spark, d), ["is_weekend"], profile.THREE_MEANS)


@query(
    "hour_volume_speed",
    f"""WITH {a.HOURLY}
SELECT hour, {r('avg(total_vehicles)', 'avg_vehicles')}, {r('avg(avg_speed)', 'avg_speed')}
FROM hourly GROUP BY hour""",
)
def hour_volume_speed(spark: SparkSession, d: str) -> DataFrame:
    means = {"avg_vehicles": "total_vehicles", "avg_speed": "avg_speed"}
    return profile.mean_profile(a.hourly(spark, d), ["hour"], means)


@query(
    "zone_stats",
    f"""WITH {a.TRAFFIC}
SELECT zone, {r('avg(vehicle_count)', 'avg_vehicles')}, {r('avg(average_speed)', 'avg_speed')},
       {r("avg(CASE WHEN congestion_level = 'High' THEN 1.0 ELSE 0.0 END) * 100",
          'congestion_rate')}
FROM traffic GROUP BY zone""",
)
def zone_stats(spark: SparkSession, d: str) -> DataFrame:
    return profile.zone_stats(a.traffic(spark, d))


@query(
    "station_stats",
    f"""WITH {a.AIR_DAILY}
SELECT station_id, {r('avg(AQI)', 'avg_aqi')}, {r('avg(PM25)', 'avg_pm25')},
       {r('count(*) FILTER (WHERE AQI > 100) / count(*) * 100', 'pct_unhealthy')}
FROM air_daily GROUP BY station_id""",
)
def station_stats(spark: SparkSession, d: str) -> DataFrame:
    return profile.station_stats(a.air_daily(spark, d))


@query(
    "station_median",
    f"""WITH {a.AIR_DAILY}
SELECT station_id, {r('avg(AQI)', 'mean_value')},
       {r('quantile_cont(CAST(AQI AS DOUBLE), 0.5)', 'median_value')}
FROM air_daily GROUP BY station_id""",
)
def station_median(spark: SparkSession, d: str) -> DataFrame:
    return profile.mean_median(a.air_daily(spark, d), "station_id", "AQI")


@query(
    "building_stats",
    f"""WITH {a.ENERGY_DAILY}
SELECT building_type, {r('avg(energy_consumption_kwh)', 'avg_consumption')},
       {r('coalesce(sum(energy_consumption_kwh), 0)', 'total_consumption')},
       {r('avg(renewable_percent)', 'avg_renewable')},
       {r('coalesce(sum(cost_usd), 0)', 'total_cost')}
FROM energy_daily GROUP BY building_type""",
)
def building_stats(spark: SparkSession, d: str) -> DataFrame:
    return profile.building_stats(a.energy_daily(spark, d))


@query(
    "building_total_mwh",
    f"""WITH {a.ENERGY_DAILY}
SELECT building_type, {r('sum(energy_consumption_kwh) / 1000', 'total')}
FROM energy_daily GROUP BY building_type""",
)
def building_total_mwh(spark: SparkSession, d: str) -> DataFrame:
    return profile.total_by(a.energy_daily(spark, d), "building_type", "energy_consumption_kwh")


@query(
    "building_renewable",
    f"""WITH {a.ENERGY_DAILY}
SELECT building_type, {r('avg(renewable_percent)', 'avg_renewable')}
FROM energy_daily GROUP BY building_type""",
)
def building_renewable(spark: SparkSession, d: str) -> DataFrame:
    means = {"avg_renewable": "renewable_percent"}
    return profile.mean_profile(a.energy_daily(spark, d), ["building_type"], means).orderBy(
        "avg_renewable"
    )


def _two_key_sql(cte: str, source: str, keys: str, value: str, name: str) -> str:
    return f"WITH {cte} SELECT {keys}, {r(f'avg({value})', name)} FROM {source} GROUP BY {keys}"


@query("zone_hour", _two_key_sql(a.TRAFFIC, "traffic", "zone, hour", "vehicle_count", "avg_vehicles"))
def zone_hour(spark: SparkSession, d: str) -> DataFrame:
    means = {"avg_vehicles": "vehicle_count"}
    return profile.mean_profile(a.traffic(spark, d), ["zone", "hour"], means)


@query(
    "hour_weekend",
    _two_key_sql(a.HOURLY, "hourly", "hour, is_weekend", "total_vehicles", "avg_vehicles"),
)
def hour_weekend(spark: SparkSession, d: str) -> DataFrame:
    means = {"avg_vehicles": "total_vehicles"}
    return profile.mean_profile(a.hourly(spark, d), ["hour", "is_weekend"], means)


@query(
    "hour_weekday_heatmap",
    _two_key_sql(a.HOURLY, "hourly", "hour, weekday", "total_vehicles", "avg_vehicles"),
)
def hour_weekday_heatmap(spark: SparkSession, d: str) -> DataFrame:
    means = {"avg_vehicles": "total_vehicles"}
    return profile.mean_profile(a.hourly(spark, d), ["hour", "weekday"], means)


@query(
    "building_hour",
    f"""WITH {a.READINGS}
SELECT entity AS building_type, hour(timestamp) AS hour, {r('avg(x)', 'avg_energy')}
FROM readings GROUP BY 1, 2""",
)
def building_hour(spark: SparkSession, d: str) -> DataFrame:
    energy = calendar.add_calendar(a.energy_of(a.readings(spark, d)))
    means = {"avg_energy": "energy_consumption_kwh"}
    return profile.mean_profile(energy, ["building_type", "hour"], means)


@query(
    "pollutants_long",
    f"WITH {a.AIR} "
    + " UNION ALL ".join(
        f"SELECT hour, '{p}' AS pollutant, {r(f'avg({p})', 'value')} FROM air GROUP BY hour"
        for p in POLLUTANTS
    ),
)
def pollutants_long(spark: SparkSession, d: str) -> DataFrame:
    return profile.pollutant_profile(a.air(spark, d), POLLUTANTS)


_PEAK_SQL = f"""WITH {a.HOURLY}, p AS (
  SELECT hour, avg(total_vehicles) AS v, avg(avg_AQI) AS q, avg(total_energy_kwh) AS e
  FROM hourly GROUP BY hour), l AS (
  SELECT 'traffic' AS measure, hour, v AS value FROM p
  UNION ALL SELECT 'aqi', hour, q FROM p UNION ALL SELECT 'energy', hour, e FROM p)
SELECT measure, hour, {r('value', 'value')} FROM (
  SELECT *, rank() OVER (PARTITION BY measure ORDER BY value DESC NULLS LAST) AS rk FROM l)
WHERE rk = 1"""


@query("peak_hours", _PEAK_SQL)
def peak_hours(spark: SparkSession, d: str) -> DataFrame:
    means = {"v": "total_vehicles", "q": "avg_AQI", "e": "total_energy_kwh"}
    by_hour = profile.mean_profile(a.hourly(spark, d), ["hour"], means)
    return profile.peak_groups(by_hour, "hour", {"traffic": "v", "aqi": "q", "energy": "e"})


@query(
    "worst_entities",
    f"""WITH {a.TRAFFIC}, {a.AIR_DAILY}, l AS (
  SELECT 'congestion_rate' AS measure, zone AS entity,
         avg(CASE WHEN congestion_level = 'High' THEN 1.0 ELSE 0.0 END) * 100 AS value
  FROM traffic GROUP BY zone
  UNION ALL SELECT 'avg_aqi', station_id, avg(AQI) FROM air_daily GROUP BY station_id)
SELECT measure, entity, {r('value', 'value')} FROM (
  SELECT *, rank() OVER (PARTITION BY measure ORDER BY value DESC NULLS LAST) AS rk FROM l)
WHERE rk = 1""",
)
def worst_entities(spark: SparkSession, d: str) -> DataFrame:
    zones = profile.zone_stats(a.traffic(spark, d)).withColumnRenamed("zone", "entity")
    stations = profile.station_stats(a.air_daily(spark, d)).withColumnRenamed(
        "station_id", "entity"
    )
    worst_zone = profile.peak_groups(zones, "entity", {"congestion_rate": "congestion_rate"})
    return worst_zone.unionByName(profile.peak_groups(stations, "entity", {"avg_aqi": "avg_aqi"}))


# --- correlation, covariance, outliers, histogram, trend -------------------------------------


def _complete(columns: list[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


def _correlation_sql(columns: list[str]) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{x}' AS var1, '{y}' AS var2, "
        + (f"CASE WHEN stddev_samp({x}) > 0 THEN 1.0 END" if x == y else f"corr({x}, {y})")
        + " AS value FROM c"
        for x in columns
        for y in columns
    )
    return (
        f"WITH {a.HOURLY}, c AS (SELECT * FROM hourly WHERE {_complete(columns)}), "
        f"m AS ({cells}) "
    )


@query(
    "correlation_matrix_long",
    _correlation_sql(CORR_COLUMNS) + f"SELECT var1, var2, {r('value', 'value')} FROM m",
)
def correlation_matrix_long(spark: SparkSession, d: str) -> DataFrame:
    return stats.correlation_matrix(a.hourly(spark, d), CORR_COLUMNS)


@query(
    "top_correlations",
    _correlation_sql(CORR_COLUMNS)
    + f"""SELECT var1, var2, {r('value', 'value')} FROM (
  SELECT * FROM m WHERE var1 < var2 ORDER BY round(abs(value), 9) DESC, var1, var2 LIMIT 10)""",
)
def top_correlations(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_correlations(stats.correlation_matrix(a.hourly(spark, d), CORR_COLUMNS))


@query(
    "key_correlations",
    _correlation_sql(KEY_COLUMNS)
    + f"SELECT var1, var2, {r('value', 'value')} FROM m WHERE "
    + " OR ".join(f"(var1 = '{x}' AND var2 = '{y}')" for x, y in KEY_PAIRS),
)
def key_correlations(spark: SparkSession, d: str) -> DataFrame:
    matrix = stats.correlation_matrix(a.hourly(spark, d), KEY_COLUMNS)
    return stats.correlation_of(matrix, KEY_PAIRS)


@query(
    "covariance_matrix",
    f"WITH {a.HOURLY}, c AS (SELECT * FROM hourly WHERE {_complete(METRICS)}) "
    + " UNION ALL ".join(
        f"SELECT '{x}' AS var1, '{y}' AS var2, {r(f'covar_samp({x}, {y})', 'value')} FROM c"
        for x in METRICS
        for y in METRICS
    ),
)
def covariance_matrix(spark: SparkSession, d: str) -> DataFrame:
    return stats.covariance_matrix(a.hourly(spark, d), METRICS)


def _fence_sql(c: str) -> str:
    return (
        f"count(*) FILTER (WHERE {c} < {c}_q1 - 1.5 * ({c}_q3 - {c}_q1) "
        f"OR {c} > {c}_q3 + 1.5 * ({c}_q3 - {c}_q1)) AS {c}_outliers"
    )


_OUTLIER_COLUMNS = [*METRICS, "temperature"]


@query(
    "iqr_outlier_counts",
    f"WITH {a.HOURLY}, q AS (SELECT "
    + ", ".join(
        f"quantile_cont(CAST({c} AS DOUBLE), {p}) AS {c}_{n}"
        for c in _OUTLIER_COLUMNS
        for n, p in (("q1", 0.25), ("q3", 0.75))
    )
    + " FROM hourly) SELECT "
    + ", ".join(_fence_sql(c) for c in _OUTLIER_COLUMNS)
    + " FROM hourly, q",
)
def iqr_outlier_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.iqr_outlier_counts(materialize(a.hourly(spark, d), "master"), _OUTLIER_COLUMNS)


@query(
    "aqi_histogram",
    f"""WITH {a.AIR}, s AS (SELECT min(AQI) AS lo, max(AQI) AS hi FROM air)
SELECT CAST(least(floor((AQI - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, AQI_category,
       count(*) AS count
FROM air, s WHERE AQI IS NOT NULL GROUP BY 1, 2""",
)
def aqi_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.histogram(a.air(spark, d), "AQI", "AQI_category")


@query(
    "lm_trend_by_level",
    f"""WITH {a.TRAFFIC}
SELECT congestion_level, count(*) FILTER (WHERE average_speed IS NOT NULL) AS n,
       {r('regr_slope(average_speed, vehicle_count)', 'slope')},
       {r('regr_intercept(average_speed, vehicle_count)', 'intercept')},
       {r('regr_r2(average_speed, vehicle_count)', 'r2')}
FROM traffic GROUP BY congestion_level""",
)
def lm_trend_by_level(spark: SparkSession, d: str) -> DataFrame:
    traffic = a.traffic(spark, d)
    return profile.linear_trend(traffic, "average_speed", "vehicle_count", ["congestion_level"])


@query(
    "lm_trend_overall",
    f"""WITH {a.HOURLY}
SELECT count(*) FILTER (WHERE avg_AQI IS NOT NULL AND total_vehicles IS NOT NULL) AS n,
       {r('regr_slope(avg_AQI, total_vehicles)', 'slope')},
       {r('regr_intercept(avg_AQI, total_vehicles)', 'intercept')},
       {r('regr_r2(avg_AQI, total_vehicles)', 'r2')}
FROM hourly""",
)
def lm_trend_overall(spark: SparkSession, d: str) -> DataFrame:
    return profile.linear_trend(a.hourly(spark, d), "avg_AQI", "total_vehicles")


# --- filtered marts, choices, previews, samples, gaps ----------------------------------------

_FROM, _TO = "2024-01-05", "2024-01-20"
_RANGE_SQL = (
    f"timestamp >= TIMESTAMP '{_FROM}' AND timestamp < TIMESTAMP '{_TO}' + INTERVAL 1 DAY"
)


@query(
    "filtered_hourly",
    f"""WITH {a.TRAFFIC}
SELECT hour, {r('avg(vehicle_count)', 'avg_vehicles')}
FROM traffic WHERE {_RANGE_SQL} AND zone = 'view' GROUP BY hour""",
)
def filtered_hourly(spark: SparkSession, d: str) -> DataFrame:
    return marts.traffic_by_hour(a.traffic(spark, d), _FROM, _TO, zone="view")


@query(
    "filtered_hourly_energy",
    f"""WITH {a.READINGS}
SELECT hour(timestamp) AS hour, {r('avg(x)', 'avg_energy')}
FROM readings WHERE {_RANGE_SQL} AND entity = 'purchase' GROUP BY 1""",
)
def filtered_hourly_energy(spark: SparkSession, d: str) -> DataFrame:
    energy = a.energy_of(a.readings(spark, d))
    return marts.energy_by_hour(energy, _FROM, _TO, building="purchase")


@query(
    "filtered_kpis",
    f"""WITH {a.AIR}
SELECT {r('avg(AQI)', 'mean_aqi')}, {r('avg(PM25)', 'mean_pm25')}, {r('avg(PM10)', 'mean_pm10')},
       {r('avg(NO2)', 'mean_no2')},
       CASE WHEN round(avg(AQI), 1) < 50 THEN 'green' WHEN round(avg(AQI), 1) < 100 THEN 'yellow'
            WHEN avg(AQI) IS NOT NULL THEN 'red' END AS color
FROM air WHERE {_RANGE_SQL} AND station_id = 'click'""",
)
def filtered_kpis(spark: SparkSession, d: str) -> DataFrame:
    return marts.air_kpis(a.air(spark, d), _FROM, _TO, station="click")


@query(
    "filtered_energy_kpis",
    f"""WITH {a.ENERGY_DAILY}
SELECT {r('coalesce(sum(energy_consumption_kwh), 0) / 1000', 'total_mwh')},
       {r('avg(renewable_percent)', 'mean_renewable')},
       {r('coalesce(sum(cost_usd), 0)', 'total_cost')}
FROM energy_daily
WHERE timestamp >= TIMESTAMP '1996-01-01' AND timestamp < TIMESTAMP '1998-07-01'""",
)
def filtered_energy_kpis(spark: SparkSession, d: str) -> DataFrame:
    return marts.energy_kpis(a.energy_daily(spark, d), "1996-01-01", "1998-06-30", building="All")


@query(
    "filtered_pollutants",
    f"""WITH {a.AIR}
SELECT hour, {', '.join(r(f'avg({p})', p) for p in POLLUTANTS)}
FROM air WHERE {_RANGE_SQL} GROUP BY hour""",
)
def filtered_pollutants(spark: SparkSession, d: str) -> DataFrame:
    return marts.pollutants_by_hour(a.air(spark, d), _FROM, _TO)


@query(
    "filter_choices",
    f"""WITH {a.TRAFFIC}
SELECT choice, lo AS first, hi AS last FROM (SELECT DISTINCT zone AS choice FROM traffic),
  (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM traffic)""",
)
def filter_choices(spark: SparkSession, d: str) -> DataFrame:
    return profile.filter_choices(a.traffic(spark, d), "zone")


@query(
    "quick_statistics",
    f"""WITH {a.HOURLY}, p AS (
  SELECT hour, avg(total_vehicles) AS v, avg(avg_AQI) AS q, avg(total_energy_kwh) AS e
  FROM hourly GROUP BY hour), b AS (
  SELECT strftime(min(date), '%Y-%m-%d') || ' to ' || strftime(max(date), '%Y-%m-%d') AS span,
         round(avg(temperature), 1) AS t FROM hourly)
SELECT 1 AS position, 'Date Range' AS metric, span AS value FROM b
UNION ALL SELECT 2, 'Peak Traffic Hour', string_agg(CAST(hour AS VARCHAR), ', ' ORDER BY hour)
  || ':00' FROM p WHERE v = (SELECT max(v) FROM p)
UNION ALL SELECT 3, 'Worst AQI Hour', string_agg(CAST(hour AS VARCHAR), ', ' ORDER BY hour)
  || ':00' FROM p WHERE q = (SELECT max(q) FROM p)
UNION ALL SELECT 4, 'Peak Energy Hour', string_agg(CAST(hour AS VARCHAR), ', ' ORDER BY hour)
  || ':00' FROM p WHERE e = (SELECT max(e) FROM p)
UNION ALL SELECT 5, 'Avg Temperature', CAST(t AS VARCHAR) || ' C' FROM b""",
)
def quick_statistics(spark: SparkSession, d: str) -> DataFrame:
    return marts.quick_statistics(materialize(a.hourly(spark, d), "master"))


@query(
    "preview_top1000",
    f"""WITH {a.TRAFFIC}
SELECT timestamp, event_id, zone, {rs('vehicle_count', 'average_speed')}, congestion_level
FROM traffic ORDER BY timestamp, event_id LIMIT 1000""",
)
def preview_top1000(spark: SparkSession, d: str) -> DataFrame:
    rows = a.traffic_of(a.readings(spark, d))
    return tables.preview(rows, [F.col("timestamp"), F.col("event_id")])


@query(
    "series_first_n",
    f"""WITH {a.AIR_DAILY}
SELECT timestamp, {rs('mean_aqi')} FROM (
  SELECT timestamp, avg(AQI) AS mean_aqi FROM air_daily GROUP BY timestamp
  ORDER BY timestamp LIMIT 2000)""",
)
def series_first_n(spark: SparkSession, d: str) -> DataFrame:
    series = a.air_daily(spark, d).groupBy("timestamp").agg(F.avg("AQI").alias("mean_aqi"))
    return tables.preview(series, [F.col("timestamp")], n=2000)


@query(
    "filtered_aqi_series",
    f"""WITH {a.AIR_DAILY}
SELECT timestamp, station_id, {rs('AQI')} FROM (
  SELECT * FROM air_daily WHERE timestamp >= TIMESTAMP '1995-02-01' AND timestamp < TIMESTAMP '1997-07-01'
    AND station_id = '1-URGENT' ORDER BY timestamp, station_id, AQI LIMIT 2000)""",
)
def filtered_aqi_series(spark: SparkSession, d: str) -> DataFrame:
    return marts.aqi_series(a.air_daily(spark, d), "1995-02-01", "1997-06-30", "1-URGENT")


@query(
    "sample_n_points",
    f"""WITH {a.TRAFFIC}
SELECT event_id, {rs('vehicle_count', 'average_speed')}, congestion_level FROM traffic
ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id LIMIT 5000""",
)
def sample_n_points(spark: SparkSession, d: str) -> DataFrame:
    rows = a.traffic_of(a.readings(spark, d)).select(
        "event_id", "vehicle_count", "average_speed", "congestion_level"
    )
    return profile.sample_rows(rows, "event_id", 5000)


@query(
    "filtered_sample",
    f"""WITH {a.TRAFFIC}
SELECT event_id, {rs('vehicle_count', 'average_speed')}, congestion_level FROM traffic
WHERE {_RANGE_SQL} AND zone = 'click'
ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id LIMIT 1000""",
)
def filtered_sample(spark: SparkSession, d: str) -> DataFrame:
    sample = marts.speed_volume_sample(a.traffic(spark, d), "event_id", _FROM, _TO, zone="click")
    return sample.select("event_id", "vehicle_count", "average_speed", "congestion_level")


@query(
    "overlay_sample",
    f"""WITH {a.HOURLY}
SELECT timestamp, {rs('total_vehicles')}, {r('avg_AQI * 50', 'aqi_scaled')} FROM hourly
ORDER BY md5(strftime(timestamp, '%Y-%m-%d %H:%M:%S') || ':42'), timestamp LIMIT 2000""",
)
def overlay_sample(spark: SparkSession, d: str) -> DataFrame:
    return marts.overlay_series(a.hourly(spark, d), n=2000)


@query(
    "hour_spine_gaps",
    f"""WITH {a.READINGS}, h AS (
  SELECT DISTINCT entity, date_trunc('hour', timestamp) AS timestamp FROM readings), s AS (
  SELECT unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS timestamp
  FROM h)
SELECT e.entity, s.timestamp FROM s, (SELECT DISTINCT entity FROM h) e
WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.entity = e.entity AND h.timestamp = s.timestamp)""",
)
def hour_spine_gaps(spark: SparkSession, d: str) -> DataFrame:
    return profile.missing_hours(a.readings(spark, d), "entity")
