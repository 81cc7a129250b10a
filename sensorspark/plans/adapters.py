"""Sensor-shaped views over the given tables, and the same views as SQL common table expressions.

Events stand for the hourly feeds (one event type per feed), orders for a daily air-quality feed,
line items for a daily energy feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorspark.functions import calendar
from sensorspark.functions.scores import aqi_category
from sensorspark.operators import rollup


# The columns the views need, with zoned timestamps: no footer has to be read to plan a query, and
# time filters stay on the bare column.
SCHEMAS = {
    "events": "event_id long, ts timestamp, event_type string, value double, props string",
    "orders": "o_orderkey long, o_totalprice double, o_orderdate timestamp, "
    "o_orderpriority string",
    "lineitem": "l_quantity double, l_extendedprice double, l_discount double, "
    "l_returnflag string, l_shipdate timestamp",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def readings_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("ts").alias("timestamp"),
        F.col("event_id"),
        F.col("event_type").alias("entity"),
        F.col("value").alias("x"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_of(table(spark, sf_dir, "events"))


def congestion(x: Column) -> Column:
    return F.when(x >= 80, "High").when(x >= 40, "Medium").otherwise("Low")


def traffic_of(rows: DataFrame) -> DataFrame:
    return rows.select(
        "timestamp",
        "event_id",
        F.col("entity").alias("zone"),
        F.col("x").alias("vehicle_count"),
        F.col("k").alias("average_speed"),
        congestion(F.col("x")).alias("congestion_level"),
    )


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as traffic readings with calendar columns."""
    return calendar.add_calendar(traffic_of(readings(spark, sf_dir)))


def traffic_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traffic readings shifted so that part of them breaks the range rules."""
    return traffic_of(readings(spark, sf_dir)).withColumns(
        {
            "vehicle_count": F.col("vehicle_count") - 5,
            "average_speed": F.col("average_speed") * 1.25,
        }
    )


def _air_fields() -> list[Column]:
    x, k = F.col("x"), F.col("k")
    return [
        (x / 2).alias("PM25"),
        (x * 0.75).alias("PM10"),
        k.alias("NO2"),
        (100 - k).alias("O3"),
        (k / 4).alias("temperature"),
        k.alias("humidity"),
        x.alias("AQI"),
    ]


def air_of(rows: DataFrame) -> DataFrame:
    return rows.select(
        "timestamp", F.col("entity").alias("station_id"), *_air_fields(), aqi_category(F.col("x")).alias("AQI_category")
    )


def air(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as air-quality readings with calendar columns."""
    return calendar.add_calendar(air_of(readings(spark, sf_dir)))


def air_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Air readings shifted so that part of them breaks the range rules."""
    return air_of(readings(spark, sf_dir)).withColumns(
        {
            "PM25": F.col("PM25") - 1,
            "NO2": F.col("NO2") - 3,
            "temperature": F.col("temperature") * 3,
            "humidity": F.col("humidity") + 10,
        }
    )


def _energy_fields() -> list[Column]:
    x = F.col("x")
    return [
        x.alias("energy_consumption_kwh"),
        (x / 10).alias("peak_demand_kw"),
        F.col("k").alias("renewable_percent"),
        (x * 0.12).alias("cost_usd"),
    ]


def energy_of(rows: DataFrame) -> DataFrame:
    return rows.select("timestamp", F.col("entity").alias("building_type"), *_energy_fields())


def _weather_measures() -> list[Column]:
    """Hourly weather from two event types: one gives temperature and humidity, one the rest."""
    x, k = F.col("x"), F.col("k")
    warm, wet = F.col("entity") == "signup", F.col("entity") == "error"
    return [
        F.avg(F.when(warm, x)).alias("temperature"),
        F.avg(F.when(warm, k)).alias("humidity"),
        F.avg(F.when(wet, k)).alias("wind_speed"),
        F.avg(F.when(wet, x)).alias("precipitation_mm"),
        (F.avg(F.when(wet, k)) / 10 + 1000).alias("pressure_hpa"),
        F.count_if(warm | wet).alias("_weather"),
    ]


def _with_condition(grouped: DataFrame) -> DataFrame:
    """Hours without weather readings have no condition."""
    condition = F.when(F.col("precipitation_mm") >= 40, "Rainy").when(F.col("_weather") > 0, "Clear")
    return grouped.withColumn("condition", condition).drop("_weather")


def weather_of(rows: DataFrame) -> DataFrame:
    return _with_condition(rows.groupBy("timestamp").agg(*_weather_measures()))


def weather_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-event weather shifted so that part of it breaks the range rules."""
    rows = readings(spark, sf_dir)
    x, k = F.col("x"), F.col("k")
    return rows.select(
        "timestamp",
        (k - 60).alias("temperature"),
        (k + 5).alias("humidity"),
        (x * 1.5).alias("wind_speed"),
        (x - 10).alias("precipitation_mm"),
        (k / 10 + 1000).alias("pressure_hpa"),
        congestion(x).alias("condition"),
    )


def hourly_parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four hourly feeds: traffic sums over all zones and air over all stations; energy and weather
    come from their own event types (the filters reach the scan)."""
    rows = readings(spark, sf_dir).withColumn("timestamp", F.date_trunc("hour", "timestamp"))

    def only(*kinds: str) -> DataFrame:
        return rows.where(F.col("entity").isin(*kinds))

    return {
        "traffic": rollup.traffic_hourly(traffic_of(rows)),
        "air": rollup.air_quality_hourly(air_of(rows)),
        "energy": rollup.energy_hourly(energy_of(only("purchase"))),
        "weather": weather_of(only("signup", "error")),
    }


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide hourly table, from one scan and one aggregate of the events.

    It equals ``joined_hourly``, which rolls the feeds up one by one.
    """
    rows = readings(spark, sf_dir).withColumn("timestamp", F.date_trunc("hour", "timestamp"))
    x, k = F.col("x"), F.col("k")
    mixed = rows.select(
        "timestamp",
        "entity",
        "x",
        "k",
        F.struct(x.alias("vehicle_count"), k.alias("average_speed"), congestion(x).alias("congestion_level")).alias("traffic"),
        F.struct(*_air_fields()).alias("air"),
        F.when(F.col("entity") == "purchase", F.struct(*_energy_fields())).alias("energy"),
    )
    return _with_condition(rollup.mixed_hourly(mixed, *_weather_measures()))


def joined_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table by joining the four feeds' rollups."""
    parts = hourly_parts(spark, sf_dir)
    return rollup.master_join(parts["traffic"], parts["air"], parts["energy"], parts["weather"])


def air_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_orderpriority").alias("station_id"),
        (price / 1000).alias("AQI"),
        (price / 2000).alias("PM25"),
    )


def energy_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_returnflag").alias("building_type"),
        F.col("l_quantity").alias("energy_consumption_kwh"),
        (F.col("l_extendedprice") / 1000).alias("peak_demand_kw"),
        (F.col("l_discount") * 100).alias("renewable_percent"),
        F.col("l_extendedprice").alias("cost_usd"),
    )


def energy_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items shifted so that part of them breaks the range rules."""
    return energy_daily(spark, sf_dir).withColumns(
        {
            "energy_consumption_kwh": F.col("energy_consumption_kwh") - 3,
            "peak_demand_kw": F.col("peak_demand_kw") - 10,
            "renewable_percent": F.col("renewable_percent") * 12,
        }
    )


# --- the same views in SQL -------------------------------------------------------------------

READINGS = """readings AS (
  SELECT CAST(ts AS TIMESTAMP) AS timestamp, event_id, event_type AS entity, value AS x,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k
  FROM events)"""

LEVEL = "CASE WHEN x >= 80 THEN 'High' WHEN x >= 40 THEN 'Medium' ELSE 'Low' END"


def calendar_sql(ts: str) -> str:
    return (
        f"hour({ts}) AS hour, day({ts}) AS day, month({ts}) AS month, CAST({ts} AS DATE) AS date, "
        f"strftime({ts}, '%a') AS weekday, dayofweek({ts}) IN (0, 6) AS is_weekend"
    )


def keys_sql(ts: str) -> str:
    return (
        f"hour({ts}) AS hour, CAST({ts} AS DATE) AS date, strftime({ts}, '%a') AS weekday, "
        f"dayofweek({ts}) IN (0, 6) AS is_weekend"
    )


TRAFFIC = f"""{READINGS}, traffic AS (
  SELECT timestamp, event_id, entity AS zone, x AS vehicle_count, k AS average_speed,
         {LEVEL} AS congestion_level, {calendar_sql('timestamp')}
  FROM readings)"""

AQI_CATEGORY = (
    "CASE WHEN {0} < 0 OR {0} IS NULL THEN NULL WHEN {0} < 50 THEN 'Good' "
    "WHEN {0} < 100 THEN 'Moderate' WHEN {0} < 150 THEN 'Unhealthy_Sensitive' "
    "WHEN {0} < 200 THEN 'Unhealthy' WHEN {0} < 300 THEN 'Very_Unhealthy' ELSE 'Hazardous' END"
)

AIR = f"""{READINGS}, air AS (
  SELECT timestamp, entity AS station_id, x / 2 AS PM25, x * CAST(0.75 AS DOUBLE) AS PM10,
         k AS NO2, 100 - k AS O3, k / 4 AS temperature, k AS humidity, x AS AQI,
         {AQI_CATEGORY.format('x')} AS AQI_category, {calendar_sql('timestamp')}
  FROM readings)"""

HOURLY_TAIL = f"""rows_h AS (
  SELECT date_trunc('hour', timestamp) AS ts, entity, x, k FROM readings),
traffic_h AS (
  SELECT ts, coalesce(sum(x), 0) AS total_vehicles, avg(k) AS avg_speed,
         count(*) FILTER (WHERE x >= 80) AS high_congestion_zones
  FROM rows_h GROUP BY ts),
air_h AS (
  SELECT ts, avg(x / 2) AS avg_PM25, avg(x * CAST(0.75 AS DOUBLE)) AS avg_PM10,
         avg(k) AS avg_NO2, avg(100 - k) AS avg_O3, avg(x) AS avg_AQI,
         avg(k / 4) AS avg_temperature, avg(k) AS avg_humidity
  FROM rows_h GROUP BY ts),
energy_h AS (
  SELECT ts, coalesce(sum(x), 0) AS total_energy_kwh, avg(x / 10) AS avg_peak_demand,
         avg(k) AS avg_renewable_percent,
         coalesce(sum(x * CAST(0.12 AS DOUBLE)), 0) AS total_cost
  FROM rows_h WHERE entity = 'purchase' GROUP BY ts),
weather_h AS (
  SELECT ts, avg(x) FILTER (WHERE entity = 'signup') AS temperature,
         avg(k) FILTER (WHERE entity = 'signup') AS humidity,
         avg(k) FILTER (WHERE entity = 'error') AS wind_speed,
         avg(x) FILTER (WHERE entity = 'error') AS precipitation_mm,
         avg(k) FILTER (WHERE entity = 'error') / 10 + 1000 AS pressure_hpa,
         CASE WHEN avg(x) FILTER (WHERE entity = 'error') >= 40 THEN 'Rainy' ELSE 'Clear' END
           AS condition
  FROM rows_h WHERE entity IN ('signup', 'error') GROUP BY ts),
hourly AS (
  SELECT t.ts AS timestamp, {keys_sql('t.ts')},
         t.total_vehicles, t.avg_speed, t.high_congestion_zones,
         a.avg_PM25, a.avg_PM10, a.avg_NO2, a.avg_O3, a.avg_AQI, a.avg_temperature,
         a.avg_humidity, e.total_energy_kwh, e.avg_peak_demand, e.avg_renewable_percent,
         e.total_cost, w.temperature, w.humidity, w.wind_speed, w.precipitation_mm,
         w.pressure_hpa, w.condition
  FROM traffic_h t LEFT JOIN air_h a ON t.ts = a.ts LEFT JOIN energy_h e ON t.ts = e.ts
  LEFT JOIN weather_h w ON t.ts = w.ts)"""

HOURLY = f"{READINGS}, {HOURLY_TAIL}"

AIR_DAILY = """air_daily AS (
  SELECT CAST(o_orderdate AS TIMESTAMP) AS timestamp, o_orderpriority AS station_id,
         o_totalprice / 1000 AS AQI, o_totalprice / 2000 AS PM25
  FROM orders)"""

ENERGY_DAILY = """energy_daily AS (
  SELECT CAST(l_shipdate AS TIMESTAMP) AS timestamp, l_returnflag AS building_type,
         l_quantity AS energy_consumption_kwh, l_extendedprice / 1000 AS peak_demand_kw,
         l_discount * 100 AS renewable_percent, l_extendedprice AS cost_usd
  FROM lineitem)"""
