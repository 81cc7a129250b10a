"""Fixed schemas of the four raw feeds, so that no reader has to infer types."""

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


TRAFFIC_RAW = _schema(
    ("timestamp", T.TimestampType()),
    ("zone", T.StringType()),
    ("vehicle_count", T.IntegerType()),
    ("average_speed", T.DoubleType()),
    ("congestion_level", T.StringType()),
)

AIR_QUALITY_RAW = _schema(
    ("timestamp", T.TimestampType()),
    ("station_id", T.StringType()),
    ("PM25", T.DoubleType()),
    ("PM10", T.DoubleType()),
    ("NO2", T.DoubleType()),
    ("O3", T.DoubleType()),
    ("temperature", T.DoubleType()),
    ("humidity", T.DoubleType()),
    ("AQI", T.IntegerType()),
    ("AQI_category", T.StringType()),
)

ENERGY_RAW = _schema(
    ("timestamp", T.TimestampType()),
    ("building_type", T.StringType()),
    ("energy_consumption_kwh", T.DoubleType()),
    ("peak_demand_kw", T.DoubleType()),
    ("renewable_percent", T.DoubleType()),
    ("cost_usd", T.DoubleType()),
)

WEATHER_RAW = _schema(
    ("timestamp", T.TimestampType()),
    ("temperature", T.DoubleType()),
    ("humidity", T.DoubleType()),
    ("wind_speed", T.DoubleType()),
    ("precipitation_mm", T.DoubleType()),
    ("pressure_hpa", T.DoubleType()),
    ("condition", T.StringType()),
)

RAW_SCHEMAS = {
    "traffic": TRAFFIC_RAW,
    "air_quality": AIR_QUALITY_RAW,
    "energy": ENERGY_RAW,
    "weather": WEATHER_RAW,
}
