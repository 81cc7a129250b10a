"""Hand-written CSV files of all four feeds, as other tools write them."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sensorspark.functions import calendar
from sensorspark.sources import tables
from sensorspark.sources.schemas import RAW_SCHEMAS

FILES = {
    "traffic": "timestamp,zone,vehicle_count,average_speed,congestion_level\n{},A,5,31.5,Low\n",
    "air_quality": "timestamp,station_id,PM25,PM10,NO2,O3,temperature,humidity,AQI,AQI_category\n{},S1,1,2,3,4,5,6,7,Good\n",
    "energy": "timestamp,building_type,energy_consumption_kwh,peak_demand_kw,renewable_percent,cost_usd\n{},Home,1,2,3,4\n",
    "weather": "timestamp,temperature,humidity,wind_speed,precipitation_mm,pressure_hpa,condition\n{},1,2,3,4,5,Clear\n",
}
STAMPS = {
    "2025-01-01 01:00:00": datetime(2025, 1, 1, 1),
    "2025-01-01": datetime(2025, 1, 1),
    "2025-01-01 01:00:00.250000": datetime(2025, 1, 1, 1, 0, 0, 250000),
    "2025-01-01T01:02:03": datetime(2025, 1, 1, 1, 2, 3),
    "NA": None,
    "12:30": None,
    "yesterday": None,
}


@pytest.mark.parametrize("feed", FILES)
def test_stamps_of_every_shape(spark, tmp_path, feed):
    for k, (text, want) in enumerate(STAMPS.items()):
        path = tmp_path / f"{feed}{k}.csv"
        path.write_text(FILES[feed].format(text))
        got = tables.read_raw(spark, feed, str(path))
        assert got.schema.simpleString() == RAW_SCHEMAS[feed].simpleString()
        row = got.withColumn("timestamp", F.col("timestamp").cast("string")).first()
        shown = None if want is None else str(want).rstrip("0") if want.microsecond else str(want)
        assert row.timestamp == shown and row[1] is not None
        unread = tables.unreadable_stamps(spark, str(path), RAW_SCHEMAS[feed]).first().timestamp
        assert unread == (want is None and text != "NA")


def test_written_files_read_back(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2025-03-01 10:11:12.123456' AS timestamp, 'Z' AS zone, 1 AS vehicle_count, 2.5D AS average_speed, 'Low' AS congestion_level")
    tables.write_csv(df, str(tmp_path / "out"))
    assert tables.read_raw(spark, "traffic", str(tmp_path / "out")).exceptAll(df).count() == 0


def test_times_without_a_date_are_no_stamps(spark):
    df = spark.createDataFrame([("12:30:00",), ("2025",), (" 2025-1-2 ",)], ["t"])
    got = [r.t for r in df.select(calendar.parse_timestamp(F.col("t")).cast("string").alias("t")).collect()]
    assert got == [None, None, "2025-01-02 00:00:00"]


ROUGH = """timestamp,zone,vehicle_count,average_speed,congestion_level
2025-01-01 01:00:00,A,5,31.5,Low
2025-01-01 01:00:00,A,5
2025-01-01 01:00:00,A,many,31.5,Low
soon,A,5,fast,Low
2025-01-01 01:00:00,"A,5,31.5,Low
2025-01-01,NA,NA,,High,more

NA,"B, west", 7 ,1e2,"said ""hi\"""
"""


def test_every_line_is_accepted_or_rejected(spark, tmp_path):
    (tmp_path / "one.csv").write_text(ROUGH)
    (tmp_path / "two.csv").write_text(ROUGH.splitlines()[0] + "\n2025-01-02,C,1,2,Low\n")
    checked = tables.read_checked(spark, str(tmp_path), RAW_SCHEMAS["traffic"])
    assert checked.accepted.schema.simpleString() == RAW_SCHEMAS["traffic"].simpleString()
    good = {(r.zone, r.vehicle_count, r.average_speed) for r in checked.accepted.collect()}
    assert good == {("A", 5, 31.5), ("B, west", 7, 100.0), ("C", 1, 2.0)}
    bad = {r.line: [(p.column, p.value, p.expected) for p in r.reasons] for r in checked.rejected.collect()}
    lines = ROUGH.splitlines()
    assert bad[lines[3]] == [("vehicle_count", "many", "int")]
    assert bad[lines[4]] == [("timestamp", "soon", "timestamp"), ("average_speed", "fast", "double")]
    for k in (2, 5, 6):
        assert [p[2] for p in bad[lines[k]]] == ["5 columns"]
    counts = {r.file.rsplit("/", 1)[1]: (r.read, r.accepted, r.rejected) for r in checked.counts.collect()}
    assert counts == {"one.csv": (7, 2, 5), "two.csv": (1, 1, 0)}


def test_bundles_are_complete_or_absent(spark, tmp_path):
    prefix = str(tmp_path / "bundle")
    with pytest.raises(tables.BundleError):
        tables.read_bundle(spark, prefix)
    one, two = spark.range(5).toDF("a"), spark.createDataFrame([(1, [2.0, None])], "k int, v array<double>")
    assert tables.write_bundle({"one": one, "two": two}, prefix) == 1

    with pytest.raises(Exception):
        failing = spark.range(3).select(F.raise_error(F.lit("lost")).cast("int").alias("x"))
        tables.write_bundle({"one": one.limit(1), "two": failing}, prefix)
    found = tables.read_bundle(spark, prefix)
    assert found.version == 1 and found.tables["one"].count() == 5
    assert found.tables["two"].collect() == two.collect()
    assert tables.write_bundle({"one": one.limit(2)}, prefix) == 2
    assert tables.read_bundle(spark, prefix).tables["one"].count() == 2
    assert tables.read_bundle(spark, prefix, version=1).tables["one"].count() == 5
    spark.range(9).toDF("a").write.mode("append").parquet(f"{prefix}/2/one")
    with pytest.raises(tables.BundleError):
        tables.read_bundle(spark, prefix)
    assert tables.read_bundle(spark, prefix, verify=False).version == 2
