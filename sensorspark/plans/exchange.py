"""Queries that write a table, read it back and return what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sensorspark.operators import anomaly, cluster, marts, profile, rollup, stats
from sensorspark.plans import adapters as a
from sensorspark.plans import clusters, densities
from sensorspark.plans.anomalies import RECORDS_SQL, SCORED, scored_master
from sensorspark.plans.clusters import PCA_COLUMNS
from sensorspark.plans.densities import DBSCAN
from sensorspark.plans.registry import query, rs
from sensorspark.plans.relational import CORR_COLUMNS, MASTER_OUT
from sensorspark.session import materialize, scratch_path, with_scalars
from sensorspark.sources import tables
from sensorspark.sources.schemas import RAW_SCHEMAS


@query(
    "csv_roundtrip",
    f"""WITH {a.READINGS}
SELECT timestamp, entity AS zone, CAST(trunc(x) AS INT) AS vehicle_count,
       CASE WHEN k >= 50 THEN k END AS average_speed, {a.LEVEL} AS congestion_level
FROM readings""",
)
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The raw traffic feed through CSV: integer counts, and missing speeds written as NA."""
    rows = a.traffic_of(a.readings(spark, d)).select(
        "timestamp",
        "zone",
        F.col("vehicle_count").cast("int").alias("vehicle_count"),
        F.when(F.col("average_speed") >= 50, F.col("average_speed")).alias("average_speed"),
        "congestion_level",
    )
    path = scratch_path(spark, "csv")
    tables.write_csv(rows, path)
    return tables.read_raw(spark, "traffic", path)


@query(
    "csv_plain_scan",
    f"""WITH {a.READINGS}, stamped AS (
  SELECT CASE WHEN event_id % 5 = 0 THEN CAST(CAST(timestamp AS DATE) AS TIMESTAMP)
              WHEN event_id % 5 = 1 THEN NULL ELSE date_trunc('second', timestamp) END AS timestamp,
         entity AS zone, CAST(trunc(x) AS INT) AS vehicle_count, k AS average_speed,
         {a.LEVEL} AS congestion_level, event_id % 5 = 1 AS unread
  FROM readings)
SELECT timestamp, zone, vehicle_count, {rs('average_speed')}, congestion_level,
       (SELECT count(*) FROM stamped WHERE unread) AS unreadable
FROM stamped""",
)
def csv_plain_scan(spark: SparkSession, d: str) -> DataFrame:
    """A traffic feed as other tools write it: seconds or dates as stamps, some of them unreadable."""
    stamp = (
        F.when(F.col("event_id") % 5 == 0, F.date_format("timestamp", "yyyy-MM-dd"))
        .when(F.col("event_id") % 5 == 1, F.lit("soon"))
        .otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    )
    rows = a.traffic_of(a.readings(spark, d)).select(
        stamp.alias("timestamp"),
        "zone",
        F.col("vehicle_count").cast("int").alias("vehicle_count"),
        "average_speed",
        "congestion_level",
    )
    path = scratch_path(spark, "plain-csv")
    tables.write_csv(rows, path)
    unread = tables.unreadable_stamps(spark, path, RAW_SCHEMAS["traffic"]).withColumnRenamed("timestamp", "unreadable")
    return with_scalars(tables.read_raw(spark, "traffic", path), unread)


@query(
    "csv_rejected_rows",
    f"""WITH {a.READINGS}, t AS (SELECT CASE event_id % 7 WHEN 0 THEN '5 columns' WHEN 1 THEN 'vehicle_count: int'
    WHEN 2 THEN '5 columns' WHEN 3 THEN 'timestamp: timestamp,average_speed: double' ELSE 'accepted' END AS outcome FROM readings)
SELECT outcome, count(*) AS n, (SELECT count(*) FROM readings) AS read, true AS complete FROM t GROUP BY outcome""",
)
def csv_rejected_rows(spark: SparkSession, d: str) -> DataFrame:
    """A traffic feed with short lines, text in a number column, stray quotes and unreadable stamps."""
    case = F.col("event_id") % 7
    stamp = F.when(case == 3, "soon").otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    count = F.when(case == 1, "many").otherwise(F.col("vehicle_count").cast("int").cast("string"))
    zone = F.when(case == 2, F.concat(F.lit('"'), F.col("zone"))).otherwise(F.col("zone"))
    speed = F.when(case == 3, "fast").otherwise(F.col("average_speed").cast("string"))
    cells = [stamp, zone, F.coalesce(count, F.lit("NA")), F.coalesce(speed, F.lit("NA")), F.col("congestion_level")]
    line = F.when(case == 0, F.concat_ws(",", *cells[:3])).otherwise(F.concat_ws(",", *cells))
    path = scratch_path(spark, "rough-csv")
    a.traffic_of(a.readings(spark, d)).select(line.alias("value")).write.text(path)
    checked = tables.read_checked(spark, path, RAW_SCHEMAS["traffic"], header=False)
    named = F.transform("reasons", lambda p: F.concat_ws(": ", p["column"], p["expected"]))
    outcomes = checked.rejected.select(F.array_join(named, ",").alias("outcome")).unionByName(
        checked.accepted.select(F.lit("accepted").alias("outcome"))
    )
    counted = outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    totals = checked.counts.agg(
        F.sum("read").alias("read"), F.every(F.col("read") == F.col("accepted") + F.col("rejected")).alias("complete")
    )
    return with_scalars(counted, totals)


@query("table_roundtrip", f"WITH {a.HOURLY} SELECT {MASTER_OUT} FROM hourly")
def table_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Build the hourly table only when absent, then read the stored one twice."""
    path = scratch_path(spark, "master")
    tables.ensure(spark, path, lambda: a.hourly(spark, d))
    return tables.ensure(spark, path, lambda: spark.range(0).toDF("never_built"))


@query(
    "month_partition_scan",
    f"""WITH {a.AIR_DAILY}
SELECT timestamp, station_id, {rs('AQI', 'PM25')} FROM air_daily
WHERE strftime(timestamp, '%Y-%m') BETWEEN '1996-03' AND '1997-02'""",
)
def month_partition_scan(spark: SparkSession, d: str) -> DataFrame:
    """A typed table partitioned by month; the filter reads twelve folders."""
    path = scratch_path(spark, "air")
    air = a.air_daily(spark, d)
    tables.write_by_month(air, path)
    schema = StructType(air.schema.fields + [StructField("month", StringType())])
    stored = tables.read_table(spark, path, schema)
    return stored.where(F.col("month").between("1996-03", "1997-02")).drop("month")


@query("mart_roundtrip", f"WITH {SCORED} {RECORDS_SQL}")
def mart_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The three anomaly marts as CSV and parquet; returns the records read from CSV."""
    scored = materialize(scored_master(spark, d), "scored")
    records = anomaly.anomaly_records(scored)
    prefix = scratch_path(spark, "marts")
    tables.write_anomaly_marts(
        {
            "anomaly_records": records,
            "severity_summary": anomaly.severity_summary(scored),
            "anomaly_summary": anomaly.method_summary(scored),
        },
        prefix,
    )
    return tables.read_csv(spark, f"{prefix}/csv/anomaly_records", records.schema)


def _compared(spark: SparkSession, members: dict[str, DataFrame], prefix: str) -> DataFrame:
    """(member, n, differing) of a bundle that is written, read back and compared row by row."""
    given = {name: materialize(df, name) for name, df in members.items()}
    tables.write_bundle(given, prefix)
    stored = tables.read_bundle(spark, prefix).tables
    parts = []
    for name, df in given.items():
        found = stored[name]
        differing = df.exceptAll(found).unionByName(found.exceptAll(df)).agg(F.count(F.lit(1)).alias("differing"))
        rows = found.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("member"), "n")
        parts.append(with_scalars(rows, differing))
    return marts.combine(parts)


@query(
    "bundle_roundtrip",
    f"""WITH {a.HOURLY}
SELECT 'hourly_patterns' AS member, count(DISTINCT hour) AS n, 0 AS differing FROM hourly
UNION ALL SELECT 'weekday_patterns', count(DISTINCT weekday), 0 FROM hourly
UNION ALL SELECT 'zone_stats', count(DISTINCT event_type), 0 FROM events
UNION ALL SELECT 'station_stats', count(DISTINCT o_orderpriority), 0 FROM orders
UNION ALL SELECT 'building_stats', count(DISTINCT l_returnflag), 0 FROM lineitem
UNION ALL SELECT 'correlation_matrix', {len(CORR_COLUMNS) ** 2}, 0""",
)
def bundle_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The exploratory result bundle, written, read back and compared."""
    master = materialize(a.hourly(spark, d), "master")
    members = {
        "hourly_patterns": profile.mean_profile(master, ["hour"], profile.THREE_MEANS),
        "weekday_patterns": profile.mean_profile(master, ["weekday"], profile.THREE_MEANS),
        "zone_stats": profile.zone_stats(a.traffic(spark, d)),
        "station_stats": profile.station_stats(a.air_daily(spark, d)),
        "building_stats": profile.building_stats(a.energy_daily(spark, d)),
        "correlation_matrix": stats.correlation_matrix(master, CORR_COLUMNS),
    }
    return _compared(spark, members, scratch_path(spark, "bundle"))


_DAYS = "(SELECT count(DISTINCT CAST(timestamp AS DATE)) FROM hourly)"


@query(
    "clustering_bundle",
    f"""WITH RECURSIVE {DBSCAN}
SELECT 'hourly_patterns' AS member, count(DISTINCT hour) AS n, 0 AS differing FROM hourly
UNION ALL SELECT 'hourly_cluster_summary', 4, 0
UNION ALL SELECT 'daily_patterns', {_DAYS}, 0
UNION ALL SELECT 'daily_cluster_summary', 3, 0
UNION ALL SELECT 'weekday_patterns', count(DISTINCT weekday), 0 FROM hourly
UNION ALL SELECT 'correlation_matrix', {len(CORR_COLUMNS) ** 2}, 0
UNION ALL SELECT 'pca_result', count(*), 0 FROM hourly WHERE {' AND '.join(f'{c} IS NOT NULL' for c in PCA_COLUMNS)}
UNION ALL SELECT 'pca_variance', {len(PCA_COLUMNS)}, 0
UNION ALL SELECT 'dbscan_result', count(*), 0 FROM db
UNION ALL SELECT 'dbscan_data', count(*), 0 FROM db
UNION ALL SELECT 'anomalies', count(*), 0 FROM db WHERE cluster = 0""",
)
def clustering_bundle(spark: SparkSession, d: str) -> DataFrame:
    """All results of the clustering step as one bundle, written, read back and compared."""
    master = materialize(a.hourly(spark, d), "master")
    hours = materialize(clusters.clustered_hours(spark, d), "hours")
    days = materialize(clusters.clustered_days(spark, d), "days")
    components = clusters.components(spark, d)
    dense = materialize(densities.clustered_rows(spark, d), "dbscan")
    members = {
        "hourly_patterns": clusters.hour_profile(spark, d),
        "hourly_cluster_summary": cluster.hour_cluster_summary(hours),
        "daily_patterns": clusters.day_profile(spark, d),
        "daily_cluster_summary": cluster.day_cluster_summary(days),
        "weekday_patterns": rollup.weekday_patterns(master),
        "correlation_matrix": stats.correlation_matrix(master, CORR_COLUMNS),
        "pca_result": components.scores(["timestamp"]),
        "pca_variance": components.variance(),
        "dbscan_result": dense.select("timestamp", "cluster"),
        "dbscan_data": dense,
        "anomalies": dense.where(F.col("cluster") == 0),
    }
    return _compared(spark, members, scratch_path(spark, "clustering"))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    master = materialize(a.hourly(spark, d), "master")
    zones, stations = profile.zone_stats(a.traffic(spark, d)), profile.station_stats(
        a.air_daily(spark, d)
    )
    return marts.findings(master, zones, stations)


_FINDINGS = f"""WITH {a.TRAFFIC}, {a.AIR_DAILY}, {a.HOURLY_TAIL}, p AS (
  SELECT hour, avg(total_vehicles) AS v, avg(avg_AQI) AS q, avg(total_energy_kwh) AS e
  FROM hourly GROUP BY hour), z AS (
  SELECT zone, avg(CASE WHEN congestion_level = 'High' THEN 1.0 ELSE 0.0 END) AS v
  FROM traffic GROUP BY zone), s AS (
  SELECT station_id, avg(AQI) AS v FROM air_daily GROUP BY station_id), f AS (
SELECT 1 AS position, 'Records' AS key, format('{{:,}}', count(*)) AS value FROM hourly
UNION ALL SELECT 2, 'Date Range',
  strftime(min(date), '%Y-%m-%d') || ' to ' || strftime(max(date), '%Y-%m-%d') FROM hourly
UNION ALL SELECT 3, 'Peak Traffic Hour', string_agg(CAST(hour AS VARCHAR), ', ' ORDER BY hour)
  || ':00' FROM p WHERE v = (SELECT max(v) FROM p)
UNION ALL SELECT 4, 'Worst Air Quality Hour', string_agg(CAST(hour AS VARCHAR), ', ' ORDER BY hour)
  || ':00' FROM p WHERE q = (SELECT max(q) FROM p)
UNION ALL SELECT 5, 'Peak Energy Hour', string_agg(CAST(hour AS VARCHAR), ', ' ORDER BY hour)
  || ':00' FROM p WHERE e = (SELECT max(e) FROM p)
UNION ALL SELECT 6, 'Most Congested Zone', string_agg(zone, ', ' ORDER BY zone) FROM z
  WHERE v = (SELECT max(v) FROM z)
UNION ALL SELECT 7, 'Worst AQI Station', string_agg(station_id, ', ' ORDER BY station_id) FROM s
  WHERE v = (SELECT max(v) FROM s))
"""


@query("findings_report", _FINDINGS + "SELECT position, key, value FROM f")
def findings_report(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d)


@query("findings_text", _FINDINGS + "SELECT key || ': ' || value AS value FROM f")
def findings_text(spark: SparkSession, d: str) -> DataFrame:
    """The same report as a text file, read back line by line."""
    path = scratch_path(spark, "findings")
    tables.write_findings(_findings(spark, d), path)
    return spark.read.text(path)
