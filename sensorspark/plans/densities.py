"""Density queries on the standardised hourly metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorspark.functions.clean import complete_cases
from sensorspark.functions.scores import cluster_label
from sensorspark.operators import density
from sensorspark.operators.stats import standardize
from sensorspark.plans import adapters as a
from sensorspark.plans.anomalies import METRICS
from sensorspark.plans.registry import query, r, rs
from sensorspark.session import materialize

Z = [f"{c}_z" for c in METRICS.values()]
EPS, MIN_PTS = 1.5, 5


def scaled_rows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly rows complete in the three metrics, with z-scores over those rows."""
    columns = list(METRICS.values())
    rows = complete_cases(a.hourly(spark, d).select("timestamp", "hour", *columns))
    return materialize(standardize(materialize(rows, "complete"), columns), "scaled")


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in METRICS.values())
SCALED = f"""{a.HOURLY}, cr AS (SELECT * FROM hourly WHERE {_COMPLETE}), zs AS (
  SELECT timestamp, hour, {', '.join(METRICS.values())},
         row_number() OVER (ORDER BY timestamp) AS id, {', '.join(
    f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}_z' for c in METRICS.values())}
  FROM cr)"""
_GAP = "sqrt(" + " + ".join(f"power(p.{z} - q.{z}, 2)" for z in Z) + ")"


@query(
    "knn_distance",
    f"""WITH {SCALED}, ds AS (
  SELECT p.timestamp, {_GAP} AS dist FROM zs p, zs q WHERE p.id <> q.id), rk AS (
  SELECT *, row_number() OVER (PARTITION BY timestamp ORDER BY dist) AS rn FROM ds)
SELECT timestamp, {r('dist', 'distance')} FROM rk WHERE rn = 4""",
)
def knn_distance(spark: SparkSession, d: str) -> DataFrame:
    """The sorted 4-nearest-neighbour curve."""
    return density.knn_distance(scaled_rows(spark, d), "timestamp", Z, k=4).orderBy("distance")


DBSCAN = f"""{SCALED}, pr AS MATERIALIZED (
  SELECT p.id AS i, q.id AS j FROM zs p, zs q WHERE {_GAP} <= {EPS}),
core AS MATERIALIZED (SELECT i FROM pr GROUP BY i HAVING count(*) >= {MIN_PTS}),
cc AS MATERIALIZED (
  SELECT pr.i, pr.j FROM pr JOIN core a ON pr.i = a.i JOIN core b ON pr.j = b.i),
rc(i, label) AS (
  SELECT i, i FROM core
  UNION
  SELECT cc.j, rc.label FROM rc JOIN cc ON rc.i = cc.i WHERE rc.label < cc.j),
comp AS MATERIALIZED (SELECT i, min(label) AS label FROM rc GROUP BY i),
num AS (SELECT label, row_number() OVER (ORDER BY label) AS cluster
        FROM (SELECT DISTINCT label FROM comp)),
cn AS (SELECT comp.i, num.cluster FROM comp JOIN num ON comp.label = num.label),
db AS (
  SELECT zs.*, coalesce(own.cluster, adj.cluster, 0) AS cluster
  FROM zs LEFT JOIN cn own ON zs.id = own.i
  LEFT JOIN (SELECT pr.i, min(cn.cluster) AS cluster FROM pr JOIN cn ON pr.j = cn.i GROUP BY pr.i)
    adj ON zs.id = adj.i)"""


def clustered_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = scaled_rows(spark, d)
    clusters = density.dbscan(rows, "timestamp", Z, EPS, MIN_PTS)
    return rows.join(clusters, "timestamp")


@query(
    "dbscan_clusters",
    f"""WITH RECURSIVE {DBSCAN}
SELECT timestamp, hour, {rs(*METRICS.values())}, cluster,
       CASE WHEN cluster = 0 THEN 'Anomaly' ELSE 'Cluster ' || cluster END AS label FROM db""",
)
def dbscan_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustered_rows(spark, d).select(
        "timestamp",
        "hour",
        *METRICS.values(),
        "cluster",
        cluster_label(F.col("cluster")).alias("label"),
    )


@query(
    "dbscan_noise_rate",
    f"""WITH RECURSIVE {DBSCAN}
SELECT count(*) AS rows, count(*) FILTER (WHERE cluster = 0) AS noise_rows,
       round(count(*) FILTER (WHERE cluster = 0) / count(*) * 100, 2) AS noise_percent,
       count(DISTINCT CASE WHEN cluster > 0 THEN cluster END) AS clusters FROM db""",
)
def dbscan_noise_rate(spark: SparkSession, d: str) -> DataFrame:
    clustered = materialize(clustered_rows(spark, d), "clustered")
    return density.noise_profile(clustered, METRICS)["rate"]


@query(
    "dbscan_noise_hours",
    f"""WITH RECURSIVE {DBSCAN}
SELECT hour, count(*) AS count FROM db WHERE cluster = 0 GROUP BY hour""",
)
def dbscan_noise_hours(spark: SparkSession, d: str) -> DataFrame:
    clustered = materialize(clustered_rows(spark, d), "clustered")
    return density.noise_profile(clustered, METRICS)["hours"]


@query(
    "dbscan_noise_profile",
    f"""WITH RECURSIVE {DBSCAN}
SELECT timestamp, hour, {rs(*METRICS.values())},
       {', '.join(r(f'{c}_z', f'{m}_zscore') for m, c in METRICS.items())}
FROM db WHERE cluster = 0 AND (total_vehicles_z > 2 OR avg_AQI_z > 2)
ORDER BY total_vehicles_z DESC, timestamp LIMIT 10""",
)
def dbscan_noise_profile(spark: SparkSession, d: str) -> DataFrame:
    clustered = materialize(clustered_rows(spark, d), "clustered")
    return density.noise_profile(clustered, METRICS)["extremes"]
