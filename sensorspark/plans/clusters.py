"""Clustering, principal-component, silhouette and smoothing queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorspark.functions.scores import silhouette_band
from sensorspark.operators import cluster, profile, rollup, smooth, tree, ward
from sensorspark.operators.stats import long_form, standardize
from sensorspark.plans import adapters as a
from sensorspark.plans.anomalies import METRICS
from sensorspark.plans.registry import query, r, rs
from sensorspark.session import materialize, with_scalars

HOUR_COLUMNS = ["avg_traffic", "avg_aqi", "avg_energy"]
DAY_COLUMNS = ["total_traffic", "avg_aqi", "total_energy", "max_traffic"]
PCA_COLUMNS = [
    "total_vehicles",
    "avg_AQI",
    "total_energy_kwh",
    "temperature",
    "humidity",
    "wind_speed",
    "hour",
    "is_weekend",
]


def hour_profile(spark: SparkSession, d: str) -> DataFrame:
    means = dict(zip(HOUR_COLUMNS, METRICS.values()))
    return materialize(profile.mean_profile(a.hourly(spark, d), ["hour"], means), "hours")


def day_profile(spark: SparkSession, d: str) -> DataFrame:
    return materialize(rollup.daily_patterns(a.hourly(spark, d)), "days")


_HOUR_SQL = f"""{a.HOURLY}, prof AS (
  SELECT hour, avg(total_vehicles) AS avg_traffic, avg(avg_AQI) AS avg_aqi,
         avg(total_energy_kwh) AS avg_energy FROM hourly GROUP BY hour),
zs AS (SELECT hour, """ + ", ".join(
    f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}_z" for c in HOUR_COLUMNS
) + " FROM prof)"


@query(
    "scaled_hour_profile",
    f"WITH {_HOUR_SQL} SELECT hour, " + ", ".join(r(f"{c}_z", f"{c}_z") for c in HOUR_COLUMNS)
    + " FROM zs",
)
def scaled_hour_profile(spark: SparkSession, d: str) -> DataFrame:
    scaled = standardize(hour_profile(spark, d), HOUR_COLUMNS)
    return scaled.select("hour", *[f"{c}_z" for c in HOUR_COLUMNS])


@query(
    "pairwise_distance",
    f"WITH {_HOUR_SQL} SELECT p.hour AS i, q.hour AS j, "
    + r("sqrt(" + " + ".join(f"power(p.{c}_z - q.{c}_z, 2)" for c in HOUR_COLUMNS) + ")", "distance")
    + " FROM zs p JOIN zs q ON p.hour < q.hour",
)
def pairwise_distance(spark: SparkSession, d: str) -> DataFrame:
    scaled = standardize(hour_profile(spark, d), HOUR_COLUMNS)
    return cluster.pairwise_distances(scaled, "hour", [f"{c}_z" for c in HOUR_COLUMNS])


@query("elbow")
def elbow(spark: SparkSession, d: str) -> DataFrame:
    return cluster.elbow(cluster.scaled_features(hour_profile(spark, d), HOUR_COLUMNS))


def clustered_hours(spark: SparkSession, d: str, k: int = 4) -> DataFrame:
    data = cluster.scaled_features(hour_profile(spark, d), HOUR_COLUMNS)
    model = cluster.best_kmeans(data, [k])[k]
    return cluster.with_clusters(data, model, "avg_traffic")


def clustered_days(spark: SparkSession, d: str, k: int = 3) -> DataFrame:
    data = cluster.scaled_features(day_profile(spark, d), DAY_COLUMNS)
    model = cluster.best_kmeans(data, [k])[k]
    return cluster.with_clusters(data, model, "total_traffic")


@query("kmeans_hours")
def kmeans_hours(spark: SparkSession, d: str) -> DataFrame:
    return clustered_hours(spark, d)


@query("hour_cluster_labels")
def hour_cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    return cluster.hour_cluster_summary(clustered_hours(spark, d))


@query("kmeans_days")
def kmeans_days(spark: SparkSession, d: str) -> DataFrame:
    return cluster.day_cluster_summary(materialize(clustered_days(spark, d), "day-clusters"))


WEEKDAY_COLUMNS = ["avg_traffic", "avg_aqi", "avg_energy", "traffic_variability"]
_SUNDAY_FIRST = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")


def _weekdays(spark: SparkSession, d: str) -> DataFrame:
    return materialize(rollup.weekday_patterns(materialize(a.hourly(spark, d), "master")), "weekdays")


def _sunday_first() -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in _SUNDAY_FIRST]), F.col("weekday"))


# One merge per step: all pairs of the list of clusters, the least rise first.
_PAIR_SQL = """list_sort(flatten(list_transform(range(1, len(cl) + 1), lambda i: list_transform(range(i + 1, len(cl) + 1),
  lambda j: {'rise': 2.0 * cl[i].w * cl[j].w / (cl[i].w + cl[j].w) * list_sum(list_transform(range(1, len(cl[i].x) + 1),
    lambda t: power(cl[i].x[t] - cl[j].x[t], 2))), 'i': i, 'j': j}))))[1]"""
WARD = f"""{a.HOURLY}, wd AS (
  SELECT strftime(timestamp, '%a') AS weekday, avg(total_vehicles) AS avg_traffic, avg(avg_AQI) AS avg_aqi,
         avg(total_energy_kwh) AS avg_energy, stddev_samp(total_vehicles) AS traffic_variability
  FROM hourly GROUP BY 1),
wz AS (SELECT weekday, avg_traffic, avg_energy, list_position({list(_SUNDAY_FIRST)!r}, weekday) AS pos, [{', '.join(
    f'coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0)' for c in WEEKDAY_COLUMNS)}] AS x
  FROM wd WHERE {' AND '.join(f'{c} IS NOT NULL' for c in WEEKDAY_COLUMNS)}),
wr AS (SELECT *, CAST(row_number() OVER (ORDER BY pos) AS BIGINT) AS id FROM wz),
st(cl, m) AS (
  SELECT list({{'id': id, 'w': 1, 'x': x, 'ids': [id], 'h': 0.0::DOUBLE}} ORDER BY id),
         NULL::STRUCT(l BIGINT, r BIGINT, rise DOUBLE, w INTEGER) FROM wr
  UNION ALL
  SELECT list_sort(list_filter(cl, lambda c: c.id <> cl[p.i].id AND c.id <> cl[p.j].id) || [{{
           'id': cl[p.i].id, 'w': cl[p.i].w + cl[p.j].w, 'x': list_transform(range(1, len(cl[p.i].x) + 1), lambda t:
             (cl[p.i].w * cl[p.i].x[t] + cl[p.j].w * cl[p.j].x[t]) / (cl[p.i].w + cl[p.j].w)),
           'ids': cl[p.i].ids || cl[p.j].ids, 'h': sqrt(p.rise)}}]),
         {{'l': cl[p.i].id, 'r': cl[p.j].id, 'rise': p.rise, 'w': cl[p.i].w + cl[p.j].w}}
  FROM (SELECT cl, {_PAIR_SQL} AS p FROM st WHERE len(cl) > 1))"""


@query(
    "ward_merges",
    f"WITH RECURSIVE {WARD} SELECT m.l AS \"left\", m.r AS \"right\", {r('sqrt(m.rise)', 'height')}, "
    "CAST(m.w AS BIGINT) AS size FROM st WHERE m IS NOT NULL",
)
def ward_merges(spark: SparkSession, d: str) -> DataFrame:
    """The merge table of the weekday tree: clusters are named by their first weekday, Sunday being 1."""
    merges, _ = ward.ward_merges(_weekdays(spark, d), "weekday", WEEKDAY_COLUMNS, _sunday_first())
    return merges.drop("round")


@query(
    "ward_weekdays",
    f"""WITH RECURSIVE {WARD}, last AS (SELECT cl FROM st WHERE len(cl) = 2),
cut AS (SELECT CAST(i AS INT) AS cluster, cl[i].h AS height, unnest(cl[i].ids) AS id FROM (
  SELECT cl, unnest(range(1, 3)) AS i FROM last))
SELECT weekday, {rs('avg_traffic', 'avg_energy')}, cluster, {r('height', 'height')} FROM cut JOIN wr ON cut.id = wr.id""",
)
def ward_weekdays(spark: SparkSession, d: str) -> DataFrame:
    """Two groups of weekdays."""
    weekdays = _weekdays(spark, d)
    labels = ward.ward_cut(weekdays, "weekday", WEEKDAY_COLUMNS, k=2, order=_sunday_first())
    return weekdays.select("weekday", "avg_traffic", "avg_energy").join(labels, "weekday")


def components(spark: SparkSession, d: str) -> cluster.PrincipalComponents:
    master = a.hourly(spark, d).withColumn("is_weekend", F.col("is_weekend").cast("int"))
    return cluster.PrincipalComponents(
        materialize(master.select("timestamp", *PCA_COLUMNS), "pca"), PCA_COLUMNS
    )


@query("pca_variance")
def pca_variance(spark: SparkSession, d: str) -> DataFrame:
    return components(spark, d).variance()


@query("pca_loadings")
def pca_loadings(spark: SparkSession, d: str) -> DataFrame:
    return components(spark, d).loadings()


@query("pca_scores")
def pca_scores(spark: SparkSession, d: str) -> DataFrame:
    return components(spark, d).scores(["timestamp", "is_weekend"])


# --- silhouettes -----------------------------------------------------------------------------

_SIL_COLUMNS = ["kwh", "cost", "renewable"]


def _daily_points(spark: SparkSession, d: str) -> DataFrame:
    days = rollup.energy_hourly(a.energy_daily(spark, d)).select(
        "timestamp",
        F.col("total_energy_kwh").alias("kwh"),
        F.col("total_cost").alias("cost"),
        F.col("avg_renewable_percent").alias("renewable"),
    )
    scaled = standardize(materialize(days, "days"), _SIL_COLUMNS, suffix="")
    return scaled.withColumn("cluster", F.quarter("timestamp"))


@query(
    "silhouette_exact",
    f"""WITH {a.ENERGY_DAILY}, day AS (
  SELECT timestamp, sum(energy_consumption_kwh) AS kwh, sum(cost_usd) AS cost,
         avg(renewable_percent) AS renewable FROM energy_daily GROUP BY timestamp),
z AS (SELECT timestamp, quarter(timestamp) AS c, {', '.join(
    f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}' for c in _SIL_COLUMNS)}
  FROM day),
pd AS (
  SELECT p.timestamp, p.c AS own, q.c AS other,
         sum(sqrt({' + '.join(f'power(p.{c} - q.{c}, 2)' for c in _SIL_COLUMNS)})) AS s,
         count(*) AS n
  FROM z p, z q GROUP BY 1, 2, 3),
ab AS (
  SELECT timestamp, own, max(CASE WHEN own = other THEN n END) AS n,
         max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a,
         min(CASE WHEN own <> other THEN s / n END) AS b
  FROM pd GROUP BY 1, 2)
SELECT timestamp, own AS cluster,
       {r('CASE WHEN n = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END',
          'silhouette')}
FROM ab""",
)
def silhouette_exact(spark: SparkSession, d: str) -> DataFrame:
    """Daily energy rows, clustered by calendar quarter."""
    return cluster.silhouettes(_daily_points(spark, d), "timestamp", _SIL_COLUMNS, "cluster")


def _mean_silhouette(clustered: DataFrame, key: str, columns: list[str]) -> DataFrame:
    scaled = standardize(materialize(clustered, "clustered"), columns)
    scores = cluster.silhouettes(scaled, key, [f"{c}_z" for c in columns], "cluster")
    mean = cluster.mean_silhouette(scores)
    return mean.withColumn("structure", silhouette_band(F.col("silhouette")))


@query("silhouette_kmeans")
def silhouette_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Mean silhouette and verdict of the hour (k = 4) and the day (k = 3) clustering."""
    hours = _mean_silhouette(clustered_hours(spark, d), "hour", HOUR_COLUMNS)
    days = _mean_silhouette(clustered_days(spark, d), "date", DAY_COLUMNS)
    return hours.withColumn("clustering", F.lit("hours")).unionByName(
        days.withColumn("clustering", F.lit("days"))
    )


@query("silhouette_by_k")
def silhouette_by_k(spark: SparkSession, d: str) -> DataFrame:
    """Mean silhouette for k = 2..8; the first k at the maximum is marked best."""
    data = cluster.scaled_features(hour_profile(spark, d), HOUR_COLUMNS)
    return cluster.silhouette_by_k(data, "hour", HOUR_COLUMNS, range(2, 9))


@query("silhouette_linear_by_k")
def silhouette_linear_by_k(spark: SparkSession, d: str) -> DataFrame:
    """The same sweep by squared distances, over the days."""
    data = cluster.scaled_features(day_profile(spark, d), DAY_COLUMNS)
    return cluster.silhouette_by_k(data, "date", DAY_COLUMNS, range(2, 9), linear=True)


@query(
    "silhouette_linear",
    f"""WITH {a.ENERGY_DAILY}, day AS (
  SELECT timestamp, sum(energy_consumption_kwh) AS kwh, sum(cost_usd) AS cost,
         avg(renewable_percent) AS renewable FROM energy_daily GROUP BY timestamp),
z AS (SELECT timestamp, quarter(timestamp) AS c, {', '.join(
    f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}' for c in _SIL_COLUMNS)}
  FROM day),
pd AS (
  SELECT p.timestamp, p.c AS own, q.c AS other, sum({' + '.join(f'power(p.{c} - q.{c}, 2)' for c in _SIL_COLUMNS)}) AS s,
         count(*) AS n
  FROM z p, z q GROUP BY 1, 2, 3),
ab AS (
  SELECT timestamp, own, max(CASE WHEN own = other THEN n END) AS n,
         max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a,
         min(CASE WHEN own <> other THEN s / n END) AS b
  FROM pd GROUP BY 1, 2)
SELECT timestamp, own AS cluster,
       {r('CASE WHEN n = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END', 'silhouette')}
FROM ab""",
)
def silhouette_linear(spark: SparkSession, d: str) -> DataFrame:
    """Daily energy rows, clustered by calendar quarter, scored by squared distances."""
    return cluster.linear_silhouettes(_daily_points(spark, d), "timestamp", _SIL_COLUMNS, "cluster")


def _standing(clustered: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Rows that lie nearer to another cluster's mean than to their own, in standardised units."""
    z = standardize(materialize(clustered, "clustered"), columns)
    scaled = [F.coalesce(F.col(f"{c}_z"), F.lit(0.0)) for c in columns]
    rows = z.select("cluster", F.array(*scaled).alias("x"))
    means = rows.groupBy("cluster").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(len(columns))]).alias("m"))
    packed = means.agg(F.collect_list(F.struct("cluster", "m")).alias("_means"))
    gaps = F.transform("_means", lambda c: F.struct(tree.distance(F.col("x"), c["m"], len(columns)).alias("gap"), c["cluster"].alias("c")))
    judged = with_scalars(rows, packed).select("cluster", gaps.alias("_gaps"))
    own = F.filter("_gaps", lambda g: g["c"] == F.col("cluster"))[0]["gap"]
    least = F.array_min(F.transform("_gaps", lambda g: g["gap"]))
    return judged.agg(
        F.lit(name).alias("clustering"), F.count(F.lit(1)).alias("rows"), F.count_distinct("cluster").alias("clusters"),
        F.count_if(own > least + 1e-7).alias("misplaced"),
    )


@query(
    "kmeans_standing",
    f"""WITH {a.HOURLY}, hp AS (
  SELECT hour, avg(total_vehicles) AS t, avg(avg_AQI) AS q, avg(total_energy_kwh) AS e FROM hourly GROUP BY hour),
dp AS (
  SELECT CAST(timestamp AS DATE) AS date, sum(total_vehicles) AS t, avg(avg_AQI) AS q, sum(total_energy_kwh) AS e
  FROM hourly GROUP BY 1)
SELECT 'hours' AS clustering, count(*) AS rows, 4 AS clusters, 0 AS misplaced FROM hp
WHERE t IS NOT NULL AND q IS NOT NULL AND e IS NOT NULL
UNION ALL SELECT 'days', count(*), 3, 0 FROM dp WHERE t IS NOT NULL AND q IS NOT NULL AND e IS NOT NULL""",
)
def kmeans_standing(spark: SparkSession, d: str) -> DataFrame:
    """Both clusterings are fixed points: all rows are at their nearest cluster mean."""
    hours = _standing(clustered_hours(spark, d), HOUR_COLUMNS, "hours")
    return hours.unionByName(_standing(clustered_days(spark, d), DAY_COLUMNS, "days"))


@query(
    "pca_invariants",
    f"""WITH {a.HOURLY}, c AS (
  SELECT {', '.join(f'CAST({c} AS DOUBLE) AS v{i}' for i, c in enumerate(PCA_COLUMNS))} FROM hourly
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in PCA_COLUMNS)})
SELECT CAST({len(PCA_COLUMNS)} AS DOUBLE) AS total_variance,
       {r(' + '.join(f'power(corr(v{i}, v{j}), 2)' for i in range(len(PCA_COLUMNS)) for j in range(len(PCA_COLUMNS))), 'squared_variance')},
       true AS orthonormal FROM c""",
)
def pca_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Trace and squared norm of the correlation matrix from the components, which must be orthonormal."""
    found = components(spark, d)
    variance = found.variance().agg(
        F.sum(F.pow("sd", F.lit(2.0))).alias("total_variance"), F.sum(F.pow("sd", F.lit(4.0))).alias("squared_variance")
    )
    loadings = found.loadings()
    other = loadings.select("variable", F.col("component").alias("other"), F.col("loading").alias("_l"))
    dots = loadings.join(other, "variable").groupBy("component", "other").agg(F.sum(F.col("loading") * F.col("_l")).alias("_dot"))
    unit = F.abs(F.col("_dot") - (F.col("component") == F.col("other")).cast("int")) < 1e-9
    return with_scalars(variance, dots.agg(F.every(unit).alias("orthonormal")))


# --- smoothing -------------------------------------------------------------------------------

_Q = "greatest(CAST(floor(n * 0.75 + 1e-5) AS BIGINT), 1)"


def _loess_sql(rows: str) -> str:
    return f"""{rows},
sp AS (SELECT series, min(x) AS lo, max(x) AS hi, count(*) AS n FROM pts GROUP BY series),
pl AS (
  SELECT p.series, y, lo, hi, n, g.grid, (x - lo) / (hi - lo) - g.grid / 79.0::DOUBLE AS d
  FROM pts p JOIN sp ON p.series = sp.series,
       (SELECT unnest(range(0, 80)) AS grid) g WHERE hi > lo),
rk AS (
  SELECT *, row_number() OVER (PARTITION BY series, grid ORDER BY abs(d)) AS rn FROM pl),
bw AS (SELECT series, grid, min(abs(d)) AS h FROM rk WHERE rn = {_Q} GROUP BY 1, 2),
wt AS (
  SELECT pl.*, CASE WHEN abs(d) / h < 1 THEN power(1 - power(abs(d) / h, 3), 3) ELSE 0 END AS w
  FROM pl JOIN bw ON pl.series = bw.series AND pl.grid = bw.grid),
sm AS (
  SELECT series, grid, lo, hi, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2,
         sum(w * power(d, 3)) AS s3, sum(w * power(d, 4)) AS s4, sum(w * y) AS t0,
         sum(w * d * y) AS t1, sum(w * d * d * y) AS t2
  FROM wt GROUP BY 1, 2, 3, 4)
SELECT series, grid, {r('lo + (hi - lo) * grid / 79', 'x0')},
  {r('''(t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2))
    / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2))''',
     'fitted')}
FROM sm"""


@query(
    "loess_trend",
    f"WITH {a.HOURLY}, pts AS (SELECT 'aqi' AS series, epoch(timestamp) AS x, avg_AQI AS y "
    + _loess_sql("FROM hourly WHERE avg_AQI IS NOT NULL)"),
)
def loess_trend(spark: SparkSession, d: str) -> DataFrame:
    """Smoothed AQI over time."""
    master = a.hourly(spark, d)
    seconds = F.unix_timestamp("timestamp")
    return smooth.local_regression(master, seconds, F.col("avg_AQI"), by=F.lit("aqi"))


_FACETS = ["total_vehicles", "avg_AQI", "total_energy_kwh", "temperature"]


@query(
    "loess_facets",
    f"WITH {a.HOURLY}, pts AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS series, CAST(hour AS DOUBLE) AS x, {c} AS y FROM hourly "
        f"WHERE {c} IS NOT NULL"
        for c in _FACETS
    )
    + _loess_sql(")"),
)
def loess_facets(spark: SparkSession, d: str) -> DataFrame:
    """Each variable smoothed over the hour of day."""
    long = long_form(a.hourly(spark, d), _FACETS, ["hour"])
    return smooth.local_regression(
        long, F.col("hour"), F.col("value"), by=F.col("variable")
    )
