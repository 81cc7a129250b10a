"""k-means with restarts, elbow, cluster labels, PCA and silhouettes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.functions.clean import complete_cases
from sensorspark.operators.kmeans import STARTS, Fit, best_fits
from sensorspark.operators.stats import standardize
from sensorspark.operators.tree import distance
from sensorspark.session import broadcast_if_small, default_tasks, materialize, materialize_observed, with_scalars

# The hours that make up the named parts of a day.
HOUR_LABELS = [
    ("Night (Low Activity)", [0, 1, 2, 3, 4, 5, 23]),
    ("Morning Rush", [6, 7, 8, 9, 10]),
    ("Midday", [11, 12, 13, 14, 15, 16]),
    ("Evening Rush", [17, 18, 19, 20, 21, 22]),
]


def scaled_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows complete in ``columns``, written with a standardised ``features`` array."""
    scaled = standardize(complete_cases(df, columns), columns)
    z = [f"{c}_z" for c in columns]
    # A constant column carries no information; its undefined z-score counts as zero.
    features = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in z])
    return materialize(scaled.withColumn("features", features).drop(*z), "features")


def best_kmeans(data: DataFrame, ks: list[int], starts: int = STARTS, seed: int = 123) -> dict[int, Fit]:
    """For each k the best of ``starts`` seeded fits, all of them advanced together."""
    return best_fits(data, F.col("features"), ks, starts, seed)


def total_sum_of_squares(data: DataFrame) -> DataFrame:
    """Cost of a single cluster: the squared distance to the mean, from sums alone."""
    exploded = data.select(F.posexplode("features").alias("_dim", "_v"))
    per_dim = exploded.groupBy("_dim").agg(
        (F.var_pop("_v") * F.count(F.lit(1))).alias("_ss")
    )
    return per_dim.agg(F.sum("_ss").alias("wss")).select(F.lit(1).alias("k"), "wss")


def elbow(data: DataFrame, ks: range = range(1, 9), starts: int = STARTS) -> DataFrame:
    """(k, wss): within-cluster sum of squares of the best fit; k = 1 needs no fit."""
    models = best_kmeans(data, [k for k in ks if k > 1], starts)
    costs = [(k, fit.cost) for k, fit in sorted(models.items())]
    fitted = data.sparkSession.createDataFrame(costs, "k int, wss double")
    return total_sum_of_squares(data).unionByName(fitted) if 1 in ks else fitted


def with_clusters(data: DataFrame, model: Fit, order_by: str) -> DataFrame:
    """Add ``cluster`` 1..k, numbered by the ascending cluster mean of ``order_by``.

    The model's own ids are arbitrary.  The renumbering table has k rows.
    """
    assigned = data.withColumn("_raw", model.assign(F.col("features")))
    means = assigned.groupBy("_raw").agg(F.avg(order_by).alias("_mean"))
    ranked = means.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_mean", "_raw"))), lambda s: s["_raw"]
        ).alias("_order")
    )
    placed = with_scalars(assigned, ranked)
    return placed.withColumn(
        "cluster", F.array_position("_order", F.col("_raw")).cast("int")
    ).drop("_raw", "_order", "features")


def hour_cluster_summary(clustered: DataFrame) -> DataFrame:
    """Per cluster: its hours, mean measures and a label; clusters are ordered by traffic.

    A profile has at most 24 rows, which bounds the collected hours.
    """
    hours = F.array_sort(F.collect_set("hour"))
    summary = clustered.groupBy("cluster").agg(
        hours.alias("_hours"),
        F.avg("avg_traffic").alias("avg_traffic"),
        F.avg("avg_aqi").alias("avg_aqi"),
        F.avg("avg_energy").alias("avg_energy"),
    )
    label: Column | None = None
    for name, members in HOUR_LABELS:
        inside = F.size(F.array_except("_hours", F.array(*[F.lit(h) for h in members]))) == 0
        label = F.when(inside, name) if label is None else label.when(inside, name)
    pattern = F.concat(F.lit("Pattern "), F.col("cluster").cast("string"))
    return summary.select(
        "cluster",
        F.array_join(F.transform("_hours", lambda h: h.cast("string")), ", ").alias("hours"),
        "avg_traffic",
        "avg_aqi",
        "avg_energy",
        label.otherwise(pattern).alias("label"),
    )


def day_cluster_summary(clustered: DataFrame) -> DataFrame:
    summary = clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_days"),
        (F.avg(F.col("is_weekend").cast("int")) * 100).alias("pct_weekend"),
        F.avg("total_traffic").alias("avg_traffic"),
        F.avg("avg_aqi").alias("avg_aqi"),
        F.avg("total_energy").alias("avg_energy"),
    )
    ends = summary.agg(F.max("avg_traffic").alias("_hi"), F.min("avg_traffic").alias("_lo"))
    traffic = F.col("avg_traffic")
    return (
        with_scalars(summary, ends)
        .withColumn(
            "label",
            F.when(traffic == F.col("_hi"), "High Activity Days")
            .when(traffic == F.col("_lo"), "Low Activity Days")
            .otherwise("Moderate Activity Days"),
        )
        .drop("_hi", "_lo")
    )


# --- principal components --------------------------------------------------------------------


class PrincipalComponents:
    """PCA on standardised columns; each component's largest loading is made positive."""

    def __init__(self, df: DataFrame, columns: list[str]):
        self.columns = columns
        rows = complete_cases(df, columns)
        raw = VectorAssembler(inputCols=columns, outputCol="_raw").transform(
            rows.withColumns({c: F.col(c).cast("double") for c in columns})
        )
        scaler = StandardScaler(
            withMean=True, withStd=True, inputCol="_raw", outputCol="features"
        ).fit(raw)
        self.data = scaler.transform(raw).drop("_raw")
        self.model = PCA(k=len(columns), inputCol="features", outputCol="_pc").fit(self.data)
        # A columns × columns matrix, however long the table is.
        loadings = self.model.pc.toArray()
        strongest = np.abs(loadings).argmax(axis=0)
        self.signs = np.where(loadings[strongest, range(len(columns))] < 0, -1.0, 1.0)
        self._loadings = loadings * self.signs

    def variance(self) -> DataFrame:
        """(component, sd, proportion, cumulative)."""
        shares = self.model.explainedVariance.toArray()
        running = np.cumsum(shares)
        rows = [
            (i + 1, math.sqrt(max(p, 0.0) * len(self.columns)), float(p), float(c))
            for i, (p, c) in enumerate(zip(shares, running))
        ]
        return self.data.sparkSession.createDataFrame(
            rows, "component int, sd double, proportion double, cumulative double"
        )

    def loadings(self) -> DataFrame:
        """(variable, component, loading)."""
        rows = [
            (name, j + 1, float(self._loadings[i, j]))
            for i, name in enumerate(self.columns)
            for j in range(len(self.columns))
        ]
        return self.data.sparkSession.createDataFrame(
            rows, "variable string, component int, loading double"
        )

    def scores(self, keep: list[str], components: int = 2) -> DataFrame:
        pc = vector_to_array("_pc")
        return self.model.transform(self.data).select(
            *keep, *[(pc[i] * float(self.signs[i])).alias(f"PC{i + 1}") for i in range(components)]
        )


# --- distances and silhouettes ---------------------------------------------------------------


def pairwise_distances(df: DataFrame, key: str, columns: list[str], block_rows: int = 256) -> DataFrame:
    """(i, j, distance): Euclidean distances between all rows, each pair once (i < j).

    The result is quadratic by definition and meant for profiles.  Rows are hashed on their unique
    key into even blocks of about ``block_rows``; every pair of blocks meets once, as two packed rows,
    so that no row of the work holds more than two blocks.
    """
    dims = len(columns)
    rows = df.select(F.col(key).alias("i"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    rows, seen = materialize_observed(rows, "pairwise", count=F.count(F.lit(1)))
    blocks = max(1, math.ceil(seen["count"] / block_rows))
    block = F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int")
    packed = materialize(
        rows.groupBy(block.alias("a")).agg(F.collect_list(F.struct("i", "x")).alias("left")), "blocks"
    )
    # Block a meets the blocks from a on: for each of them one row, joined on its number.
    first = packed.withColumn("b", F.explode(F.sequence("a", F.lit(blocks - 1))))
    second = packed.select(F.col("a").alias("b"), F.col("left").alias("right"))
    met = first.join(second, "b").select("a", "b", F.explode("left").alias("p"), "right")
    other = met.select("a", "b", "p", F.explode("right").alias("q"))
    once = (F.col("a") < F.col("b")) | (F.col("p.i") < F.col("q.i"))
    return other.where(once).select(
        F.least("p.i", "q.i").alias("i"),
        F.greatest("p.i", "q.i").alias("j"),
        distance(F.col("p.x"), F.col("q.x"), dims).alias("distance"),
    )


def silhouettes(
    df: DataFrame,
    key: str,
    columns: list[str],
    cluster: str,
    by: str | None = None,
    block_rows: int = 256,
) -> DataFrame:
    """Exact Euclidean silhouette per row: (``by``,) ``key``, ``cluster``, ``silhouette``.

    The score needs every distance, so its cost is quadratic by definition; it is meant for profile
    tables (one row per hour of day or per day).  Distances are never emitted: rows are hashed into
    blocks of about ``block_rows``, each block travels as a few packed rows (one per cluster), and
    a (row, block) pair only yields a sum per cluster.  Hashing on the unique key keeps blocks
    even, whatever the cluster sizes.  ``by`` scores several clusterings of one table at once.
    """
    points = materialize(
        df.select(
            (F.lit(0) if by is None else F.col(by)).alias("_by"),
            F.col(key).alias("_id"),
            F.col(cluster).alias("_own"),
            F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"),
        ),
        "points",
    )
    n_blocks = max(1, math.ceil(points.count() / block_rows))
    block = F.pmod(F.xxhash64("_by", "_id"), F.lit(n_blocks)).cast("int")
    packed = materialize(
        points.groupBy("_by", block.alias("_block"), F.col("_own").alias("_cluster")).agg(
            F.collect_list("_x").alias("_members")
        ),
        "blocks",
    )
    # The table is small in bytes but each row costs n distances, hence the explicit spread.
    spread = points.repartition(max(n_blocks, default_tasks(points)), "_id").withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    )
    dims = len(columns)
    partial = F.aggregate(
        "_members", F.lit(0.0), lambda acc, y: acc + distance(F.col("_x"), y, dims)
    )
    sums = (
        spread.join(broadcast_if_small(packed, 4096), ["_by", "_block"])
        .groupBy("_by", "_id", "_own", "_cluster")
        .agg(F.sum(partial).alias("_sum"))
    )
    sizes = points.groupBy("_by", F.col("_own").alias("_cluster")).agg(
        F.count(F.lit(1)).alias("_size")
    )
    # One row per cluster and clustering.
    sized = sums.join(F.broadcast(sizes), ["_by", "_cluster"])
    mine = F.col("_cluster") == F.col("_own")
    scored = sized.groupBy("_by", "_id", "_own").agg(
        F.max(F.when(mine, F.col("_size"))).alias("_n"),
        F.max(F.when(mine, F.try_divide(F.col("_sum"), F.col("_size") - 1))).alias("_a"),
        F.min(F.when(~mine, F.col("_sum") / F.col("_size"))).alias("_b"),
    )
    a, b = F.col("_a"), F.col("_b")
    score = F.when(F.col("_n") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))
    )
    return scored.select(
        *([] if by is None else [F.col("_by").alias(by)]),
        F.col("_id").alias(key),
        F.col("_own").alias(cluster),
        score.alias("silhouette"),
    )


def linear_silhouettes(df: DataFrame, key: str, columns: list[str], cluster: str, by: str | None = None) -> DataFrame:
    """Silhouette by mean squared distances: (``by``,) ``key``, ``cluster``, ``silhouette``.

    The mean squared distance of a row to a cluster follows from the cluster's size, mean and mean
    squared length, so the score takes one aggregate and a look at k rows; nothing is quadratic.  x is
    measured from the mean of the whole table, which keeps the differences of squares accurate.
    """
    centred = with_scalars(df, df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns]))
    points = centred.select(
        (F.lit(0) if by is None else F.col(by)).alias("_by"),
        F.col(key).alias("_id"),
        F.col(cluster).alias("_own"),
        F.array(*[F.col(c).cast("double") - F.col(f"_m_{c}") for c in columns]).alias("_x"),
    )
    x, dims = F.col("_x"), range(len(columns))

    def dot(a: Column, b: Column) -> Column:
        total = a[0] * b[0]
        for i in dims[1:]:
            total = total + a[i] * b[i]
        return total

    sums = points.groupBy("_by", F.col("_own").alias("_cluster")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(x[i]) for i in dims]).alias("mean"),
        F.avg(dot(x, x)).alias("length"),
    )
    # One row per cluster, packed per clustering.
    packed = sums.groupBy("_by").agg(F.collect_list(F.struct("_cluster", "n", "mean", "length")).alias("_all"))
    joined = points.join(F.broadcast(packed), "_by")
    gaps = F.transform(
        "_all",
        lambda c: F.struct(
            c["_cluster"].alias("c"), c["n"].alias("n"),
            F.greatest(dot(x, x) - 2 * dot(x, c["mean"]) + c["length"], F.lit(0.0)).alias("gap"),
        ),
    )
    scored = joined.withColumn("_gaps", gaps).select(
        "_by", "_id", "_own",
        F.filter("_gaps", lambda g: g["c"] == F.col("_own"))[0].alias("_mine"),
        F.array_min(F.transform(F.filter("_gaps", lambda g: g["c"] != F.col("_own")), lambda g: g["gap"])).alias("_b"),
    )
    n, b = F.col("_mine.n"), F.col("_b")
    a = F.try_divide(F.col("_mine.gap") * n, n - 1)
    score = F.when(n == 1, 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return scored.select(
        *([] if by is None else [F.col("_by").alias(by)]),
        F.col("_id").alias(key), F.col("_own").alias(cluster), score.alias("silhouette"),
    )


def mean_silhouette(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("silhouette").alias("silhouette"))


def silhouette_by_k(
    data: DataFrame, key: str, columns: list[str], ks: range, starts: int = STARTS, linear: bool = False
) -> DataFrame:
    """(k, silhouette, is_best): all clusterings are scored together, as one long table."""
    models = best_kmeans(data, list(ks), starts)
    assigned = F.array(
        *[F.struct(F.lit(k).alias("k"), fit.assign(F.col("features")).alias("cluster")) for k, fit in models.items()]
    )
    z = [f"{c}_z" for c in columns]
    scaled = [F.col("features")[i].alias(c) for i, c in enumerate(z)]
    long = data.select(key, *scaled, F.inline(assigned))
    scores = (linear_silhouettes if linear else silhouettes)(long, key, z, "cluster", by="k")
    means = scores.groupBy("k").agg(F.avg("silhouette").alias("silhouette"))
    best = means.agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("_best"))
    return (
        with_scalars(means, best).withColumn("is_best", F.col("k") == F.col("_best")).drop("_best")
    )
