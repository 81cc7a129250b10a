"""Ward's agglomeration by rounds of mutual nearest pairs.

Clusters are rows of (representative, size, centroid).  In every round each cluster finds its
nearest one by the rise in the within-cluster sum of squares, and all pairs that are nearest to each
other merge at once.  Ward's rise is reducible (a merged cluster is no nearer to a third one than the
nearer of its parts), hence these are the merges that one-at-a-time agglomeration makes, in another
order.  Nearest clusters are found by descending a partition tree whose bounds take the sizes into
account; no task holds more than pairs of leaves and no distance matrix exists.

The number of rounds is about the logarithm of the number of rows, more for chains of ever
growing gaps, where one pair merges per round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.functions.clean import complete_cases
from sensorspark.operators import tree
from sensorspark.operators.density import connected_components
from sensorspark.operators.sequence import with_row_id
from sensorspark.operators.stats import standardize
from sensorspark.session import broadcast_if_small, materialize, materialize_observed


def _rise(size_a: Column, size_b: Column, squared: Column) -> Column:
    """Twice the rise in the sum of squares; for single rows the squared distance."""
    return 2.0 * size_a * size_b / (size_a + size_b) * squared


def _squared(x: Column, y: Column, dims: int) -> Column:
    total = (x[0] - y[0]) * (x[0] - y[0])
    for i in range(1, dims):
        total = total + (x[i] - y[i]) * (x[i] - y[i])
    return total


def _lowest(dims: int) -> Column:
    gap = tree.near(dims)
    return _rise(F.col("q_box.w_min"), F.col("r_box.w_min"), gap * gap) * (1 - 1e-12)


def _highest(dims: int) -> Column:
    gap = tree.far(dims)
    return _rise(F.col("q_box.w_max"), F.col("r_box.w_max"), gap * gap) * (1 + 1e-12)


def _nearest_pairs(clusters: DataFrame, dims: int, count: int) -> DataFrame:
    """(id, rise, low, high): for every cluster the pair it makes with its nearest one.

    Equal rises are ordered by the pair's smaller and larger representative, so that the two ends of
    a pair agree and the least pair of all always merges.
    """
    boxes = tree.Tree(clusters, dims, count).boxes()
    leaves = tree.neighbour_leaves(boxes, 2, "n", _lowest, _highest)
    others = F.filter("r_members", lambda m: m["id"] != F.col("p.id"))
    offers = F.transform(
        others,
        lambda m: F.struct(
            _rise(F.col("p.w"), m["w"], _squared(F.col("p.x"), m["x"], dims)).alias("rise"),
            F.least(F.col("p.id"), m["id"]).alias("low"),
            F.greatest(F.col("p.id"), m["id"]).alias("high"),
        ),
    )
    met = tree.meet(leaves, boxes, boxes).select("p.id", F.array_min(offers).alias("_best"))
    best = met.groupBy("id").agg(F.min("_best").alias("_best"))
    return best.select("id", "_best.*")


def ward_merges(df: DataFrame, key: str, columns: list[str], order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(merges, rows): the tree of the standardised rows complete in ``columns``.

    ``merges`` has left, right, height, size and round: the clusters whose first rows (in ``order``,
    numbered from 1) are left and right become one of ``size`` rows, named left from then on.
    ``rows`` has key and row_id.
    """
    dims = len(columns)
    z = [f"{c}_z" for c in columns]
    scaled = standardize(complete_cases(df, columns), columns).select(
        F.col(key).alias("_key"),
        (F.col(key) if order is None else order).alias("_order"),
        # A constant column carries no information; its undefined z-score counts as zero.
        F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in z]).alias("x"),
    )
    rows = with_row_id(scaled, ["_order", "_key"], "ward-rows")
    single = rows.select(F.col("row_id").alias("id"), "x", F.lit(1).cast("long").alias("w"))
    number = F.count(F.lit(1))
    clusters, seen = materialize_observed(single, "clusters", count=number)
    spark = df.sparkSession
    merges = spark.createDataFrame([], "left long, right long, height double, size long, round int")
    turn = 0
    while seen["count"] > 1:
        best = _nearest_pairs(clusters, dims, seen["count"])
        turn += 1
        mutual = best.groupBy("low", "high").agg(F.count(F.lit(1)).alias("_ends"), F.min("rise").alias("rise"))
        pairs = materialize(mutual.where(F.col("_ends") == 2).select("low", "high", "rise"), "mutual")
        ends = pairs.select("low", "rise", F.explode(F.array("low", "high")).alias("id"))
        joined = clusters.join(ends, "id", "left").select(
            F.coalesce("low", "id").alias("id"), "x", "w", "rise"
        )
        parts = joined.groupBy("id").agg(
            F.sum("w").alias("w"),
            F.array(*[F.sum(F.col("w") * F.col("x")[i]) / F.sum("w") for i in range(dims)]).alias("_mean"),
            F.first("x").alias("_x"),
            F.max("rise").alias("rise"),
        )
        # A cluster that did not merge keeps its centroid bit for bit.
        centre = F.when(F.col("rise").isNull(), F.col("_x")).otherwise(F.col("_mean"))
        clusters, seen = materialize_observed(parts.select("id", centre.alias("x"), "w"), "clusters", count=number)
        done = pairs.join(clusters.select(F.col("id").alias("low"), "w"), "low").select(
            F.col("low").alias("left"), F.col("high").alias("right"), F.sqrt("rise").alias("height"),
            F.col("w").alias("size"), F.lit(turn).alias("round"),
        )
        merges = merges.unionByName(done)
    return merges, rows.select(F.col("_key").alias(key), "row_id")


def ward_cut(df: DataFrame, key: str, columns: list[str], k: int = 2, order: Column | None = None) -> DataFrame:
    """The tree cut into ``k`` clusters: ``key``, ``cluster`` and the height at which it was closed.

    Clusters are numbered as they first appear in ``order``.
    """
    merges, rows = ward_merges(df, key, columns, order)
    merges, seen = materialize_observed(merges, "merges", count=F.count(F.lit(1)))
    kept = merges
    if k > 1:
        # The k - 1 last merges are undone; of equal heights the later round holds the earlier one.
        last = merges.orderBy(F.desc("height"), F.desc("round"), "left").limit(min(k - 1, seen["count"])).select("right")
        kept = merges.join(F.broadcast(last), "right", "left_anti")
    links = kept.select(F.col("left").alias("src"), F.col("right").alias("dst"))
    named = connected_components(rows.select(F.col("row_id").alias("v")), links)
    closed = kept.join(named, F.col("left") == F.col("v")).groupBy("component").agg(F.max("height").alias("height"))
    # At most k clusters.
    numbers = with_row_id(named.select("component").distinct(), ["component"], "numbers").select(
        "component", F.col("row_id").cast("int").alias("cluster")
    )
    labelled = named.join(broadcast_if_small(materialize(numbers, "numbers")), "component").join(closed, "component", "left")
    return rows.join(labelled, F.col("row_id") == F.col("v")).select(
        key, "cluster", F.coalesce("height", F.lit(0.0)).alias("height")
    )
