"""Connected components of link tables whose size is checked before anything is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorspark.session import materialize

# Rows of (vertex, label) that may be broadcast.
SMALL_ROWS = 200_000


def components(links: DataFrame) -> DataFrame:
    """(v, component) for the ends of undirected (src, dst) links: the smallest end reachable.

    Every round takes the smallest label among a vertex and its neighbours, combined before the
    shuffle so that a hub is one row per task, and then the label of that label.  The links carry a
    loop at each end, hence a round shuffles once while the labels are few enough to be broadcast.
    """
    ends = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = materialize(
        ends.unionByName(ends.select("src", F.col("src").alias("dst"))).distinct(), "component-links"
    )
    labels = materialize(both.groupBy(F.col("src").alias("v")).agg(F.min("dst").alias("component")), "labels")
    few = labels.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    while True:
        known = F.broadcast(labels) if few else labels
        taken = (
            both.join(known.withColumnRenamed("v", "src"), "src")
            .groupBy(F.col("dst").alias("v"))
            .agg(
                F.min("component").alias("component"),
                F.min(F.when(F.col("src") == F.col("dst"), F.col("component"))).alias("before"),
            )
        )
        jump = known.select(F.col("v").alias("component"), F.col("component").alias("further"))
        lowered = materialize(
            taken.join(jump, "component").select("v", F.least("component", "further").alias("component"), "before"),
            "labels",
        )
        labels = lowered.select("v", "component")
        if lowered.where(F.col("component") != F.col("before")).isEmpty():
            return labels
