"""Density operators over numeric columns: k-nearest-neighbour distance, DBSCAN, noise report.

Both searches descend a partition tree (``tree``) with pairs of nodes.  A pair that its boxes and
counts decide leaves as a whole; points are compared only within pairs of leaves.  Equal points are
one weighted point, so a value that fills a third of the table is searched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorspark.functions.clean import complete_cases
from sensorspark.operators import tree
from sensorspark.operators.sequence import with_row_id
from sensorspark.operators.stats import mean_sd_row
from sensorspark.operators.tree import distance
from sensorspark.session import broadcast_if_small, materialize, materialize_observed, with_scalars


def _point(columns: list[str]) -> Column:
    # Adding zero makes -0.0 and 0.0 one value.
    return F.array(*[F.col(c).cast("double") + 0.0 for c in columns])


def _weighted(df: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (id, x) complete in ``columns`` and their distinct points (x, w, smallest id)."""
    rows = materialize(
        complete_cases(df, columns).select(F.col(key).alias("id"), _point(columns).alias("x")), "rows"
    )
    return rows, rows.groupBy("x").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("id"))


# --- k-nearest-neighbour distance ------------------------------------------------------------


def knn_distance(df: DataFrame, key: str, columns: list[str], k: int = 4) -> DataFrame:
    """(key, distance): exact Euclidean distance to the k-th nearest other row.

    NULL where the table has no k other rows.
    """
    dims, wanted = len(columns), k + 1
    rows, points = _weighted(df, key, columns)
    boxes = tree.Tree(points.select("x", "w"), dims).boxes()
    leaves = tree.neighbour_leaves(boxes, wanted)
    gaps = F.transform(
        "r_members",
        lambda m: F.struct(distance(F.col("p.x"), m["x"], dims).alias("d"), m["w"].alias("w")),
    )
    # Every member weighs one row at least.
    met = tree.meet(leaves, boxes, boxes).select("p.x", F.slice(F.array_sort(gaps), 1, wanted).alias("_gaps"))
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(None).cast("double").alias("d"))

    def further(acc: Column, m: Column) -> Column:
        taken = F.struct((acc["held"] + m["w"]).alias("held"), m["d"].alias("d"))
        return F.when(acc["held"] >= wanted, acc).otherwise(taken)

    kth = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("_gaps"))),
        start,
        further,
        lambda acc: F.when(acc["held"] >= wanted, acc["d"]),
    )
    found = met.groupBy("x").agg(kth.alias("distance"))
    return rows.join(found, "x", "left").select(F.col("id").alias(key), "distance")


# --- connected components --------------------------------------------------------------------


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex id reachable over undirected (src, dst) edges.

    Each round takes the smallest of a vertex's label, its neighbours' labels (combined before the
    shuffle, so a hub costs one row per task) and the label of its label, which shortens remaining
    paths by half.  Most vertices of a giant component carry the same label; that join has one row
    per label on its other side, so adaptive execution broadcasts it or splits the hot label.
    """
    ends = edges.select("src", "dst")
    both = materialize(
        ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "edges"
    )
    loops = vertices.select(F.col("v").alias("src"), F.col("v").alias("dst"))
    labels = both.unionByName(loops).groupBy(F.col("src").alias("v")).agg(F.min("dst").alias("component"))
    labels = materialize(labels, "labels")
    while True:
        offered = (
            both.join(labels.withColumnRenamed("v", "src"), "src")
            .groupBy(F.col("dst").alias("v"))
            .agg(F.min("component").alias("_offer"))
        )
        jump = labels.select(F.col("v").alias("component"), F.col("component").alias("_jump"))
        lower = F.least("component", "_offer", "_jump")
        lowered, seen = materialize_observed(
            labels.join(offered, "v", "left")
            .join(jump, "component", "left")
            .select("v", lower.alias("component"), F.col("component").alias("_before")),
            "labels",
            changed=F.count_if(F.col("component") != F.col("_before")),
        )
        labels = lowered.select("v", "component")
        if not seen["changed"]:
            return labels


# --- DBSCAN ----------------------------------------------------------------------------------


def _core_points(boxes: tree.Boxes, eps: float, min_pts: int) -> DataFrame:
    """The tree's points with at least ``min_pts`` rows within ``eps``, themselves included.

    A node's sure weight is that of all nodes wholly within ``eps`` of all its points.  Once it
    reaches ``min_pts`` the node's points are core and its pairs leave.
    """
    dims, points = boxes.tree.dims, boxes.tree.points
    pairs = tree.root_pair(boxes).withColumn("base", F.lit(0).cast("long"))
    columns = points.columns
    sure = F.sum(F.when(F.col("_far") <= eps, F.col("_w"))).over(Window.partitionBy("q"))
    whole = None
    for level in range(boxes.tree.top - 1, -1, -1):
        judged = tree.split(pairs, boxes, boxes, level).select(
            "q", "r", "base", tree.near(dims).alias("_near"), tree.far(dims).alias("_far"), F.col("r_box.w").alias("_w")
        )
        counted = judged.where(F.col("_near") <= eps).withColumn("base", F.col("base") + F.coalesce(sure, F.lit(0)))
        written = materialize(counted, "core-pairs")
        dense = written.where(F.col("base") >= min_pts).select(F.lit(level).alias("level"), F.col("q").alias("node")).distinct()
        whole = dense if whole is None else whole.unionByName(dense)
        pairs = written.where((F.col("base") < min_pts) & (F.col("_far") > eps)).select("q", "r", "base")
    close = F.filter("r_members", lambda m: distance(F.col("p.x"), m["x"], dims) <= eps)
    weight = F.aggregate(close, F.lit(0).cast("long"), lambda acc, m: acc + m["w"])
    counted = (
        tree.meet(pairs, boxes, boxes)
        .select("p", F.col("q").alias("leaf"), "base", weight.alias("_w"))
        .groupBy("p", "leaf")
        .agg((F.max("base") + F.sum("_w")).alias("_w"))
        .where(F.col("_w") >= min_pts)
    )
    exact = counted.select("p.*", "leaf").select(*columns)
    if whole is None:
        return exact
    above = points.select("*", boxes.above())
    return above.join(whole, ["level", "node"], "left_semi").select(*columns).unionByName(exact)


def _vertices(boxes: tree.Boxes, core: DataFrame, eps: float) -> DataFrame:
    """Core points with their vertex ``v``: the smallest key of the largest node around them whose
    points all lie within ``eps`` of each other, or their own key."""
    solid = boxes.all.where(_solid("lo", "hi", boxes.tree.dims, eps)).select("level", "node", "v")
    up = solid.select((F.col("level") - 1).alias("level"), F.col("node").alias("_up"))
    parent = F.expr(f"node div {boxes.tree.fan}").alias("_up")
    largest = solid.select("level", "node", "v", parent).join(up, ["level", "_up"], "left_anti")
    held = core.select("*", boxes.above()).join(largest.select("level", "node", "v"), ["level", "node"], "left")
    return held.groupBy(*core.columns).agg(F.coalesce(F.min("v"), F.col("id")).alias("v"))


def _solid(lo: str, hi: str, dims: int, eps: float) -> Column:
    return tree.norm([F.col(hi)[i] - F.col(lo)[i] for i in range(dims)]) <= eps


def _core_links(boxes: tree.Boxes, eps: float) -> DataFrame:
    """(src, dst): vertices of core points that have points within ``eps`` of each other.

    A pair of solid nodes needs one link, whatever the number of its points, and leaves when it has
    one; where nodes are not solid, their points are vertices.
    """
    dims = boxes.tree.dims

    def vertex(side: str) -> Column:
        own = F.when(_solid(f"{side}_box.lo", f"{side}_box.hi", dims, eps), F.col(f"{side}_box.v"))
        return F.coalesce(f"{side}_v", own)

    def judge(expanded: DataFrame) -> DataFrame:
        named = expanded.select(
            "q", "r", vertex("q").alias("q_v"), vertex("r").alias("r_v"), tree.near(dims).alias("_near"), tree.far(dims).alias("_far")
        )
        # A null on one side means no solid node yet: such pairs go on.
        return named.where(
            (F.col("q") <= F.col("r")) & (F.col("_near") <= eps) & F.coalesce(F.col("q_v") != F.col("r_v"), F.lit(True))
        )

    nothing = F.lit(None).cast(dict(boxes.all.dtypes)["v"])
    pairs = tree.root_pair(boxes).withColumns({"q_v": nothing, "r_v": nothing})
    if not boxes.tree.top:
        own = boxes.level(0).select(*[F.struct(*boxes.columns).alias(f"{side}_box") for side in "qr"])
        # One row on either side: a single leaf.
        pairs = judge(pairs.join(F.broadcast(own), F.lit(True))).select("q", "r", "q_v", "r_v")
    links = None
    for level in range(boxes.tree.top - 1, -1, -1):
        written = materialize(judge(tree.split(pairs, boxes, boxes, level)), "links")
        sure = written.where((F.col("_far") <= eps) & F.col("q_v").isNotNull() & F.col("r_v").isNotNull())
        ends = sure.select(F.least("q_v", "r_v").alias("src"), F.greatest("q_v", "r_v").alias("dst"))
        links = (ends if links is None else links.unionByName(ends)).distinct()
        links = materialize(links, "linked") if level else links
        known = links.select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
        same = (F.least("q_v", "r_v") == F.col("_a")) & (F.greatest("q_v", "r_v") == F.col("_b"))
        both = F.col("q_v").isNotNull() & F.col("r_v").isNotNull()
        undecided = written.where(both).join(known, same, "left_anti")
        pairs = undecided.unionByName(written.where(~both)).select("q", "r", "q_v", "r_v")
    met = tree.meet(pairs, boxes, boxes)
    close = F.filter("r_members", lambda m: distance(F.col("p.x"), m["x"], dims) <= eps)
    other = F.when(F.col("r_v").isNotNull(), F.array("r_v")).otherwise(F.transform("_close", lambda m: m["id"]))
    exact = (
        met.select(F.coalesce("q_v", "p.id").alias("src"), "r_v", close.alias("_close"))
        .where(F.size("_close") > 0)
        .select("src", F.explode(other).alias("dst"))
        .where(F.col("src") != F.col("dst"))
    )
    return (exact if links is None else links.unionByName(exact)).distinct()


def dbscan(df: DataFrame, key: str, columns: list[str], eps: float = 1.5, min_pts: int = 5) -> DataFrame:
    """(key, cluster): density clusters 1, 2, … by their smallest core key; 0 is noise.

    Three descents of one tree: which points are core, which core vertices are linked, and which
    clusters the other points touch.  A border point joins the smallest adjacent cluster.
    """
    dims = len(columns)
    rows, points = _weighted(df, key, columns)
    whole = tree.Tree(points, dims)
    core = materialize(_core_points(whole.boxes(), eps, min_pts), "core")
    core_boxes = whole.boxes(core, F.min("id").alias("v"))
    placed = materialize(_vertices(core_boxes, core, eps), "vertices")
    components = connected_components(placed.select("v").distinct(), _core_links(core_boxes, eps))
    # The smallest vertex of a component is its smallest core key.
    numbers = with_row_id(components.select("component").distinct(), ["component"], "clusters")
    number_of = components.join(broadcast_if_small(materialize(numbers, "numbers")), "component")
    clustered = materialize(
        placed.join(number_of, "v").select("leaf", "x", "w", F.col("row_id").cast("int").alias("cluster")), "core-clusters"
    )
    other = whole.points.join(core.select("x"), "x", "left_anti")
    others, clusters = whole.boxes(other), whole.boxes(clustered)
    met = tree.meet(tree.close_leaves(others, clusters, eps), others, clusters)
    close = F.filter("r_members", lambda m: distance(F.col("p.x"), m["x"], dims) <= eps)
    touched = F.array_min(F.transform(close, lambda m: m["cluster"]))
    border = met.groupBy("p.x").agg(F.min(touched).alias("cluster"))
    found = clustered.select("x", "cluster").unionByName(border)
    return rows.join(found, "x", "left").select(
        F.col("id").alias(key), F.coalesce("cluster", F.lit(0)).alias("cluster")
    )


# --- noise report ----------------------------------------------------------------------------


def noise_profile(
    clustered: DataFrame, metrics: dict[str, str], order: str = "timestamp"
) -> dict[str, DataFrame]:
    """What the noise rows (cluster 0) look like against the whole table.

    ``rate``: rows, noise rows, percentage and number of clusters; ``hours``: noise rows per hour;
    ``extremes``: the ten noise rows above two sd in traffic or AQI with the highest traffic.
    """
    cols = list(metrics.values())
    scored = with_scalars(clustered, mean_sd_row(clustered, cols)).withColumns(
        {
            f"{m}_zscore": F.try_divide(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_sd"))
            for m, c in metrics.items()
        }
    )
    noise = scored.where(F.col("cluster") == 0)
    noise_rows = F.count_if(F.col("cluster") == 0)
    rate = clustered.agg(
        F.count(F.lit(1)).alias("rows"),
        noise_rows.alias("noise_rows"),
        F.round(noise_rows / F.count(F.lit(1)) * 100, 2).alias("noise_percent"),
        F.count_distinct(F.when(F.col("cluster") > 0, F.col("cluster"))).alias("clusters"),
    )
    hours = noise.groupBy("hour").agg(F.count(F.lit(1)).alias("count"))
    extremes = (
        noise.where((F.col("traffic_zscore") > 2) | (F.col("aqi_zscore") > 2))
        .orderBy(F.desc_nulls_last("traffic_zscore"), order)
        .limit(10)
        .select(order, "hour", *cols, *[f"{m}_zscore" for m in metrics])
    )
    return {"rate": rate, "hours": hours, "extremes": extremes}
