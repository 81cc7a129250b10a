"""A partition tree over points, and searches that descend it with pairs of nodes.

Points are ordered along a space-filling curve and cut into leaves of ``LEAF`` consecutive points;
``FAN`` neighbouring nodes form a node of the next level.  Cuts therefore follow the data's own
ranks: a far outlier stretches one box and adds no level, and a dense region simply has more nodes.
The number of levels only depends on the number of points.

A search starts with the pair (root, root) and replaces every pair that its boxes and counts do not
decide by the pairs of children; decided pairs leave.  Points meet points only in leaf pairs, where
a leaf is one row with at most ``LEAF`` members.  Bounds are taken with the same floating-point
operations as distances, so that a pair decided by its boxes is decided as its points would be.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorspark.operators.sequence import with_row_id
from sensorspark.session import materialize, materialize_observed, with_scalars

LEAF = 128
FAN = 16
# Places on the curve per dimension, as a power of two.
CURVE_BITS = 16
# Largest node table that is sent to every task.
BROADCAST_BYTES = 32 << 20


def norm(gaps: list[Column]) -> Column:
    total = gaps[0] * gaps[0]
    for g in gaps[1:]:
        total = total + g * g
    return F.sqrt(total)


def distance(x: Column, y: Column, dims: int) -> Column:
    return norm([x[i] - y[i] for i in range(dims)])


def nearest(lo1: Column, hi1: Column, lo2: Column, hi2: Column, dims: int) -> Column:
    """Smallest distance between two boxes (a point is a box with equal corners)."""
    zero = F.lit(0.0)
    return norm([F.greatest(lo1[i] - hi2[i], lo2[i] - hi1[i], zero) for i in range(dims)])


def farthest(lo1: Column, hi1: Column, lo2: Column, hi2: Column, dims: int) -> Column:
    """Largest distance between two boxes."""
    return norm([F.greatest(hi1[i] - lo2[i], hi2[i] - lo1[i]) for i in range(dims)])


def _along_curve(points: DataFrame, dims: int) -> Column:
    """Interleaved binary places of the coordinates, on a scale that is logarithmic away from the
    median, so that far values do not use up the places of near ones."""
    x = F.col("x")
    digits = []
    for i in range(dims):
        reach = F.greatest(F.col(f"_high{i}") - F.col(f"_mid{i}"), F.col(f"_mid{i}") - F.col(f"_low{i}"))
        unit = F.when(F.col(f"_wide{i}") > 0, F.col(f"_wide{i}")).when(reach > 0, reach).otherwise(1.0)
        off = x[i] - F.col(f"_mid{i}")
        scaled = F.signum(off) * F.log1p(F.abs(off) / unit) / F.greatest(F.log1p(reach / unit), F.lit(1e-300))
        place = F.floor((scaled + 1) / 2 * (2**CURVE_BITS - 1)).cast("long")
        digits.append(F.lpad(F.bin(F.coalesce(place, F.lit(0).cast("long"))), CURVE_BITS, "0"))
    turns = F.transform(
        F.sequence(F.lit(1), F.lit(CURVE_BITS)), lambda k: F.concat(*[F.substr(d, k, F.lit(1)) for d in digits])
    )
    return F.array_join(turns, "")


class Tree:
    """The tree over ``points``: distinct ``x`` (array of doubles), weight ``w`` and other columns.

    ``points`` is written and counted first, unless the caller has done so and passes the ``count``.
    ``self.points`` has the column ``leaf`` in addition.
    """

    def __init__(self, points: DataFrame, dims: int, count: int | None = None):
        self.dims, self.fan, leaf = dims, FAN, LEAF
        if count is None:
            points, seen = materialize_observed(points, "points", count=F.count(F.lit(1)))
            count = seen["count"]
        self.count = count
        self.top = 0
        while leaf * self.fan**self.top < self.count:
            self.top += 1
        if self.top:
            x = F.col("x")
            spread = points.agg(
                *[F.min(x[i]).alias(f"_low{i}") for i in range(dims)],
                *[F.max(x[i]).alias(f"_high{i}") for i in range(dims)],
                *[F.percentile_approx(x[i], [0.25, 0.5, 0.75], 200).alias(f"_q{i}") for i in range(dims)],
            ).select(
                "*",
                *[F.col(f"_q{i}")[1].alias(f"_mid{i}") for i in range(dims)],
                *[(F.col(f"_q{i}")[2] - F.col(f"_q{i}")[0]).alias(f"_wide{i}") for i in range(dims)],
            )
            placed = with_scalars(points, spread).withColumn("_curve", _along_curve(points, dims))
            numbered = with_row_id(placed.select(*points.columns, "_curve"), ["_curve", "x"], "tree")
            self.points = numbered.withColumn("leaf", F.expr(f"(row_id - 1) div {leaf}")).drop("_curve", "row_id")
        else:
            self.points = points.withColumn("leaf", F.lit(0).cast("long"))

    def boxes(self, points: DataFrame | None = None, *more: Column) -> "Boxes":
        """The nodes over all points of the tree or over some of them, all levels in one table."""
        x = F.col("x")
        given = self.points if points is None else points
        leaves = materialize(
            given.groupBy("leaf").agg(
                F.count(F.lit(1)).alias("n"),
                F.sum("w").alias("w"),
                F.min("w").alias("w_min"),
                F.max("w").alias("w_max"),
                F.array(*[F.min(x[i]) for i in range(self.dims)]).alias("lo"),
                F.array(*[F.max(x[i]) for i in range(self.dims)]).alias("hi"),
                *more,
                F.collect_list(F.struct(*[c for c in given.columns if c != "leaf"])).alias("members"),
            ),
            "leaves",
        )
        return Boxes(self, leaves)


class Boxes:
    """``node``, ``n``, ``w``, ``w_min``, ``w_max``, ``lo``, ``hi`` (and a smallest ``v``) of every level
    below the root; a tree of one leaf has that leaf only."""

    def __init__(self, tree: Tree, leaves: DataFrame):
        self.tree, self.leaves = tree, leaves
        dims, self._extra = tree.dims, ["v"] if "v" in leaves.columns else []
        self.levels = max(tree.top, 1)
        self.all = leaves.select(F.lit(0).alias("level"), F.col("leaf").alias("node"), *self.columns)
        if tree.top > 1:
            widths = F.expr(f"array({', '.join(f'{tree.fan**k}L' for k in range(self.levels))})")
            spread = leaves.select("*", F.posexplode(widths).alias("level", "_width"))
            lo, hi = F.col("lo"), F.col("hi")
            self.all = materialize(
                spread.groupBy("level", F.expr("leaf div _width").alias("node")).agg(
                    F.sum("n").alias("n"),
                    F.sum("w").alias("w"),
                    F.min("w_min").alias("w_min"),
                    F.max("w_max").alias("w_max"),
                    F.array(*[F.min(lo[i]) for i in range(dims)]).alias("lo"),
                    F.array(*[F.max(hi[i]) for i in range(dims)]).alias("hi"),
                    *[F.min(c).alias(c) for c in self._extra],
                ),
                "nodes",
            )

    @property
    def columns(self) -> list[str]:
        return ["n", "w", "w_min", "w_max", "lo", "hi", *self._extra]

    def level(self, level: int) -> DataFrame:
        return self.all.where(F.col("level") == level).drop("level")

    def above(self, leaf: str = "leaf") -> Column:
        """(level, node) of all nodes over a leaf, to explode."""
        nodes = [F.struct(F.lit(k).alias("level"), F.expr(f"{leaf} div {self.tree.fan**k}").alias("node")) for k in range(self.levels)]
        return F.inline(F.array(*nodes))

    def hinted(self, nodes: DataFrame, level: int) -> DataFrame:
        """Broadcast nodes whose number, known from the number of points, bounds their bytes."""
        most = math.ceil(self.tree.count / LEAF / self.tree.fan**level) + 1
        return F.broadcast(nodes) if most * (16 * self.tree.dims + 128) <= BROADCAST_BYTES else nodes

    def children(self, name: str, level: int) -> DataFrame:
        """Nodes of ``level`` as a struct column ``name`` with their parents' and their own numbers."""
        nodes = self.level(level).select(
            F.expr(f"node div {self.tree.fan}").alias(f"_{name}"), F.col("node").alias(name), F.struct(*self.columns).alias(f"{name}_box")
        )
        return self.hinted(nodes, level)

    def members(self, name: str) -> DataFrame:
        return self.leaves.select(F.col("leaf").alias(name), F.col("members").alias(f"{name}_members"))


def root_pair(left: Boxes) -> DataFrame:
    return left.leaves.sparkSession.createDataFrame([(0, 0)], "q long, r long")


def split(pairs: DataFrame, left: Boxes, right: Boxes, level: int) -> DataFrame:
    """All pairs of children, with their boxes ``q_box`` and ``r_box``; other columns are kept."""
    kept = [c for c in pairs.columns if c not in ("q", "r")]
    above = pairs.select(F.col("q").alias("_q"), F.col("r").alias("_r"), *kept)
    return above.join(left.children("q", level), "_q").join(right.children("r", level), "_r").drop("_q", "_r")


def near(dims: int, a: str = "q_box", b: str = "r_box") -> Column:
    return nearest(*[F.col(f"{box}.{c}") for box in (a, b) for c in ("lo", "hi")], dims)


def far(dims: int, a: str = "q_box", b: str = "r_box") -> Column:
    return farthest(*[F.col(f"{box}.{c}") for box in (a, b) for c in ("lo", "hi")], dims)


def written_above_leaves(pairs: DataFrame, level: int) -> DataFrame:
    """Pairs that are expanded again are written; leaf pairs are read once, by what follows."""
    return materialize(pairs, "pairs") if level else pairs


Bound = Callable[[int], Column]


def neighbour_leaves(boxes: Boxes, wanted: int, held: str = "w", lower: Bound = near, upper: Bound = far) -> DataFrame:
    """(q, r): for every leaf the leaves that may hold one of the ``wanted`` nearest of its points.

    A node's reach is the smallest upper bound within which nodes with enough points lie; pairs whose
    lower bound exceeds it leave.  ``held`` is what counts: weights or points.
    """
    dims = boxes.tree.dims
    pairs = root_pair(boxes)
    within = Window.partitionBy("q").orderBy("_far").rangeBetween(Window.unboundedPreceding, 0)
    for level in range(boxes.tree.top - 1, -1, -1):
        judged = split(pairs, boxes, boxes, level).select(
            "q", "r", lower(dims).alias("_near"), upper(dims).alias("_far"), F.col(f"r_box.{held}").alias("_count")
        )
        counted = judged.withColumn("_held", F.sum("_count").over(within))
        reach = F.min(F.when(F.col("_held") >= wanted, F.col("_far"))).over(Window.partitionBy("q"))
        open_pairs = counted.withColumn("_reach", reach).where(F.col("_reach").isNull() | (F.col("_near") <= F.col("_reach")))
        pairs = written_above_leaves(open_pairs.select("q", "r"), level)
    return pairs


def close_leaves(left: Boxes, right: Boxes, eps: float) -> DataFrame:
    """(q, r): leaves of ``left`` and ``right`` whose boxes come within ``eps`` of each other."""
    pairs = root_pair(left)
    for level in range(left.tree.top - 1, -1, -1):
        judged = split(pairs, left, right, level).where(near(left.tree.dims) <= eps)
        pairs = written_above_leaves(judged.select("q", "r"), level)
    return pairs


def meet(pairs: DataFrame, left: Boxes, right: Boxes) -> DataFrame:
    """Every point ``p`` of a pair's left leaf beside the members of the right one."""
    kept = [c for c in pairs.columns if c != "q"]
    points = pairs.join(left.members("q"), "q").select(F.explode("q_members").alias("p"), "q", *kept)
    return points.join(right.members("r"), "r")
