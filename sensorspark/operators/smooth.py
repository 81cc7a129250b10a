"""Local regression on a fixed grid."""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.operators.stats import grouped_quantiles
from sensorspark.session import materialize

# Cells between two neighbouring grid points.
CELLS_PER_STEP = 16
# The tricube weight (1 - s^3)^3 as coefficients of s^0, s^3, s^6, s^9.
TRICUBE = (1.0, -3.0, 3.0, -1.0)
# Powers of the distance that a weighted quadratic fit sums, alone and times y.
ALONE, TIMES_Y = 9 + 4 + 1, 9 + 2 + 1


def _det3(m: list[list[Column]]) -> Column:
    return (
        m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
        - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
        + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    )


def _rings(cells: pd.DataFrame, grid_points: int, span: float) -> pd.DataFrame:
    """For every grid point the pair of cells, equally far on either side, that holds the wanted
    nearest row, and the row's rank among theirs."""
    total = (grid_points - 1) * CELLS_PER_STEP
    held = np.zeros(total + 1, np.int64)
    held[cells["cell"].to_numpy() + 1] = cells["n"].to_numpy()
    held = held.cumsum()
    wanted = max(int(np.floor(held[-1] * span + 1e-5)), 1)
    steps = np.arange(total + 1)
    out = []
    for grid in range(grid_points):
        at = grid * CELLS_PER_STEP
        inside = held[np.minimum(at + steps, total)] - held[np.maximum(at - steps, 0)]
        ring = int(np.searchsorted(inside, wanted)) - 1
        for cell in (at - ring - 1, at + ring):
            if 0 <= cell < total:
                out.append((grid, ring, int(wanted - inside[ring]), cell))
    found = pd.DataFrame(out, columns=["grid", "ring", "need", "cell"])
    found.insert(0, "series", cells["series"].iloc[0])
    return found


def _inner_sums(cells: pd.DataFrame, widths: pd.DataFrame, grid_points: int) -> pd.DataFrame:
    """Weighted sums at every grid point over the cells inside its ring, from the cells' own power sums.

    Inside the ring the weight is a polynomial of the distance on either side of the grid point, so
    sums about a cell's centre shift to the grid point by the binomial theorem.
    """
    total = (grid_points - 1) * CELLS_PER_STEP
    sums = np.zeros((total, ALONE + TIMES_Y))
    sums[cells["cell"].to_numpy()] = np.stack(cells["sums"].to_numpy())
    out = []
    for grid, ring, h in zip(widths["grid"], widths["ring"], widths["h"]):
        at, row = int(grid) * CELLS_PER_STEP, np.zeros(8)
        scale = 1.0 / (total * h) if h > 0 else 0.0
        for side, cut in ((1.0, slice(at, min(at + ring, total))), (-1.0, slice(max(at - ring, 0), at))):
            part = sums[cut]
            away = np.arange(len(part)) + 0.5
            away = (away if side > 0 else away[::-1]) * scale
            for first, powers, places in ((0, ALONE, range(5)), (ALONE, TIMES_Y, range(3))):
                moment = [
                    sum(comb(m, k) * away ** (m - k) @ part[:, first + k] * (side * scale) ** k for k in range(m + 1))
                    for m in range(powers)
                ]
                for p in places:
                    value = sum(c * moment[3 * j + p] for j, c in enumerate(TRICUBE))
                    row[p if first == 0 else 5 + p] += value * (side * h) ** p
        out.append((grid, *row))
    found = pd.DataFrame(out, columns=["grid", *_SUMS])
    found.insert(0, "series", widths["series"].iloc[0] if len(widths) else None)
    return found


_SUMS = [*[f"s{p}" for p in range(5)], *[f"t{p}" for p in range(3)]]


def local_regression(
    df: DataFrame,
    x: Column,
    y: Column,
    by: Column | None = None,
    span: float = 0.75,
    grid_points: int = 80,
) -> DataFrame:
    """Quadratic local regression with tricube weights: ``series``, ``grid``, ``x0``, ``fitted``.

    ``grid_points`` positions cover the x range of each series.  Rows are summed once into cells,
    sixteen between two grid points, as powers of x and y about the cell's centre; the cells' number is
    fixed.  The bandwidth at a grid point is the exact ``floor(span · n)``-th smallest distance: counts
    of cells tell in which two cells, one on either side, it lies, and only their rows are looked at
    one by one.  Cells nearer than these count by their power sums, which is exact up to rounding (the
    tests bound the difference to the direct fit by 10^-8).  So a row meets the few grid points whose
    bandwidth ends in its cell.  Where nearly all rows share one cell, each meets all grid points.

    x is scaled to 0..1 for conditioning.  NULL where the fit is undetermined.
    """
    rows = df.select(
        (F.lit("") if by is None else by).alias("series"),
        x.cast("double").alias("_x"),
        y.cast("double").alias("_y"),
    ).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    rows = materialize(rows, "smooth")
    total = (grid_points - 1) * CELLS_PER_STEP
    spans = rows.groupBy("series").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    spans = spans.where(F.col("_hi") > F.col("_lo"))
    scaled = (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    placed = (
        rows.join(spans, "series")
        .withColumn("_u", scaled)
        .withColumn("cell", F.least(F.floor(F.col("_u") * total), F.lit(total - 1)).cast("int"))
    )
    off = F.col("_u") * total - F.col("cell") - 0.5
    powers = [F.sum(F.pow(off, F.lit(float(p)))) for p in range(ALONE)]
    powers += [F.sum(F.pow(off, F.lit(float(p))) * F.col("_y")) for p in range(TIMES_Y)]
    cells = materialize(
        placed.groupBy("series", "cell").agg(F.count(F.lit(1)).alias("n"), F.array(*powers).alias("sums")), "cells"
    )
    kind = dict(cells.dtypes)["series"]
    # A group is one series with its fixed number of cells.
    rings = materialize(
        cells.select("series", "cell", "n")
        .groupBy("series")
        .applyInPandas(
            lambda group: _rings(group, grid_points, span), f"series {kind}, grid int, ring int, need long, cell int"
        ),
        "rings",
    )
    edge = materialize(
        placed.join(rings, ["series", "cell"]).select(
            "series", "grid", "ring", "need", (F.col("_u") - F.col("grid") / (grid_points - 1)).alias("_d"), "_y"
        ),
        "edges",
    )
    widths = grouped_quantiles(
        edge.withColumn("_far", F.abs("_d")), ["series", "grid", "ring", "need"], "_far", [0.0],
        position=lambda n, p: (F.col("need") - 1).cast("double"),
    ).select("series", "grid", "ring", F.col("quantile").alias("h"))
    widths = materialize(widths, "widths")
    inner = (
        cells.groupBy("series")
        .cogroup(widths.groupBy("series"))
        .applyInPandas(
            lambda held, near: _inner_sums(held, near, grid_points),
            f"series {kind}, grid int, {', '.join(f'{c} double' for c in _SUMS)}",
        )
    )
    # One row for each grid point of a series.
    near = edge.join(widths.select("series", "grid", "h"), ["series", "grid"])
    ratio = F.try_divide(F.abs("_d"), F.col("h"))
    w, d = F.when(ratio < 1, F.pow(1 - F.pow(ratio, 3), 3)).otherwise(0.0), F.col("_d")
    outer = near.groupBy("series", "grid").agg(
        *[F.sum(w * F.pow(d, F.lit(float(p)))).alias(f"s{p}") for p in range(5)],
        *[F.sum(w * F.pow(d, F.lit(float(p))) * F.col("_y")).alias(f"t{p}") for p in range(3)],
    )
    sums = inner.unionByName(outer).groupBy("series", "grid").agg(*[F.sum(c).alias(c) for c in _SUMS])
    s = [F.col(f"s{p}") for p in range(5)]
    t = [F.col(f"t{p}") for p in range(3)]
    normal = [[s[i + j] for j in range(3)] for i in range(3)]
    first = [[t[i], s[i + 1], s[i + 2]] for i in range(3)]
    x0 = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("grid") / (grid_points - 1)
    return sums.join(spans, "series").select(
        "series", "grid", x0.alias("x0"), F.try_divide(_det3(first), _det3(normal)).alias("fitted")
    )
