"""k-means with many starts and several k: all fits advance together, one scan per iteration.

Centres of all fits are a small array (its size is fixed by the k's, the starts and the dimensions)
that goes to every task.  A task returns sufficient statistics per (fit, cluster): rows, sums and
squared distances.  Fits whose centres stand still drop out of the next scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.operators.tree import distance

STARTS = 25
MAX_ITERATIONS = 50
TOLERANCE = 1e-8
# Distinct rows with the smallest digest, among which starting centres are drawn.
START_ROWS = 4096
# Distances that a task holds at once.
CELLS = 1 << 20


@dataclass(frozen=True)
class Fit:
    k: int
    start: int
    cost: float
    centres: np.ndarray

    def assign(self, x: Column) -> Column:
        """0-based number of the nearest centre; the first of equally near ones."""
        dims = self.centres.shape[1]
        known = F.array(
            *[F.struct(F.array(*[F.lit(float(v)) for v in c]).alias("m"), F.lit(i).alias("i")) for i, c in enumerate(self.centres)]
        )
        return F.array_min(F.transform(known, lambda c: F.struct(distance(x, c["m"], dims), c["i"].alias("i"))))["i"]


_PARTIAL = pa.schema(
    [("fit", pa.int32()), ("cluster", pa.int32()), ("n", pa.int64()), ("cost", pa.float64()), ("sums", pa.list_(pa.float64()))]
)


def _statistics(batches: Iterator[pa.RecordBatch], fits: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(fit, cluster, n, cost, sums) over a task's rows."""
    totals = [(np.zeros(len(c)), np.zeros(len(c)), np.zeros_like(c)) for _, c in fits]
    for batch in batches:
        column = batch.column("x")
        if not len(column):
            continue
        rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        for (_, centres), (n, cost, sums) in zip(fits, totals):
            step = max(1, CELLS // centres.size)
            for first in range(0, len(rows), step):
                part = rows[first : first + step]
                gaps = ((part[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
                own = gaps.argmin(axis=1)
                n += np.bincount(own, minlength=len(centres))
                cost += np.bincount(own, gaps[np.arange(len(part)), own], minlength=len(centres))
                np.add.at(sums, own, part)
    out = [
        {"fit": number, "cluster": c, "n": int(n[c]), "cost": float(cost[c]), "sums": sums[c].tolist()}
        for (number, _), (n, cost, sums) in zip(fits, totals)
        for c in range(len(n))
        if n[c]
    ]
    if out:
        yield pa.RecordBatch.from_pylist(out, _PARTIAL)


def _advance(points: DataFrame, fits: list[tuple[int, np.ndarray]]) -> dict[int, tuple[float, np.ndarray]]:
    """Cost and next centres of every fit, by one scan; a cluster without rows keeps its centre."""
    dims = fits[0][1].shape[1]
    partial = points.mapInArrow(
        lambda batches: _statistics(batches, fits), "fit int, cluster int, n long, cost double, sums array<double>"
    )
    # As many rows as the fits have clusters.
    rows = (
        partial.groupBy("fit", "cluster")
        .agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)])
        .collect()
    )
    found = {number: [0.0, centres.copy()] for number, centres in fits}
    for r in rows:
        found[r["fit"]][0] += r["cost"]
        found[r["fit"]][1][r["cluster"]] = [r[f"s{i}"] / r["n"] for i in range(dims)]
    return {number: (cost, centres) for number, (cost, centres) in found.items()}


def starting_centres(points: DataFrame, ks: list[int], starts: int, seed: int) -> list[tuple[int, int, np.ndarray]]:
    """(k, start, centres) drawn without repetition among distinct rows, the same for any layout.

    A table with fewer distinct rows than k gets as many clusters as it has distinct rows.
    """
    drawn = points.select("x").distinct().orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(START_ROWS).collect()
    rows = np.array([r["x"] for r in drawn], float)
    out = []
    for k in ks if len(rows) else []:
        for start in range(starts):
            rng = np.random.default_rng([seed, k, start])
            out.append((k, start, rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]))
    return out


def best_fits(data: DataFrame, features: Column, ks: list[int], starts: int = STARTS, seed: int = 123) -> dict[int, Fit]:
    """For each k the fit with the lowest within-cluster sum of squares among ``starts`` starts.

    ``features`` is an array of doubles.  ``data`` should be a written table: each iteration scans it.
    """
    points = data.select(features.alias("x"))
    fits = starting_centres(points, ks, starts, seed)
    running = {number: centres for number, (_, _, centres) in enumerate(fits)}
    final: dict[int, tuple[float, np.ndarray]] = {}
    for _ in range(MAX_ITERATIONS + 1):
        if not running:
            break
        moved = _advance(points, list(running.items()))
        for number, (cost, centres) in moved.items():
            final[number] = cost, running[number]
            if np.abs(centres - running[number]).max() <= TOLERANCE:
                del running[number]
            else:
                running[number] = centres
    best: dict[int, Fit] = {}
    for number, (cost, centres) in final.items():
        k, start, _ = fits[number]
        if k not in best or (cost, start) < (best[k].cost, best[k].start):
            best[k] = Fit(k, start, cost, centres)
    return best
