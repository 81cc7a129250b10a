"""Joint k-means fits against separate ones, and silhouettes by squared distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorspark.operators import cluster, kmeans


def separate(x, centres):
    """Plain iterations from given centres until they stand still."""
    centres = centres.copy()
    for _ in range(kmeans.MAX_ITERATIONS + 1):
        gap = ((x[:, None] - centres[None]) ** 2).sum(-1)
        own = gap.argmin(1)
        cost = gap[np.arange(len(x)), own].sum()
        moved = np.array([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        if np.abs(moved - centres).max() <= kmeans.TOLERANCE:
            break
        centres = moved
    return cost


def points(spark, x, parts=3):
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>").repartition(parts)


def test_best_costs_equal_separate_fits(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "CELLS", 50)
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(size=(40, 2)) + c for c in ([0, 0], [6, 0], [0, 7], [6, 6])])
    df = points(spark, x)
    best = kmeans.best_fits(df, F.col("x"), [2, 4, 6], starts=6)
    starts = kmeans.starting_centres(df.select("x"), [2, 4, 6], 6, 123)
    for k in (2, 4, 6):
        costs = [separate(x, c) for kk, _, c in starts if kk == k]
        assert best[k].cost == pytest.approx(min(costs)) and best[k].centres.shape == (k, 2)
    again = kmeans.best_fits(points(spark, x, 7), F.col("x"), [4], starts=6)
    assert again[4].cost == pytest.approx(best[4].cost)
    assigned = df.select("id", best[4].assign(F.col("x")).alias("c")).collect()
    gap = ((x[:, None] - best[4].centres[None]) ** 2).sum(-1)
    assert all(r["c"] == gap[r["id"]].argmin() for r in assigned)


def test_few_distinct_rows_and_none(spark):
    df = points(spark, np.array([[1.0, 2.0]] * 5 + [[3.0, 4.0]] * 2))
    best = kmeans.best_fits(df, F.col("x"), [4], starts=3)
    assert len(best[4].centres) == 2 and best[4].cost == pytest.approx(0.0)
    assert kmeans.best_fits(df.limit(0), F.col("x"), [2]) == {}


def test_linear_silhouette_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3)) * [1, 5, 0.1] + 1e4
    own = np.array([0] * 30 + [1] * 29 + [2])
    rows = [(i, *map(float, p), int(c)) for i, (p, c) in enumerate(zip(x, own))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, g int")
    got = {r["id"]: r["silhouette"] for r in cluster.linear_silhouettes(df, "id", ["a", "b", "c"], "g").collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    for i in range(60):
        same = own == own[i]
        if same.sum() == 1:
            assert got[i] == 0.0
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, own == c].mean() for c in set(own) - {own[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-6)
