"""kNN distance, components and DBSCAN against brute force, with one leaf and with several levels."""

import numpy as np
import pytest

from sensorspark.operators import density, tree

COLS = list("abcdefgh")


def frame(spark, x):
    rows = [(i, *map(float, p)) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in COLS[: x.shape[1]]))


def blobs(dims, seed=0):
    rng = np.random.default_rng(seed)
    parts = [
        rng.normal(scale=0.3, size=(60, dims)),
        rng.normal(scale=0.3, size=(40, dims)) + 6,
        rng.uniform(-12, 12, size=(25, dims)),
        np.repeat(rng.normal(size=(1, dims)), 12, axis=0),
    ]
    return np.vstack(parts)


def brute_dbscan(x, eps, min_pts):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = d <= eps
    core = near.sum(1) >= min_pts
    label = np.zeros(len(x), dtype=int)
    current = 0
    for i in range(len(x)):
        if not core[i] or label[i]:
            continue
        current += 1
        stack = [i]
        while stack:
            j = stack.pop()
            if label[j]:
                continue
            label[j] = current
            stack += [m for m in np.flatnonzero(near[j] & core) if not label[m]]
    out = label.copy()
    for i in np.flatnonzero(~core):
        adjacent = label[near[i] & core]
        out[i] = adjacent.min() if len(adjacent) else 0
    return out


@pytest.fixture
def small_leaves(monkeypatch):
    def use(leaf, fan):
        monkeypatch.setattr(tree, "LEAF", leaf)
        monkeypatch.setattr(tree, "FAN", fan)

    return use


@pytest.mark.parametrize("dims,leaf,fan", [(2, 128, 16), (8, 8, 4)])
def test_knn_distance(spark, small_leaves, dims, leaf, fan):
    small_leaves(leaf, fan)
    x = blobs(dims)
    got = density.knn_distance(frame(spark, x), "id", COLS[:dims], 4).orderBy("id").collect()
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), axis=1)
    assert [r["distance"] for r in got] == pytest.approx(list(d[:, 4]))


def test_levels_follow_the_number_of_points(spark, small_leaves):
    """A far outlier, a constant column and a huge scale add no level."""
    small_leaves(8, 4)
    x = np.random.default_rng(1).normal(size=(200, 3))
    x[7] = 1e30
    x[:, 2] = 5.0
    points = frame(spark, x).selectExpr("id", "array(a, b, c) AS x", "1L AS w")
    built = tree.Tree(points, 3)
    assert built.top == 3 and built.count == 200
    leaves = built.boxes().leaves.collect()
    assert max(r["n"] for r in leaves) == 8 and sum(r["n"] for r in leaves) == 200
    got = density.knn_distance(frame(spark, x), "id", COLS[:3], 2).orderBy("id").collect()
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), axis=1)
    assert [r["distance"] for r in got] == pytest.approx(list(d[:, 2]))


def test_searches_stay_local(spark, small_leaves):
    """The leaf pairs left are some tens per leaf, not a share of all leaves."""
    small_leaves(8, 8)
    x = np.random.default_rng(3).uniform(size=(6000, 2))
    rows = frame(spark, x).selectExpr("id", "array(a, b) AS x", "1L AS w")
    boxes = tree.Tree(rows, 2).boxes()
    leaves = boxes.leaves.count()
    assert leaves == 750 and tree.neighbour_leaves(boxes, 5).count() < 48 * leaves
    assert tree.close_leaves(boxes, boxes, 0.01).count() < 12 * leaves


def test_knn_without_enough_rows(spark):
    got = density.knn_distance(frame(spark, np.zeros((3, 2))), "id", COLS[:2], 4).collect()
    assert [r["distance"] for r in got] == [None] * 3


@pytest.mark.parametrize(
    "dims,eps,leaf,fan", [(2, 1.5, 128, 16), (2, 0.2, 8, 4), (8, 1.2, 8, 4), (3, 30.0, 8, 4)]
)
def test_dbscan(spark, small_leaves, dims, eps, leaf, fan):
    small_leaves(leaf, fan)
    x = blobs(dims, seed=dims)
    got = density.dbscan(frame(spark, x), "id", COLS[:dims], eps, 5).orderBy("id").collect()
    assert [r["cluster"] for r in got] == list(brute_dbscan(x, eps, 5))


def test_dbscan_of_chains_and_an_outlier(spark, small_leaves):
    """Thin chains (no solid node), a knot of equal points and a far point, in rows of any order."""
    small_leaves(6, 5)
    rng = np.random.default_rng(5)
    chain = np.column_stack([np.arange(60) * 0.5, rng.normal(scale=0.05, size=60)])
    x = np.vstack([chain, chain + [0, 3], np.zeros((30, 2)) + [10, 9], [[1e9, 1e9]]])
    x = x[rng.permutation(len(x))]
    got = density.dbscan(frame(spark, x), "id", COLS[:2], 0.7, 3).orderBy("id").collect()
    assert [r["cluster"] for r in got] == list(brute_dbscan(x, 0.7, 3))


def test_dbscan_without_clusters_or_rows(spark):
    far = np.arange(6.0)[:, None] * 100
    assert [r["cluster"] for r in density.dbscan(frame(spark, far), "id", COLS[:1]).collect()] == [0] * 6
    assert density.dbscan(frame(spark, far).limit(0), "id", COLS[:1]).collect() == []
    assert density.knn_distance(frame(spark, far).limit(0), "id", COLS[:1]).collect() == []


def test_border_point_at_exactly_eps(spark):
    x = np.array([[0.0, 0.0]] * 5 + [[1.0, 0.0], [2.5, 0.0]])
    got = density.dbscan(frame(spark, x), "id", COLS[:2], 1.0, 5).orderBy("id").collect()
    assert [r["cluster"] for r in got] == [1] * 6 + [0]


def test_long_chain_is_one_component(spark):
    vertices = spark.range(200).toDF("v")
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 149)], "src long, dst long")
    got = {r["v"]: r["component"] for r in density.connected_components(vertices, edges).collect()}
    assert all(got[v] == 0 for v in range(150)) and all(got[v] == v for v in range(150, 200))


def test_noise_profile(spark):
    df = spark.createDataFrame(
        [(i, i % 24, 1.0 + i % 2, 1.0, 1.0, 1) for i in range(50)] + [(99, 3, 90.0, 1.0, 2.0, 0)],
        "timestamp int, hour int, total_vehicles double, avg_AQI double, total_energy_kwh double, "
        "cluster int",
    )
    metrics = {"traffic": "total_vehicles", "aqi": "avg_AQI", "energy": "total_energy_kwh"}
    out = density.noise_profile(df, metrics)
    assert tuple(out["rate"].first()) == (51, 1, 1.96, 1)
    assert [tuple(r) for r in out["hours"].collect()] == [(3, 1)]
    assert out["extremes"].first()["traffic_zscore"] > 2
