"""k-means restarts, labels, principal components, silhouettes and smoothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorspark.operators import cluster, smooth

COLS = ["avg_traffic", "avg_aqi", "avg_energy"]


@pytest.fixture(scope="module")
def hours(spark):
    rng = np.random.default_rng(2)
    centre = {**dict.fromkeys([0, 1, 2, 3, 4, 5, 23], 0), **dict.fromkeys(range(6, 11), 10),
              **dict.fromkeys(range(11, 17), 20), **dict.fromkeys(range(17, 23), 30)}
    rows = [(h, *(float(centre[h] + v) for v in rng.normal(scale=0.1, size=3))) for h in range(24)]
    return spark.createDataFrame(rows, "hour int, " + ", ".join(f"{c} double" for c in COLS))


def test_hour_clusters_get_their_labels(hours):
    data = cluster.scaled_features(hours, COLS)
    model = cluster.best_kmeans(data, [4], starts=10)[4]
    out = cluster.hour_cluster_summary(cluster.with_clusters(data, model, "avg_traffic"))
    got = {r["cluster"]: (r["label"], r["hours"]) for r in out.collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == [
        "Night (Low Activity)", "Morning Rush", "Midday", "Evening Rush",
    ]
    assert got[1][1] == "0, 1, 2, 3, 4, 5, 23"


def test_mixed_cluster_is_a_numbered_pattern(spark):
    df = spark.createDataFrame(
        [(0, 1.0, 1.0, 1.0, 1), (8, 1.0, 1.0, 1.0, 1), (9, 5.0, 1.0, 1.0, 2)],
        "hour int, avg_traffic double, avg_aqi double, avg_energy double, cluster int",
    )
    got = {r["cluster"]: r["label"] for r in cluster.hour_cluster_summary(df).collect()}
    assert got == {1: "Pattern 1", 2: "Morning Rush"}


def test_elbow_does_not_rise(hours):
    out = cluster.elbow(cluster.scaled_features(hours, COLS), range(1, 6), starts=8)
    costs = [r["wss"] for r in out.orderBy("k").collect()]
    assert costs[0] == pytest.approx(3 * 23) and len(costs) == 5
    assert all(a >= b - 1e-9 for a, b in zip(costs, costs[1:]))


def test_day_labels(spark):
    df = spark.createDataFrame(
        [(1, True, 10.0), (2, False, 20.0), (3, False, 30.0), (3, True, 30.0)],
        "cluster int, is_weekend boolean, total_traffic double",
    ).withColumns({"avg_aqi": F.lit(1.0), "total_energy": F.lit(1.0)})
    got = {r["cluster"]: (r["label"], r["pct_weekend"], r["n_days"])
           for r in cluster.day_cluster_summary(df).collect()}
    assert got == {1: ("Low Activity Days", 100.0, 1), 2: ("Moderate Activity Days", 0.0, 1),
                   3: ("High Activity Days", 50.0, 2)}


def test_principal_components(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    cols = list("wxyz")
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)],
                               "id int, w double, x double, y double, z double")
    pc = cluster.PrincipalComponents(df, cols)
    var = pc.variance().orderBy("component").collect()
    want = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert [r["sd"] ** 2 for r in var] == pytest.approx(list(want))
    assert var[-1]["cumulative"] == pytest.approx(1.0)
    load = np.zeros((4, 4))
    for r in pc.loadings().collect():
        load[cols.index(r["variable"]), r["component"] - 1] = r["loading"]
    assert load.T @ load == pytest.approx(np.eye(4), abs=1e-9)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    got = [(r["PC1"], r["PC2"]) for r in pc.scores(["id"]).orderBy("id").collect()]
    assert np.array(got) == pytest.approx(z @ load[:, :2])


@pytest.mark.parametrize("block_rows", [256, 7])
def test_silhouette(spark, block_rows):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 2))
    own = np.array([0] * 20 + [1] * 19 + [2])
    df = spark.createDataFrame([(i, *map(float, p), int(c)) for i, (p, c) in enumerate(zip(x, own))],
                               "id int, a double, b double, g int")
    got = [r["silhouette"] for r in
           cluster.silhouettes(df, "id", ["a", "b"], "g", block_rows=block_rows).orderBy("id").collect()]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(40):
        if (own == own[i]).sum() == 1:
            want.append(0.0)
            continue
        a = d[i, own == own[i]].sum() / ((own == own[i]).sum() - 1)
        b = min(d[i, own == c].mean() for c in set(own) - {own[i]})
        want.append((b - a) / max(a, b))
    assert got == pytest.approx(want) and all(-1 <= s <= 1 for s in got)


def test_silhouette_by_k_marks_the_true_k(hours):
    data = cluster.scaled_features(hours, COLS)
    out = cluster.silhouette_by_k(data, "hour", COLS, range(2, 6), starts=10).collect()
    assert [r["k"] for r in out if r["is_best"]] == [4] and len(out) == 4


@pytest.mark.parametrize("shape", ["spread", "steps", "lumped"])
def test_local_regression(spark, shape):
    rng = np.random.default_rng(9)
    x = np.sort({
        "spread": rng.uniform(0, 10, 400),
        "steps": rng.integers(0, 24, 400).astype(float),
        "lumped": np.concatenate([rng.normal(3, 1e-4, 200), rng.uniform(0, 10, 200)]),
    }[shape])
    y = np.sin(x) + rng.normal(scale=0.1, size=400)
    df = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(x, y)] + [("flat", 1.0, 2.0)],
                               "g string, x double, y double")
    out = smooth.local_regression(df, F.col("x"), F.col("y"), by=F.col("g"), grid_points=11)
    got = out.orderBy("grid").collect()
    assert [r["grid"] for r in got] == list(range(11))
    for r in got:
        d = np.abs(x - r["x0"])
        h = np.sort(d)[int(0.75 * 400) - 1]
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        coef = np.polyfit((x - r["x0"]) / 10, y, 2, w=np.sqrt(w))
        assert r["fitted"] == pytest.approx(coef[-1], rel=1e-8, abs=1e-8)


@pytest.mark.parametrize("block_rows", [256, 5])
def test_pairwise_distances(spark, block_rows):
    x = np.random.default_rng(3).normal(size=(30, 2))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id int, a double, b double")
    got = cluster.pairwise_distances(df, "id", ["a", "b"], block_rows).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert len(got) == len({(r["i"], r["j"]) for r in got}) == 435
    assert all(r["i"] < r["j"] and r["distance"] == pytest.approx(d[r["i"], r["j"]]) for r in got)
    assert cluster.pairwise_distances(df.limit(0), "id", ["a", "b"]).collect() == []
