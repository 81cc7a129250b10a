"""Forests with known bags: trees, out-of-bag errors and importances against plain recomputation."""

import numpy as np
import pytest

from sensorspark.operators import bagged, forecast

INPUTS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = 5 * x[:, 0] + np.where(x[:, 1] > 0, 2.0, 0.0) + rng.normal(scale=0.1, size=200)
    rows = [(i + 1, *map(float, p), float(t)) for i, (p, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, y double").repartition(3)
    return df, x, y


@pytest.fixture(scope="module")
def forest(data):
    return bagged.grow(data[0], INPUTS, "y", num_trees=6, tried=3, seed=5)


def test_bags_are_draws_with_replacement():
    counts = np.stack([bagged.bag_counts(np.arange(1, 20_001), t, 9) for t in range(5)])
    assert abs((counts == 0).mean() - np.exp(-1)) < 0.01 and abs(counts.mean() - 1) < 0.01
    assert abs(np.corrcoef(counts)[0, 1]) < 0.03
    assert (bagged.bag_counts(np.array([7, 3]), 2, 9) == counts[2][[6, 2]]).all()


def test_leaves_hold_the_means_of_their_bag(data, forest):
    _, x, y = data
    for t, tree in enumerate(forest.trees):
        w = bagged.bag_counts(np.arange(1, 201), t, 5)
        leaf = tree.reach(x)
        assert len(tree.feature) > 9
        for node in set(leaf[w > 0]):
            use = leaf == node
            assert w[use].sum() >= bagged.MIN_NODE
            assert tree.value[node] == pytest.approx((w * y)[use].sum() / w[use].sum())


def test_first_splits_are_the_best_ones(data, forest):
    _, x, y = data

    def left_over(w, go_left):
        return sum((w[s] * (y[s] - np.average(y[s], weights=w[s])) ** 2).sum() for s in (go_left, ~go_left))

    for t, tree in enumerate(forest.trees):
        w = bagged.bag_counts(np.arange(1, 201), t, 5).astype(float)
        ends = [
            (f, c) for f in range(3) for c in np.quantile(x[:, f], np.linspace(0.05, 0.95, 19), method="lower")
            if min(w[x[:, f] <= c].sum(), w[x[:, f] > c].sum()) >= bagged.MIN_NODE
        ]
        least = min(left_over(w, x[:, f] <= c) for f, c in ends)
        own = left_over(w, x[:, tree.feature[0]] <= tree.cut[0])
        # Other cut points than the forest's own may do slightly better.
        assert own <= least * 1.15 and tree.feature[0] == 0


def test_errors_and_importance_equal_plain_recomputation(data, forest):
    df, x, y = data
    donors = forecast.shuffled(df, INPUTS, 7)
    swap = np.array([r["donor"] for r in donors.orderBy("row_id").collect()])
    assert sorted(map(tuple, swap)) == sorted(map(tuple, x))
    errors = bagged.tree_errors(forest, df, donors, "y")
    got = {r["tree"]: r for r in errors.collect()}
    rises = []
    for t, tree in enumerate(forest.trees):
        out = bagged.bag_counts(np.arange(1, 201), t, 5) == 0
        base = ((y - tree.predict(x)) ** 2)[out].mean()
        permuted = []
        for f in range(3):
            other = x.copy()
            other[:, f] = swap[:, f]
            permuted.append(((y - tree.predict(other)) ** 2)[out].mean())
        assert got[t]["n"] == out.sum() and got[t]["mse"] == pytest.approx(base)
        assert got[t]["permuted"] == pytest.approx(permuted)
        rises.append(np.array(permuted) - base)
    rises = np.array(rises)
    want = rises.mean(0) / (rises.std(0) / np.sqrt(6))
    found = {r["feature"]: (r["importance"], r["increase"]) for r in bagged.importance(errors, INPUTS).collect()}
    for f, name in enumerate(INPUTS):
        assert found[name] == (pytest.approx(want[f]), pytest.approx(rises.mean(0)[f]))
    assert found["a"][0] > found["b"][0] > found["c"][0]


def test_layout_does_not_matter(data, forest):
    again = bagged.grow(data[0].repartition(7), INPUTS, "y", num_trees=2, tried=3, seed=5)
    for one, other in zip(again.trees, forest.trees):
        assert one.feature == other.feature and one.cut == other.cut


def test_no_rows_is_an_error(data):
    with pytest.raises(ValueError):
        bagged.grow(data[0].limit(0), INPUTS, "y")
