"""Ward's tree by mutual nearest pairs against one merge at a time."""

import numpy as np
import pytest

from sensorspark.operators import tree, ward


def brute_ward(x):
    """(left, right, height, size), always merging the pair with the least rise."""
    size = np.ones(len(x))
    centre = x.copy()
    alive = np.ones(len(x), bool)
    gap = ((x[:, None] - x[None]) ** 2).sum(-1)
    rise = np.where(np.triu(np.ones_like(gap), 1) > 0, gap, np.inf)
    out = []
    for _ in range(len(x) - 1):
        i, j = np.unravel_index(np.argmin(rise), rise.shape)
        total = size[i] + size[j]
        out.append((i + 1, j + 1, np.sqrt(rise[i, j]), int(total)))
        centre[i] = (size[i] * centre[i] + size[j] * centre[j]) / total
        size[i], alive[j] = total, False
        rise[j, :] = rise[:, j] = np.inf
        new = 2 * size[i] * size / (size[i] + size) * ((centre - centre[i]) ** 2).sum(-1)
        new[~alive] = np.inf
        rise[i, i + 1 :] = new[i + 1 :]
        rise[:i, i] = new[:i]
    return out


def frame(spark, x):
    columns = [f"c{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, p)) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in columns)), columns


def standardized(x):
    return (x - x.mean(0)) / x.std(0, ddof=1)


@pytest.mark.parametrize("n,dims,leaf,fan", [(7, 3, 128, 16), (2000, 2, 32, 8)])
def test_merges_equal_one_at_a_time(spark, monkeypatch, n, dims, leaf, fan):
    monkeypatch.setattr(tree, "LEAF", leaf)
    monkeypatch.setattr(tree, "FAN", fan)
    x = np.random.default_rng(n).normal(size=(n, dims))
    df, columns = frame(spark, x)
    merges, rows = ward.ward_merges(df, "id", columns)
    got = sorted((r["height"], r["left"], r["right"], r["size"]) for r in merges.collect())
    want = sorted((h, i, j, s) for i, j, h, s in brute_ward(standardized(x)))
    assert [g[1:] for g in got] == [w[1:] for w in want]
    assert [g[0] for g in got] == pytest.approx([w[0] for w in want])
    assert rows.count() == n


@pytest.mark.parametrize("k", [1, 3, 9])
def test_cut(spark, k):
    x = np.random.default_rng(4).normal(size=(7, 2))
    df, columns = frame(spark, x)
    got = {r["id"]: (r["cluster"], r["height"]) for r in ward.ward_cut(df, "id", columns, k=k).collect()}
    group = {i: {i} for i in range(7)}
    height = dict.fromkeys(range(7), 0.0)
    for i, j, h, _ in brute_ward(standardized(x))[: max(0, 7 - k)]:
        group[i - 1] |= group.pop(j - 1)
        height[i - 1] = h
    want = {}
    for number, first in enumerate(sorted(group), 1):
        want |= {m: (number, pytest.approx(height[first])) for m in group[first]}
    assert got == want


def test_ties_repeats_and_small_tables(spark):
    x = np.array([[0.0, 5.0], [0.0, 5.0], [0.0, 5.0], [1.0, 5.0], [3.0, 5.0]])
    df, columns = frame(spark, x)
    merges, _ = ward.ward_merges(df, "id", columns)
    got = sorted((r["height"], r["size"]) for r in merges.collect())
    assert [s for _, s in got] == [2, 3, 4, 5] and got[0][0] == got[1][0] == 0.0
    assert [r["cluster"] for r in ward.ward_cut(df.limit(1), "id", columns).collect()] == [1]
    assert ward.ward_cut(df.limit(0), "id", columns).collect() == []
