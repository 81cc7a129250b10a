"""Regression forests with known out-of-bag rows, and permutation importance on these.

How often a row is drawn for a tree is a function of (seed, tree, row id), a Poisson(1) count as
sampling with replacement gives it; a row with count zero is out of that tree's bag.  So bags need no
storage and are the same for any layout of the table.

All trees grow together, one level per scan.  A task fills histograms of (node, feature, bin) with
weights and weighted labels, at most ``NODES_AT_ONCE`` nodes at a time; the histograms of a node meet
in one group, which picks the split.  The driver holds the trees only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Forest size, features tried per split and smallest node.
NUM_TREES = 100
FEATURES_PER_SPLIT = 4
MIN_NODE = 5
MAX_DEPTH = 30
BINS = 32
NODES_AT_ONCE = 4096
# Cumulated Poisson(1) probabilities of 0 to 7 draws.
_DRAWS = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040], float))


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers (a multiply-and-shift finalizer)."""
    z = numbers + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bag_counts(row_ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in the bag of ``tree``."""
    key = _mixed(np.array([seed * 1_000_003 + tree], np.uint64))
    share = (_mixed(row_ids.astype(np.uint64) ^ key) >> np.uint64(11)).astype(float) / 2.0**53
    return np.searchsorted(_DRAWS, share, side="right")


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1.  Rows with a value <= cut go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def reach(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of ``x``."""
        feature, cut = np.array(self.feature), np.array(self.cut)
        left, right = np.array(self.left), np.array(self.right)
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            inner = feature[node] >= 0
            if not inner.any():
                return node
            at, which = node[inner], rows[inner]
            node[inner] = np.where(x[which, feature[at]] <= cut[at], left[at], right[at])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.reach(x)]

    def split(self, node: int, feature: int, cut: float, values: tuple[float, float]) -> tuple[int, int]:
        first = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, first, first + 1
        for v in values:
            self.feature.append(-1)
            self.cut.append(0.0)
            self.left.append(0)
            self.right.append(0)
            self.value.append(v)
        return first, first + 1


@dataclass
class Forest:
    trees: list[Tree]
    inputs: list[str]
    seed: int


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return batch.column("row_id").to_numpy(), batch.column("y").to_numpy(zero_copy_only=False), x


_HISTOGRAM = pa.schema([("node", pa.int32()), ("hist", pa.list_(pa.float64()))])


def _histograms(
    batches: Iterator[pa.RecordBatch], trees: list[Tree], active: list[tuple[int, int]], cuts: list[np.ndarray], seed: int
) -> Iterator[pa.RecordBatch]:
    """Per active (tree, node): weights and weighted labels by feature and bin, over a task's rows."""
    places: dict[int, list[tuple[int, int]]] = {}
    for place, (tree, node) in enumerate(active):
        places.setdefault(tree, []).append((node, place))
    p = len(cuts)
    hist = np.zeros((len(active), p, BINS, 2))
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, y, x = _arrays(batch)
        bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        for tree, held in places.items():
            place_of = np.full(len(trees[tree].feature), -1)
            place_of[[n for n, _ in held]] = [at for _, at in held]
            draws = bag_counts(ids, tree, seed)
            at = place_of[trees[tree].reach(x)]
            use = (draws > 0) & (at >= 0)
            w, wy, at, b = draws[use].astype(float), (draws * y)[use], at[use], bins[use]
            for f in range(p):
                np.add.at(hist[:, f, :, 0], (at, b[:, f]), w)
                np.add.at(hist[:, f, :, 1], (at, b[:, f]), wy)
    seen = np.flatnonzero(hist[:, 0, :, 0].sum(axis=1))
    if len(seen):
        flat = hist[seen].reshape(-1)
        offsets = np.arange(len(seen) + 1, dtype=np.int32) * (p * BINS * 2)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), lists], schema=_HISTOGRAM)


_SPLIT = "node int, n double, value double, feature int, bin int, left double, right double"
_SPLIT_SCHEMA = pa.schema(
    [("node", pa.int32()), ("n", pa.float64()), ("value", pa.float64()), ("feature", pa.int32()), ("bin", pa.int32()),
     ("left", pa.float64()), ("right", pa.float64())]
)


def _choose(table: pa.Table, p: int, tried: int, seed: int, active: list[tuple[int, int]]) -> pa.Table:
    """The split of one node that lowers the squared error most, among some drawn features."""
    node = table.column("node")[0].as_py()
    hist = np.sum([np.array(h) for h in table.column("hist").to_pylist()], axis=0).reshape(p, BINS, 2)
    n, total = hist[0, :, 0].sum(), hist[0, :, 1].sum()
    rng = np.random.default_rng([seed, *active[node]])
    best = (0.0, -1, 0, 0.0, 0.0)
    for f in sorted(rng.permutation(p)[:tried].tolist()):
        w, s = hist[f, :, 0].cumsum()[:-1], hist[f, :, 1].cumsum()[:-1]
        ok = (w >= MIN_NODE) & (n - w >= MIN_NODE)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, s * s / w + (total - s) ** 2 / (n - w) - total * total / n, -np.inf)
        b = int(gain.argmax())
        if gain[b] > best[0] + 1e-12 * max(1.0, total * total / n):
            best = (float(gain[b]), f, b, s[b] / w[b], (total - s[b]) / (n - w[b]))
    return pa.Table.from_pylist(
        [{"node": node, "n": n, "value": total / n, "feature": best[1], "bin": best[2], "left": best[3], "right": best[4]}],
        _SPLIT_SCHEMA,
    )


def grow(
    rows: DataFrame, inputs: list[str], label: str, num_trees: int = NUM_TREES, tried: int = FEATURES_PER_SPLIT, seed: int = 123
) -> Forest:
    """A forest on ``rows`` (a written table with a unique ``row_id``); rows with nulls must be gone."""
    data = prepared(rows, inputs, label)
    x = F.col("x")
    marks = [i / BINS for i in range(1, BINS)]
    # Thirty-one cut points per input.
    found = data.agg(*[F.percentile_approx(x[f], marks, 10_000).alias(f"c{f}") for f in range(len(inputs))]).first()
    if found["c0"] is None:
        raise ValueError("no rows to train on")
    cuts = [np.unique(np.array(found[f"c{f}"], float)) for f in range(len(inputs))]
    trees = [Tree() for _ in range(num_trees)]
    frontier = [(t, 0) for t in range(num_trees)]
    for depth in range(MAX_DEPTH + 1):
        if not frontier:
            break
        following = []
        for first in range(0, len(frontier), NODES_AT_ONCE):
            active = frontier[first : first + NODES_AT_ONCE]
            partial = data.mapInArrow(
                lambda batches: _histograms(batches, trees, active, cuts, seed), "node int, hist array<double>"
            )
            chosen = partial.groupBy("node").applyInArrow(
                lambda table: _choose(table, len(inputs), tried, seed, active), _SPLIT
            )
            # One row per active node.
            for r in chosen.collect():
                tree, node = active[r["node"]]
                trees[tree].value[node] = r["value"]
                if r["feature"] >= 0 and depth < MAX_DEPTH and r["bin"] < len(cuts[r["feature"]]):
                    cut = float(cuts[r["feature"]][r["bin"]])
                    following += [(tree, c) for c in trees[tree].split(node, r["feature"], cut, (r["left"], r["right"]))]
        frontier = following
    return Forest(trees, inputs, seed)


def prepared(rows: DataFrame, inputs: list[str], label: str) -> DataFrame:
    return rows.select(
        F.col("row_id").cast("long").alias("row_id"),
        F.col(label).cast("double").alias("y"),
        F.array(*[F.col(c).cast("double") for c in inputs]).alias("x"),
    )


# --- out-of-bag error and importance --------------------------------------------------------


_ERRORS = pa.schema([("tree", pa.int32()), ("n", pa.int64()), ("sse", pa.list_(pa.float64()))])


def _errors(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    """Per tree over a task's out-of-bag rows: squared error as they are, and with each input of a donor."""
    p = len(forest.inputs)
    n, sse = np.zeros(len(forest.trees), np.int64), np.zeros((len(forest.trees), p + 1))
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, y, x = _arrays(batch)
        other = batch.column("donor").flatten().to_numpy(zero_copy_only=False).reshape(x.shape)
        for t, tree in enumerate(forest.trees):
            out = bag_counts(ids, t, forest.seed) == 0
            own, truth = x[out], y[out]
            n[t] += len(own)
            sse[t, 0] += ((truth - tree.predict(own)) ** 2).sum()
            used = {f for f in tree.feature if f >= 0}
            for f in range(p):
                if f not in used:
                    sse[t, f + 1] += ((truth - tree.predict(own)) ** 2).sum() if len(own) else 0.0
                    continue
                swapped = own.copy()
                swapped[:, f] = other[out, f]
                sse[t, f + 1] += ((truth - tree.predict(swapped)) ** 2).sum()
    rows = [{"tree": t, "n": int(n[t]), "sse": sse[t].tolist()} for t in range(len(n)) if n[t]]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ERRORS)


def tree_errors(forest: Forest, rows: DataFrame, donors: DataFrame, label: str) -> DataFrame:
    """(tree, n, mse, permuted): out-of-bag squared error of every tree, and per input with that input
    taken from another row.  ``donors`` has row_id and an array ``donor`` of the inputs' values."""
    paired = prepared(rows, forest.inputs, label).join(donors, "row_id")
    partial = paired.mapInArrow(lambda batches: _errors(batches, forest), "tree int, n long, sse array<double>")
    p = len(forest.inputs)
    sums = partial.groupBy("tree").agg(F.sum("n").alias("n"), *[F.sum(F.col("sse")[i]).alias(f"e{i}") for i in range(p + 1)])
    return sums.select(
        "tree", "n", (F.col("e0") / F.col("n")).alias("mse"),
        F.array(*[F.col(f"e{i + 1}") / F.col("n") for i in range(p)]).alias("permuted"),
    )


def importance(errors: DataFrame, inputs: list[str]) -> DataFrame:
    """(feature, importance, increase): how much the out-of-bag error grows, on average over the
    trees, and that over its standard error across trees (the increase itself where that is zero)."""
    rise = F.array(
        *[F.struct(F.lit(f).alias("feature"), (F.col("permuted")[i] - F.col("mse")).alias("rise")) for i, f in enumerate(inputs)]
    )
    grown = errors.select(F.inline(rise)).groupBy("feature").agg(
        F.avg("rise").alias("increase"), (F.stddev_pop("rise") / F.sqrt(F.count(F.lit(1)))).alias("_error")
    )
    scaled = F.when(F.col("_error") > 0, F.col("increase") / F.col("_error")).otherwise(F.col("increase"))
    return grown.select("feature", scaled.alias("importance"), "increase")
