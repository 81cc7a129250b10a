"""A quality classifier as a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on the labelled rows; every path from a root to a node is a
conjunctive rule.  A logistic model with a lasso penalty weighs the rules, most of which get weight
zero, and the rest compile into one Spark column expression.  Statistics are SQL functions of the
text alone, computed once per document; only the statistics of a bounded sample of labelled rows
(``SAMPLE_ROWS``) reach the driver.

Defined results: a null or empty text has all statistics zero and gets the score these give; without
labels every score is 0.5; with labels of one class only it is the smoothed share of label 1; rows
repeat as in the input; a null ``doc_id`` is scored but never learned from; an empty table gives an
empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.llm.common import labels_of, remainder, text_of
from sensorspark.session import materialize

SAMPLE_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0
TREES, DEPTH, SHRINK, BINS, MIN_LEAF = 40, 3, 0.3, 32, 10
PENALTY = 2e-3
STEPS = 400
CUT = 0.3
SEED = 7

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether at most, bound)


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text that is not null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))

    chars = F.length(text)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return {
        "n_words": F.size(words).cast("double"),
        "word_length": share(chars, F.size(words)),
        "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": share(F.size(words), F.size(lines)),
        "symbols": share(count(r"[#*$%&<>|@=_{}\[\]\\/~^]"), chars),
        "bangs": share(count(r"[!?]"), chars),
        "digits": share(count(r"[0-9]"), chars),
        "capitals": share(count(r"\p{Lu}"), chars),
        "stops": share(count(r"[.,;:]"), chars),
    }


NAMES = (
    "n_words", "word_length", "distinct_words", "distinct_lines", "line_words", "symbols", "bangs",
    "digits", "capitals", "stops",
)


def _grow(bins: np.ndarray, edges: list[np.ndarray], target: np.ndarray, rows: np.ndarray, features: np.ndarray):
    """Rules and leaf values of one regression tree on binned statistics."""
    rules: list[Rule] = []
    values = np.zeros(len(target))
    stack = [((), rows, np.arange(len(target)), 0)]
    while stack:
        path, own, every, depth = stack.pop()
        if path:
            rules.append(path)
        values[every] = target[own].mean() if len(own) else 0.0
        if depth == DEPTH or len(own) < 2 * MIN_LEAF:
            continue
        total, n, best = target[own].sum(), len(own), (1e-9, None, None)
        for f in features:
            counts = np.bincount(bins[own, f], minlength=BINS)
            left_n = np.cumsum(counts)[:-1]
            left = np.cumsum(np.bincount(bins[own, f], target[own], BINS))[:-1]
            with np.errstate(all="ignore"):
                gain = left**2 / left_n + (total - left) ** 2 / (n - left_n) - total**2 / n
            gain[(left_n < MIN_LEAF) | (n - left_n < MIN_LEAF)] = -1.0
            gain = gain[: len(edges[f])]
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
        _, f, k = best
        if f is None:
            continue
        bound = float(edges[f][k])
        for low in (True, False):
            stack.append(
                (
                    (*path, (int(f), low, bound)),
                    own[(bins[own, f] <= k) == low],
                    every[(bins[every, f] <= k) == low],
                    depth + 1,
                )
            )
    return rules, values


def _rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Distinct rules of boosted trees, each grown on half of the rows and statistics."""
    draw = np.random.default_rng(SEED)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    score, found = np.zeros(len(y)), {}
    for _ in range(TREES):
        rows = draw.choice(len(y), max(1, len(y) // 2), replace=False)
        features = draw.choice(x.shape[1], (x.shape[1] + 1) // 2, replace=False)
        residual = y - 1 / (1 + np.exp(-score))
        rules, values = _grow(bins, edges, residual, rows, features)
        score += SHRINK * 4 * values
        found.update(dict.fromkeys(tuple(sorted(r)) for r in rules))
    return list(found)


def _fires(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float32)
    for j, rule in enumerate(rules):
        for f, low, bound in rule:
            out[:, j] *= (x[:, f] <= bound) == low
    return out


def _lasso(a: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of the penalised logistic model, by accelerated proximal gradient."""
    centre = np.average(a, axis=0, weights=weight)
    a = a - centre.astype(np.float32)
    w, b = np.zeros(a.shape[1], np.float32), 0.0
    # The largest curvature, by a few power iterations.
    v = np.ones(a.shape[1], np.float32)
    for _ in range(20):
        v = a.T @ (weight * (a @ v))
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * (float(v @ (a.T @ (weight * (a @ v)))) + 1) + 1e-6)
    ahead, ahead_b, t = w, b, 1.0
    for _ in range(STEPS):
        residual = (weight * (1 / (1 + np.exp(-(a @ ahead + ahead_b))) - y)).astype(np.float32)
        new = ahead - step * (a.T @ residual)
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        new_b = ahead_b - step * float(residual.sum())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = (new + (t - 1) / t_new * (new - w)).astype(np.float32)
        ahead_b = new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new.astype(np.float32), new_b, t_new
    return w, b - float(centre @ w)


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self, prefix: str = "") -> Column:
        """The score as a column of the statistics named ``NAMES``."""
        out = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            fires = F.lit(True)
            for f, low, bound in rule:
                value = F.col(f"{prefix}{NAMES[f]}")
                fires = fires & (value <= bound if low else value > bound)
            out = out + F.when(fires, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-out))


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """The ensemble for statistics ``x`` and labels ``y``; both classes count alike."""
    ones = int(y.sum())
    if not len(y):
        return Ensemble((), (), 0.0)
    if ones in (0, len(y)):
        share = (ones + 1) / (len(y) + 2)
        return Ensemble((), (), float(np.log(share / (1 - share))))
    rules = _rules(x, y)
    weight = np.where(y == 1, 0.5 / ones, 0.5 / (len(y) - ones)).astype(np.float32)
    w, b = _lasso(_fires(rules, x), y.astype(np.float32), weight)
    used = np.flatnonzero(w)
    return Ensemble(tuple(rules[j] for j in used), tuple(float(w[j]) for j in used), float(b))


def learn(stats: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Ensemble:
    """An ensemble from (doc_id, NAMES) rows outside the held-out fold, at most about ``rows`` of
    them, drawn by a hash of the id."""
    known = stats.join(labels_of(labels, label), F.col("doc_id") == F.col("label_key")).where(
        remainder(F.col("doc_id"), FOLDS) != HELD_OUT
    )
    known = materialize(known.select(*NAMES, "label", F.xxhash64("doc_id", F.lit(SEED)).alias("draw")), "labelled")
    n = known.count()
    if n > rows:
        known = known.where(F.pmod("draw", F.lit(1_000_000)) < int(1_000_000 * rows / n))
    got = known.orderBy("draw", *NAMES).toPandas()
    return fit(got[list(NAMES)].to_numpy(float), got["label"].to_numpy(float))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the statistics of every row of ``docs``."""
    # A foldable-free name keeps each statistic computed once.
    stats = materialize(
        docs.select("doc_id", text_of(docs).alias("t")).select(
            "doc_id", *[c.alias(n) for n, c in statistics(F.col("t")).items()]
        ),
        "statistics",
    )
    model = learn(stats, labels)
    score = stats.withColumn("score", model.column())
    return score.select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"),
        *NAMES,
    )
