"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as characters, read by a small recurrent network in both directions, and as a word: the sum
of learned, hashed embeddings of the word and its beginnings.  A second network reads windows of
``WINDOW`` words in both directions, attention pools its states, and a logistic unit scores the window.
Every window of a text is scored (``STRIDE`` apart, half a window, so that every passage of up to half a
window's words lies whole in one); a document's score is its worst window's.

Training: everything is learned by gradients from the two inputs; no counts of words enter.  Labels hold
for documents, so the first round takes some windows of each document under its label, and later
rounds the worst windows of toxic documents as toxic, and the worst and some other windows of clean
documents as clean.  Characters or embedding of a word are hidden now and then, so that either can do
without the other.  At the end a logistic line turns worst windows into documents' odds.  At most
``SAMPLE_DOCS`` labelled documents of class 0 and 1, of at most ``SAMPLE_CHARS`` characters each, are
learned from, drawn by a hash of the id; they are all that reaches the driver.  Scoring reads whole texts
in Arrow batches.

Defined results: a null or empty text has no window and scores zero; without labels, or with one class
only, every text scores the smoothed share of label 1; words of more than ``WORD_CHARS``
characters enter in pieces; rows repeat as in the input; a null ``doc_id`` is scored, never learned
from; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorspark.llm.common import labels_of, remainder, text_of

SAMPLE_DOCS = (1800, 900)
SAMPLE_CHARS = 20_000
FOLDS, HELD_OUT = 4, 2
CUT = 0.3
WINDOW, STRIDE = 48, 24
WORD_CHARS = 24
CHARS, CHAR_DIM, CHAR_HIDDEN = 64, 8, 8
BUCKETS, WORD_DIM, HIDDEN = 16_384, 8, 8
# Lengths of the beginnings that a word's embedding is the sum of, beside its own row.
STARTS = (4, 6)
# Training steps of each round, windows a step, windows of clean and toxic documents in the first round.
STEPS, BATCH, FIRST = (400, 200, 200), 96, (4, 12)
RATE, WORD_RATE, DECAY, FLOOR = 8e-3, 3e-2, 5e-4, 1e-4
# Shares of words whose characters or embedding are hidden in a training step.
HIDE_CHARS, HIDE_WORDS = 0.3, 0.3
CACHE_WORDS = 150_000
CHUNK = 1024
SEED = 11
BEGINS = crc32(b"^")
EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_"


# --- words ---------------------------------------------------------------------------------------


def words_of(text: str) -> list[str]:
    """Lower-case words; overlong ones in pieces."""
    words = text.lower().split()
    if max(map(len, words), default=0) <= WORD_CHARS:
        return words
    return [w[i : i + WORD_CHARS] for w in words for i in range(0, len(w), WORD_CHARS)]


def char_class(c: str) -> int:
    """1 to 26 for a to z, then digits, other letters and other signs, hashed; 0 is padding."""
    n = ord(c)
    if 97 <= n <= 122:
        return n - 96
    if c.isdigit():
        return 27
    return 28 + n % 20 if c.isalpha() else 48 + n % 16


class CharTable(dict):
    """For ``str.translate``: every character to the character of its class."""

    def __missing__(self, code: int) -> str:
        self[code] = chr(char_class(chr(code)) if code else 0)
        return self[code]


_chars = CharTable()


def parts_of(words: list[str]) -> np.ndarray:
    """Rows of the embedding that make up each word: the bare word and its beginnings; 0 fills up."""
    rows = np.zeros((len(words), 1 + len(STARTS)), np.int64)
    for row, word in enumerate(words):
        bare = word.strip(EDGE)
        if bare:
            rows[row, 0] = 1 + crc32(bare.encode("utf-8", "replace")) % BUCKETS
            for j, k in enumerate(STARTS, 1):
                if len(bare) >= k:
                    rows[row, j] = 1 + crc32(bare[:k].encode("utf-8", "replace"), BEGINS) % BUCKETS
    return rows


def windows_of(n: int) -> list[tuple[int, int]]:
    """Windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = [*range(0, n - WINDOW, STRIDE), n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


# --- network -------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def recur(gates: np.ndarray, mask: np.ndarray, u: np.ndarray, reverse: bool, trace: list | None = None) -> np.ndarray:
    """States (T, H, B) of a gated recurrent layer whose inputs are already projected (T, 3H, B).

    Where the mask (T, B) is zero the state stays as it is.  The batch is the last axis, so that every gate is
    one contiguous block.
    """
    size, across = u.shape[0], np.ascontiguousarray(u.T)
    out = np.empty((len(gates), size, gates.shape[2]), gates.dtype)
    h = np.zeros(out.shape[1:], gates.dtype)
    full = mask.all(1)
    for t in reversed(range(len(gates))) if reverse else range(len(gates)):
        own = across @ h
        both = gates[t, : 2 * size] + own[: 2 * size]
        both *= 0.5
        np.tanh(both, out=both)
        both *= 0.5
        both += 0.5
        z, r = both[:size], both[size:]
        inner = own[2 * size :]
        n = r * inner
        n += gates[t, 2 * size :]
        np.tanh(n, out=n)
        move = n - h
        move *= 1 - z
        if not full[t]:
            move *= mask[t]
        if trace is not None:
            trace.append((t, h, z, r, inner, n))
        h = np.add(h, move, out=out[t])
    return out


def unroll(grad: np.ndarray, mask: np.ndarray, u: np.ndarray, trace: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``recur`` with respect to the projected inputs and to ``u``."""
    size = u.shape[0]
    d_gates = np.zeros((len(grad), 3 * size, grad.shape[2]), grad.dtype)
    d_u = np.zeros_like(u)
    d_h = np.zeros(grad.shape[1:], grad.dtype)
    for t, h, z, r, inner, n in reversed(trace):
        d_new = d_h + grad[t]
        m = mask[t]
        d_n = d_new * m * (1 - z) * (1 - n * n)
        d_z = -d_new * m * (n - h) * z * (1 - z)
        d_r = d_n * inner * r * (1 - r)
        d_gates[t] = np.concatenate([d_z, d_r, d_n])
        d_own = np.concatenate([d_z, d_r, d_n * r])
        d_u += h @ d_own.T
        d_h = d_new * (1 - m * (1 - z)) + u @ d_own
    return d_gates, d_u


def start_weights() -> dict[str, np.ndarray]:
    draw = np.random.default_rng(SEED)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (draw.standard_normal(shape) * scale).astype(np.float32)

    w = {"chars": normal(CHARS, CHAR_DIM, scale=0.5), "words": normal(BUCKETS + 1, WORD_DIM, scale=0.01)}
    w["words"][0] = 0
    for name, size, hidden in (("c", CHAR_DIM, CHAR_HIDDEN), ("w", 2 * CHAR_HIDDEN + WORD_DIM, HIDDEN)):
        for way in "fb":
            w[f"{name}{way}_in"] = normal(size, 3 * hidden, scale=0.4)
            w[f"{name}{way}_u"] = normal(hidden, 3 * hidden, scale=0.3)
            w[f"{name}{way}_b"] = np.zeros(3 * hidden, np.float32)
    w["att"] = normal(2 * HIDDEN, HIDDEN, scale=0.4)
    w["att_v"] = normal(HIDDEN, scale=0.4)
    w["out"] = normal(2 * HIDDEN, scale=0.4)
    w["out_b"] = np.zeros(1, np.float32)
    return w


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes (T, B) and their mask (T, B)."""
    width = max(map(len, words), default=1)
    flat = "".join([w.ljust(width, "\0") for w in words]).translate(_chars)
    codes = np.frombuffer(flat.encode("latin-1"), np.uint8).reshape(len(words), width).T.astype(np.int64)
    return codes, (codes > 0).astype(np.float32)


def encode_words(w: dict, words: list[str], trace: list | None = None) -> np.ndarray:
    """Input vectors of words (B, D): states after the last character each way, and the embedding.

    Words of about one length are read together.
    """
    parts = parts_of(words)
    ends = np.empty((len(words), 2 * CHAR_HIDDEN), w["chars"].dtype)
    projected = [w["chars"] @ w[f"c{way}_in"] + w[f"c{way}_b"] for way in "fb"]
    sizes = np.array([-(-len(x) // 3) for x in words])
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        codes, mask = spelled([words[k] for k in own])
        steps: list[list | None] = [None if trace is None else [] for _ in "fb"]
        for k, way in enumerate("fb"):
            gates = np.ascontiguousarray(projected[k][codes].transpose(0, 2, 1))
            states = recur(gates, mask, w[f"c{way}_u"], way == "b", steps[k])
            ends[own, k * CHAR_HIDDEN : (k + 1) * CHAR_HIDDEN] = states[0 if way == "b" else -1].T
        if trace is not None:
            trace.append((own, codes, mask, steps))
    return np.concatenate([ends, w["words"][parts].sum(1)], 1)


def attend(w: dict, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hidden attention layer (T, H, B), weights (T, B) and pooled states (2H, B)."""
    hidden = np.tanh(w["att"].T @ states)
    raw = np.exp(np.minimum(np.tensordot(hidden, w["att_v"], (1, 0)), 30)) * mask
    weights = raw / np.maximum(raw.sum(0), 1e-12)
    return hidden, weights, np.einsum("tb,thb->hb", weights, states)


def _product(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Sum over steps and rows of the outer products of (T, I, B) and (T, J, B)."""
    return np.matmul(x, d.transpose(0, 2, 1)).sum(0)


def gradients(w: dict, index: np.ndarray, mask: np.ndarray, words: list[str], y: np.ndarray, count=1.0, shown=None):
    """Loss and gradients for windows given as word indexes (T, B), each counted ``count`` times.

    ``shown`` (B, 2) says of which words the characters and the embedding are to be seen.
    """
    trace: list = []
    vectors = encode_words(w, words, trace)
    seen = np.ones_like(vectors)
    if shown is not None:
        seen[:, : 2 * CHAR_HIDDEN], seen[:, 2 * CHAR_HIDDEN :] = shown[:, :1], shown[:, 1:]
    vectors *= seen
    x = vectors[index].transpose(0, 2, 1)
    ways, halves = {}, []
    for way, reverse in (("f", False), ("b", True)):
        ways[way] = []
        gates = w[f"w{way}_in"].T @ x + w[f"w{way}_b"][:, None]
        halves.append(recur(gates, mask, w[f"w{way}_u"], reverse, ways[way]))
    states = np.concatenate(halves, 1)
    hidden, weights, pooled = attend(w, states, mask)
    p = _sigmoid(w["out"] @ pooled + w["out_b"])
    g: dict[str, np.ndarray] = {}
    d_logit = (count * (p - y) / len(y)).astype(vectors.dtype)
    g["out"], g["out_b"] = pooled @ d_logit, d_logit.sum(keepdims=True)
    d_pooled = w["out"][:, None] * d_logit
    d_weights = np.einsum("hb,thb->tb", d_pooled, states)
    d_raw = weights * (d_weights - (weights * d_weights).sum(0))
    g["att_v"] = np.einsum("thb,tb->h", hidden, d_raw)
    d_hidden = d_raw[:, None] * w["att_v"][:, None] * (1 - hidden**2)
    g["att"] = _product(states, d_hidden)
    d_states = weights[:, None] * d_pooled + w["att"] @ d_hidden
    d_x = np.zeros_like(x)
    for k, way in enumerate("fb"):
        own = d_states[:, k * HIDDEN : (k + 1) * HIDDEN]
        d_gates, g[f"w{way}_u"] = unroll(own, mask, w[f"w{way}_u"], ways[way])
        g[f"w{way}_in"] = _product(x, d_gates)
        g[f"w{way}_b"] = d_gates.sum((0, 2))
        d_x += w[f"w{way}_in"] @ d_gates
    # Each word's share over all places where it stands.
    order = np.argsort(index, axis=None, kind="stable")
    flat = d_x.transpose(0, 2, 1).reshape(-1, d_x.shape[1])[order]
    at = index.reshape(-1)[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    d_vectors = np.zeros_like(vectors)
    d_vectors[at[first]] = np.add.reduceat(flat, first)
    d_vectors *= seen
    g["words"] = np.zeros_like(w["words"])
    np.add.at(g["words"], parts_of(words), d_vectors[:, None, 2 * CHAR_HIDDEN :])
    g["words"][0] = 0
    g["chars"] = np.zeros_like(w["chars"])
    for k, way in enumerate("fb"):
        g[f"c{way}_u"] = np.zeros_like(w[f"c{way}_u"])
        # What reaches each character's projection, whatever its place.
        by_char = np.zeros((CHARS, 3 * CHAR_HIDDEN), vectors.dtype)
        for own, codes, char_mask, steps in trace:
            grad = np.zeros((len(codes), CHAR_HIDDEN, len(own)), vectors.dtype)
            grad[0 if way == "b" else -1] = d_vectors[own, k * CHAR_HIDDEN : (k + 1) * CHAR_HIDDEN].T
            d_gates, d_u = unroll(grad, char_mask, w[f"c{way}_u"], steps[k])
            g[f"c{way}_u"] += d_u
            flat = (d_gates * char_mask[:, None]).transpose(1, 0, 2).reshape(3 * CHAR_HIDDEN, -1)
            by_char += np.stack([np.bincount(codes.reshape(-1), row, CHARS) for row in flat], 1).astype(vectors.dtype)
        g[f"c{way}_in"] = w["chars"].T @ by_char
        g[f"c{way}_b"] = by_char.sum(0)
        g["chars"] += by_char @ w[f"c{way}_in"].T
    loss = -np.mean(count * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
    return float(loss), g


def calibration(worst: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn the log odds of worst windows into those of documents, by Newton
    steps of a logistic fit in which both classes count alike and the slope is held near one."""
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max(len(y) - y.sum(), 1))
    x = np.stack([worst, np.ones_like(worst)], 1)
    c, pull = np.array([1.0, 0.0]), np.array([1e-3, 1e-4])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        slope = x.T @ (weight * (p - y)) + pull * (c - [1.0, 0.0])
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        c = c - np.clip(np.linalg.solve(bend, slope), -1, 1)
    return float(c[0]), float(c[1])


class Model:
    """Weights, ready to score texts; ``share`` stands in where nothing was learned."""

    def __init__(self, weights: dict | None, share: float, line: tuple[float, float] = (1.0, 0.0)):
        self.weights, self.share, self.line = weights, share, line
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.inputs = np.zeros((1024, 6 * HIDDEN), np.float32)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "share": self.share, "line": self.line}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _learn_words(self, words: set[str]) -> None:
        """Projected inputs of words not met before, kept in one table per worker."""
        if len(self.index) + len(words) > CACHE_WORDS:
            self._forget()
        fresh = sorted((w for w in words if w not in self.index), key=len)
        while len(self.inputs) < len(self.index) + len(fresh) + 1:
            self.inputs = np.concatenate([self.inputs, np.zeros_like(self.inputs)])
        w = self.weights
        into = np.concatenate([w["wf_in"], w["wb_in"]], 1)
        bias = np.concatenate([w["wf_b"], w["wb_b"]])
        for at in range(0, len(fresh), CHUNK):
            part = fresh[at : at + CHUNK]
            first = len(self.index) + 1
            self.inputs[first : first + len(part)] = encode_words(w, part) @ into + bias
            self.index.update(zip(part, range(first, first + len(part)), strict=True))

    def window_scores(self, docs: list[list[str]]) -> list[np.ndarray]:
        """The scores of every window of each document."""
        self._learn_words({x for words in docs for x in words})
        spans = [windows_of(len(words)) for words in docs]
        flat = np.fromiter((self.index[x] for words in docs for x in words), np.int64)
        firsts = np.cumsum([0, *map(len, docs)])
        starts = np.array([a + first for own, first in zip(spans, firsts) for a, _ in own], np.int64)
        sizes = np.array([b - a for own in spans for a, b in own], np.int64)
        w, scores = self.weights, np.zeros(len(starts), np.float32)
        order = np.argsort(sizes, kind="stable")
        for at in range(0, len(order), CHUNK):
            part = order[at : at + CHUNK]
            places = np.arange(sizes[part].max())[:, None]
            index = flat[np.minimum(starts[part] + places, len(flat) - 1)]
            index[places >= sizes[part]] = 0
            mask = (index > 0).astype(np.float32)
            gates = np.ascontiguousarray(self.inputs[index].transpose(0, 2, 1))
            forth = recur(gates[:, : 3 * HIDDEN], mask, w["wf_u"], False)
            back = recur(gates[:, 3 * HIDDEN :], mask, w["wb_u"], True)
            pooled = attend(w, np.concatenate([forth, back], 1), mask)[2]
            logits = w["out"] @ pooled + w["out_b"]
            scores[part] = _sigmoid(self.line[0] * logits + self.line[1])
        return np.split(scores, np.cumsum([len(own) for own in spans])[:-1]) if docs else []

    def score(self, texts: list[str]) -> list[float]:
        if self.weights is None:
            return [self.share] * len(texts)
        out: list[float] = []
        group, held = [], 0
        # A few texts at a time, so that a worker never holds many windows.
        for text in [*texts, None]:
            if text is None or held > 400_000:
                out += [float(s.max()) if len(s) else 0.0 for s in self.window_scores(group)]
                group, held = [], 0
            if text is not None:
                group.append(words_of(text))
                held += len(text)
        return out


def train(texts: list[str], labels: np.ndarray) -> Model:
    """A model for texts and labels 0 or 1."""
    ones = int(labels.sum())
    share = (ones + 1) / (len(labels) + 2)
    if ones in (0, len(labels)):
        return Model(None, share)
    draw = np.random.default_rng(SEED)
    docs = [words_of(t) for t in texts]
    spans = [windows_of(len(d)) for d in docs]
    full = [d for d in range(len(docs)) if spans[d]]
    weights = start_weights()
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    step = 0
    for turn, steps in enumerate(STEPS):
        # Nothing is known of windows at first: some of every document, those of toxic ones as toxic.
        ranks = Model(weights, share).window_scores([docs[d] for d in full]) if turn else None
        chosen: list[tuple[int, int, float]] = []
        for at, d in enumerate(full):
            any_of = draw.permutation(len(spans[d]))
            if ranks is None:
                chosen += [(d, int(k), float(labels[d])) for k in any_of[: FIRST[int(labels[d])]]]
                continue
            order = np.argsort(-ranks[at], kind="stable")
            if labels[d]:
                chosen += [(d, int(k), 1.0) for k in order[:3] if ranks[at][k] > 0.6 * ranks[at][order[0]]]
            else:
                chosen += [(d, int(k), 0.0) for k in {*order[:2].tolist(), *any_of[:1].tolist()}]
        toxic = sum(y for _, _, y in chosen)
        boost = min(max((len(chosen) - toxic) / max(toxic, 1.0), 1.0), 10.0)
        for number_of in range(steps):
            at = number_of * BATCH % len(chosen)
            if at < BATCH:
                draw.shuffle(chosen)
            part = chosen[at : at + BATCH]
            number: dict[str, int] = {}
            index = np.zeros((WINDOW, len(part)), np.int64)
            mask = np.zeros((WINDOW, len(part)), np.float32)
            for j, (d, k, _) in enumerate(part):
                a, b = spans[d][k]
                index[: b - a, j] = [number.setdefault(x, len(number)) for x in docs[d][a:b]]
                mask[: b - a, j] = 1
            y = np.array([p[2] for p in part], np.float32)
            # Either input of a word is hidden now and then, never both, so that each learns to do without the other.
            hidden = draw.random((len(number), 1))
            shown = np.concatenate([hidden >= HIDE_CHARS, hidden < 1 - HIDE_WORDS], 1).astype(np.float32)
            _, grads = gradients(weights, index, mask, list(number), y, np.where(y > 0, boost, 1.0), shown)
            size = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                weights[k] *= 1 - DECAY
                rate = WORD_RATE if k == "words" else RATE
                weights[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + FLOOR)
    ranks = Model(weights, share).window_scores([docs[d] for d in full])
    worst = np.array([r.max() for r in ranks], float).clip(1e-6, 1 - 1e-6)
    return Model(weights, share, calibration(np.log(worst / (1 - worst)), labels[full]))


# --- on Spark ------------------------------------------------------------------------------------


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A model from a bounded sample of labelled documents outside the held-out fold."""
    known = labels_of(labels, label).where(remainder(F.col("label_key"), FOLDS) != HELD_OUT)
    drawn = F.xxhash64("label_key", F.lit(SEED))
    parts = [known.where(F.col("label") == k).orderBy(drawn, "label_key").limit(SAMPLE_DOCS[k]) for k in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))
    got = (
        docs.select("doc_id", text_of(docs).alias("text"))
        .join(sample, F.col("doc_id") == F.col("label_key"))
        .where(F.length("text").between(1, SAMPLE_CHARS))
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.min("label").alias("label"))
        .toPandas()
        .sort_values("doc_id")
    )
    return train(got["text"].tolist(), got["label"].to_numpy(int))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model.value
        for batch in texts:
            yield pd.Series(own.score(batch.tolist()), dtype="float64")

    score.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    value = F.pandas_udf(score, "double")
    out = docs.select("doc_id", value(text_of(docs)).alias("score"))
    return out.select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"),
    )
