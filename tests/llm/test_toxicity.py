import pickle
import random

import numpy as np
import pytest

from sensorspark.llm import toxicity as t


def test_gradients_equal_differences():
    w = {k: v.astype(float) for k, v in t.start_weights().items()}
    draw = np.random.default_rng(0)
    w["words"][1:] += draw.normal(0, 0.5, w["words"][1:].shape)
    index, mask = draw.integers(0, 4, (5, 3)), np.ones((5, 3))
    mask[3:, 1] = 0
    shown = np.array([[1.0, 1.0], [0.0, 1.0], [1.0, 0.0], [1.0, 1.0]])
    args = (index, mask, ["idiot", "the", "lowei,", "x"], np.array([1.0, 0, 1]), 2.0, shown)
    _, grads = t.gradients(w, *args)
    for name, g in grads.items():
        flat, j = w[name].reshape(-1), int(np.argmax(np.abs(g)))
        before, step = flat[j], 1e-3
        flat[j] = before + step
        high, _ = t.gradients(w, *args)
        flat[j] = before - step
        low, _ = t.gradients(w, *args)
        flat[j] = before
        assert (high - low) / (2 * step) == pytest.approx(g.reshape(-1)[j], rel=0.02, abs=3e-4), name


def test_windows_cover_and_overlap():
    assert t.windows_of(0) == [] and t.windows_of(5) == [(0, 5)]
    for n in (t.WINDOW, t.WINDOW + 1, 100, 1000, 1001):
        spans = t.windows_of(n)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(b - a == t.WINDOW for a, b in spans)
        assert all(c < b for (_, b), (c, _) in zip(spans, spans[1:]))


def test_passages_of_half_a_window_lie_whole_in_one():
    for n in (t.WINDOW + 1, 100, 1000, 1001):
        spans = t.windows_of(n)
        for at in range(n - t.WINDOW // 2 + 1):
            assert any(a <= at and at + t.WINDOW // 2 <= b for a, b in spans), (n, at)


def corpus(n, seed):
    draw = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        words = [f"w{draw.randrange(300)}" for _ in range(draw.randint(5, 300))]
        if k % 4 == 0:
            words.insert(draw.randint(0, len(words)), draw.choice(["grobian", "grobiane,", "Grobians", "flegel"]))
        texts.append(" ".join(words))
        labels.append(int(k % 4 == 0))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def model():
    return t.train(*corpus(400, 1))


def test_learns_words_and_their_beginnings(model):
    texts, y = corpus(200, 2)
    s = np.array(model.score(texts))
    assert (s[y == 1] >= t.CUT).mean() > 0.9 and (s[y == 0] >= t.CUT).mean() < 0.1
    # A form that training has not seen, far inside a long text.
    long = " ".join(["w1 w2 w3"] * 3000)
    assert model.score([long + " grobianisch " + long])[0] > 10 * model.score([long])[0]


def ranking(model, texts, y):
    """Share of pairs of a toxic and a clean text that are scored in the right order."""
    s = np.array(model.score(texts))
    return np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])


def without(model, *names):
    weights = model.weights | {name: np.zeros_like(model.weights[name]) for name in names}
    return t.Model(weights, model.share, model.line)


def test_both_inputs_carry_the_score(model):
    texts, y = corpus(200, 2)
    assert ranking(model, texts, y) > 0.95
    assert ranking(without(model, "chars"), texts, y) > 0.9
    assert ranking(without(model, "words"), texts, y) > 0.8
    # With neither, only the numbers of words and characters are left.
    assert ranking(without(model, "words", "chars"), texts, y) < 0.75


def test_parts_depend_on_the_word_alone():
    words = ["grobian", "(grobiane,", "gro", "x", "--", "größe", "v" * t.WORD_CHARS, "grob"]
    together = t.parts_of(words)
    assert all((t.parts_of([w])[0] == row).all() for w, row in zip(words, together))
    assert (together[0][1:] == together[1][1:]).all() and together[0][0] != together[1][0]
    assert (together[4] == 0).all() and (together[2][1:] == 0).all() and together[7][1] == together[0][1]
    assert t.parts_of([]).shape == (0, 1 + len(t.STARTS))


def plain_score(model, words):
    """A window's score word by word and letter by letter."""
    w = {k: v.astype(float) for k, v in model.weights.items()}

    def walk(inputs, way, size):
        h, states = np.zeros(size), []
        for x in inputs:
            own, into = h @ w[way + "_u"], x @ w[way + "_in"] + w[way + "_b"]
            z, r = (1 / (1 + np.exp(-(into + own)[k * size : (k + 1) * size])) for k in (0, 1))
            n = np.tanh(into[2 * size :] + r * own[2 * size :])
            h = z * h + (1 - z) * n
            states.append(h)
        return states

    vectors = []
    for word in words:
        letters = [w["chars"][t.char_class(c)] for c in word]
        own = sum(w["words"][k] for k in t.parts_of([word])[0])
        forth, back = walk(letters, "cf", t.CHAR_HIDDEN)[-1], walk(letters[::-1], "cb", t.CHAR_HIDDEN)[-1]
        vectors.append(np.concatenate([forth, back, own]))
    both = zip(walk(vectors, "wf", t.HIDDEN), walk(vectors[::-1], "wb", t.HIDDEN)[::-1])
    states = [np.concatenate(pair) for pair in both]
    raw = np.exp([np.tanh(x @ w["att"]) @ w["att_v"] for x in states])
    logit = sum(a * x for a, x in zip(raw / raw.sum(), states)) @ w["out"] + w["out_b"][0]
    return 1 / (1 + np.exp(-(model.line[0] * logit + model.line[1])))


def test_scores_equal_plain_recomputation(model):
    texts = [*corpus(12, 5)[0], "one", "two (words)", "größe 12 x" * 30]
    docs = [t.words_of(x) for x in texts]
    for words, got in zip(docs, model.window_scores(docs), strict=True):
        want = [plain_score(model, words[a:b]) for a, b in t.windows_of(len(words))]
        assert np.allclose(got, want, atol=1e-4)


def test_scores_do_not_depend_on_company(model):
    texts, _ = corpus(40, 3)
    together = model.score(texts)
    again = pickle.loads(pickle.dumps(model))
    alone = [again.score([x])[0] for x in reversed(texts)][::-1]
    assert np.allclose(together, alone, atol=1e-4)
    assert model.score(["", " \n", "x" * 5000])[:2] == [0.0, 0.0]


def test_on_tables(spark, odd_docs, no_docs, no_labels):
    got = t.scored(odd_docs, no_labels).collect()
    assert len(got) == odd_docs.count() and {r.score for r in got} == {0.5}
    assert t.scored(no_docs, no_labels).count() == 0
    texts, y = corpus(120, 4)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id bigint, text string")
    known = spark.createDataFrame([(i, int(v), None) for i, v in enumerate(y)], "doc_id bigint, toxic int, extra string")
    out = t.scored(docs.unionByName(odd_docs.select("doc_id", "text")), known).collect()
    assert len(out) == 120 + odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= t.CUT) for r in out)
