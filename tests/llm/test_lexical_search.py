import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from sensorspark.llm import lexical_search
from sensorspark.llm.plans import QUERIES
from tests_llm_data import SF_DIR, read

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return PATTERN.findall((text or "").translate(UPPER))


def by_hand(docs, items, top=10):
    """Scores of all documents for all items, straight from the definition."""
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, counts, n in held:
            score = 0
            for t in terms(text):
                if counts[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + (75 * n * n_docs) // n_terms
                    score += w * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [
            (item, rank, None if missing else doc, -score)
            for rank, (score, missing, doc) in enumerate(sorted(scored)[:top], 1)
        ]
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, score string, n int")
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, query string")
    return sorted((tuple(r) for r in lexical_search.search(d, q, **more).collect()), key=str)


def made(seed, n_docs, n_items, words):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (1 + i) for i in range(words)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(n_docs)]
    docs += [(n_docs + i, docs[rng.randrange(n_docs)][1]) for i in range(n_docs // 5)]
    docs += [(n_docs * 2 + i, "w3 w3 w9 copy of many") for i in range(n_docs // 3)]
    rng.shuffle(docs)
    return docs, [(i, text(rng.randrange(1, 15))) for i in range(n_items)] + [(99, "w3 w9 copy many")]


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_brute_force(spark, seed):
    docs, items = made(seed, 400, 12, 300)
    assert found(spark, docs, items) == by_hand(docs, items)


def test_many_segments_and_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "QUERY_TERMS", 12)
    docs, items = made(7, 300, 6, 80)
    assert found(spark, docs, items, top=3) == by_hand(docs, items, top=3)


def test_segments_keep_what_they_found():
    """Best documents carried over segments equal those of a single one, while blocks are skipped."""
    rng = np.random.default_rng(5)
    n, width = 3000, 120
    dense = (rng.random((n, width)) < 0.1) * rng.integers(1, 1000, (n, width))
    scored = {}
    for size in (n, 250):
        best = lexical_search.Best(10)
        for start in range(0, n, size):
            part = dense[start : start + size]
            position, term = np.nonzero(part)
            ids = np.arange(start, start + len(part))
            segment = lexical_search.Segment(ids, position, term, part[position, term], width)
            order = np.array([3, 50, 7, 90, 11])
            lexical_search.search_segment(segment, order, np.array([90, 70, 50, 20, 1]), best)
        scored[size] = best.ids.tolist(), best.scores.tolist()
    exact = dense[:, [3, 50, 7, 90, 11]] @ np.array([90, 70, 50, 20, 1])
    order = np.lexsort((np.arange(n), -exact))[:10]
    assert scored[n] == scored[250] == (order.tolist(), exact[order].tolist())


def test_blocks_are_skipped_and_summaries_bound(spark):
    rng = np.random.default_rng(2)
    topic = np.repeat(np.arange(40), 50)
    dense = np.zeros((2000, 200), np.int64)
    for row, t in enumerate(topic):
        dense[row, rng.choice(np.arange(t * 5, t * 5 + 5), 3, replace=False)] = rng.integers(100, 1000, 3)
        dense[row, 199] = rng.integers(1, 50)
    position, term = np.nonzero(dense)
    segment = lexical_search.Segment(np.arange(2000), position, term, dense[position, term], 200)
    parts, summaries, _ = segment.blocks_of(199)
    assert sorted(np.concatenate(parts)) == list(np.flatnonzero(dense[:, 199]))
    assert max(map(len, parts)) <= lexical_search.MOST_DOCS
    for part, summary in zip(parts, summaries):
        assert (dense[part].max(axis=0) == summary).all()
    # Blocks of one topic are what makes a bound useful: most are no better than their documents.
    factors = np.array([50, 50, 50, 1])
    bounds = summaries[:, [0, 1, 2, 199]] @ factors
    exact = dense[:, [0, 1, 2, 199]] @ factors
    assert (bounds < np.sort(exact)[-10]).mean() > 0.8
    searched = []
    full = segment.table
    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, tuple) and len(key) == 2 and not isinstance(key[0], slice):
                searched.append(np.size(key[0]))
            return np.asarray(super().__getitem__(key))
    segment.table = full.view(Watched)
    best = lexical_search.Best(10)
    lexical_search.search_segment(segment, np.array([0, 1, 2, 199]), factors, best)
    assert best.scores.tolist() == np.sort(exact)[::-1][:10].tolist()
    assert sum(searched) < 400


def test_odd_tables(spark):
    long = " ".join(f"t{i % 5000}" for i in range(200_000))
    docs = [
        (1, "Ünï Çode 中文 ABC abc_def"), (1, "Ünï Çode 中文 ABC abc_def"), (None, "abc 中文"), (None, None), (2, ""),
        (3, " \n--"), (4, long), (5, "İ ABC"), (6, "t7 abc"), (0, "t7 abc"),
    ]
    items = [(1, "abc ABC"), (1, "abc ABC"), (None, "中文 t7"), (2, None), (3, ""), (4, "nowhere"), (5, "ünï ÜNÏ"), (6, long[:3000])]
    assert found(spark, docs, items) == by_hand(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
    assert found(spark, [(1, None)], items) == []


def test_lengths_beyond_64_bits():
    got = lexical_search.saturation(np.array([2]), np.array([10**8]), 10**11, 10**13)
    m = 100 - 75 + (75 * 10**8 * 10**11) // 10**13
    assert got.tolist() == [(10**9 * 2) // (2000 + 8 * m)]


def test_the_given_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in read(spark, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in read(spark, "benchmark").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_lexical_search"](spark, SF_DIR).collect()), key=str)
    assert got == by_hand(docs, items)
