import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sensorspark.llm import periodic_runs
from sensorspark.llm.common import table
from sensorspark.llm.plans import QUERIES
from tests_llm_data import SF_DIR, documents


def by_hand(words):
    """Every period is tried at every place; smaller periods of a stretch are looked for directly."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            stretch = words[start : i + q]
            if len(stretch) >= max(6, 4 * q) and all(stretch[d:] != stretch[:-d] for d in range(1, q)):
                out.append((start, len(stretch), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def compare(lists):
    got = periodic_runs.examine([" ".join(w).encode() for w in lists]).to_pylist()
    for words, result in zip(lists, got):
        runs = by_hand(words)
        assert [(r["start"], r["length"], r["period"]) for r in result["runs"]] == runs
        assert result["collapsed"] == collapsed(words, runs)
        assert result["n_words"] == len(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=70), max_size=4))
def test_small_alphabets_equal_brute_force(lists):
    compare(lists)


@pytest.mark.parametrize("seed", range(6))
def test_planted_repeats_equal_brute_force(seed):
    rng = random.Random(seed)
    lists = []
    for _ in range(25):
        n = rng.choice([5, 6, 23, 64, 129, 300])
        words = [f"w{rng.randrange(rng.choice([2, 5, 200]))}" for _ in range(n)]
        for _ in range(rng.randrange(4)):
            a, p = rng.randrange(n), rng.randrange(1, max(2, n // 4))
            for i in range(a, min(n, a + rng.randrange(p, 7 * p))):
                words[i] = words[a + (i - a) % p]
        lists.append(words)
    compare(lists)


def test_blocks_do_not_cross_texts():
    got = periodic_runs.examine([b"a a a", b"a a a a a a", b"", b"a a a"]).to_pylist()
    assert [len(r["runs"]) for r in got] == [0, 1, 0, 0]


def test_transforms_are_inverse_and_exact():
    for prime, generator in periodic_runs.PRIMES:
        values = np.random.default_rng(3).integers(0, prime, (64, 7)).astype(np.uint64)
        turned = periodic_runs.backward(periodic_runs.forward(values.copy(), prime, generator), prime, generator)
        assert (turned == values).all()


@pytest.mark.parametrize("largest", [3, 1 << 15, (1 << 31) - 1])
def test_zero_distances_need_no_luck(largest):
    rng = np.random.default_rng(largest)
    x = rng.integers(0, largest, (16, 40)).astype(np.uint64)
    y = rng.integers(0, largest, (32, 40)).astype(np.uint64)
    for column in range(0, 40, 3):
        y[column % 16 : column % 16 + 16, column] = x[:, column]
    wanted = np.array([[(y[i : i + 16, c] == x[:, c]).all() for c in range(40)] for i in range(16)])
    assert (periodic_runs.zero_distances(x, y) == wanted).all()


@pytest.mark.parametrize("text", [b"a " * 200_000, b"a b " * 100_000, b"a a a b " * 50_000])
def test_long_periodic_texts_stay_cheap(text):
    [result] = periodic_runs.examine([text]).to_pylist()
    assert len(result["runs"]) in (1, 2) and len(result["collapsed"]) < 20


def planted(doc_id, words):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = by_hand(words)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    best = None
    for s, length, q in runs:
        if best is None or (length * best[2], -s, -q) > (best[1] * q, -best[0], -best[2]):
            best = (s, length, q)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, collapsed(words, runs))]
    return (len(runs), *top, *digests)


def rows_of(df):
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted((str(r["doc_id"]), tuple(r[c] for c in columns)) for r in df.collect())


def test_digest_equals_brute_force(spark, odd_docs):
    repeated = [(i, f"x{i} " + "ab cd ef " * (i % 7) + f"y z　{i} k ", "en", "s", 0, "", "") for i in range(60)]
    docs = odd_docs.where("doc_id IS NULL OR doc_id <> 7").unionByName(spark.createDataFrame(repeated, odd_docs.schema))
    wanted = sorted((str(r["doc_id"]), expected(r["doc_id"], r["text"])) for r in docs.collect())
    assert rows_of(periodic_runs.digest(docs)) == wanted


def test_digest_on_the_given_tables(spark):
    short = documents(spark).where("length(text) < 4000")
    wanted = sorted((str(r["doc_id"]), expected(r["doc_id"], r["text"])) for r in short.collect())
    assert rows_of(periodic_runs.digest(short)) == wanted
    assert sum(row[1][0] for row in wanted) > 5
    assert QUERIES["op11_periodic_runs"](spark, SF_DIR).count() == table(spark, SF_DIR, "documents").count()


def test_long_empty_and_clashing(spark, odd_docs, no_docs):
    assert periodic_runs.digest(no_docs).count() == 0
    named = odd_docs.withColumn("repeats", odd_docs["lang"])
    found = periodic_runs.detect(named)
    assert found.columns[-1] == "_repeats" and found.count() == odd_docs.count()
    [long] = found.where("doc_id = 7").select("_repeats.*").collect()
    assert long["n_words"] == 60_000 and [tuple(r) for r in long["runs"]] == [(0, 60_000, 977)]
