import random
from collections import defaultdict

import pytest

from sensorspark.llm import mixing as m
from sensorspark.llm.mixing import Mix
from tests_llm_data import documents


def water(given, children):
    """children: {name: (capacity, weight)} -> {name: amount}, by filling one child after another."""
    out, left, open_ = {}, given, {k: v for k, v in children.items() if v[0] > 0 and v[1] > 0}
    while open_:
        level = left / sum(w for _, w in open_.values())
        full = {k for k, (c, w) in open_.items() if c <= level * w + 1e-12}
        if not full:
            out.update({k: level * w for k, (_, w) in open_.items()})
            return out
        for k in full:
            out[k] = open_[k][0]
            left -= open_.pop(k)[0]
    return out


def by_hand(supply, mix):
    """Budgets of the leaves (a, b, c), top down."""
    weight = lambda level, value: mix.weights.get(level, {}).get(value, 1.0)
    alive = {k: s * mix.max_epochs for k, s in supply.items() if s and all(weight(x, v) for x, v in zip(mix.levels, k))}

    def capacity(prefix):
        return sum(c for k, c in alive.items() if k[: len(prefix)] == prefix)

    def split(prefix, given):
        if len(prefix) == len(mix.levels):
            return {prefix: given}
        names = {k[len(prefix)] for k in alive if k[: len(prefix)] == prefix}
        level = mix.levels[len(prefix)]
        shares = water(given, {n: (capacity((*prefix, n)), weight(level, n)) for n in names})
        out = {}
        for n, amount in shares.items():
            out.update(split((*prefix, n), amount))
        return out

    return split((), min(mix.share * sum(supply.values()), capacity(())))


def test_budgets_equal_top_down_filling(spark):
    draw = random.Random(1)
    for turn in range(6):
        supply = {(f"d{a}", f"l{b}", f"s{c}"): draw.choice([0, 3, 50, 1000]) for a in range(3) for b in range(3) for c in range(3)}
        mix = Mix(
            weights={"domain": {"d0": draw.choice([0.0, 1.0, 5.0])}, "lang": {"l1": 3.0}, "source": {"s2": 0.5}},
            share=draw.choice([0.3, 1.0, 9.0]),
            max_epochs=draw.choice([1, 3]),
        )
        leaves = spark.createDataFrame([(*k, v) for k, v in supply.items()], "domain string, lang string, source string, supply bigint")
        want = by_hand(supply, mix)
        for r in m.budgets(leaves, mix).collect():
            assert r.budget == pytest.approx(want.get((r.domain, r.lang, r.source), 0.0), abs=1e-6), turn


def test_shortage_stays_among_siblings(spark):
    # s0 cannot give its share; its sibling s1 takes it, the other domain's budget is as before.
    supply = [("a", "x", "s0", 1), ("a", "x", "s1", 100), ("b", "x", "s2", 101)]
    leaves = spark.createDataFrame(supply, "domain string, lang string, source string, supply bigint")
    got = {r.source: r.budget for r in m.budgets(leaves, Mix(share=0.5, max_epochs=1)).collect()}
    assert got == pytest.approx({"s0": 1.0, "s1": 49.5, "s2": 50.5})


@pytest.mark.parametrize("bucket", [3, 1000])
def test_prefixes_of_seeded_epochs(spark, monkeypatch, bucket):
    monkeypatch.setattr(m, "BUCKET_ROWS", bucket)
    draw = random.Random(2)
    rows = [(i, " ".join(["w"] * draw.randint(1, 30)), "en", "src0" if i % 3 else f"src{i % 20}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    mix = Mix(share=1.0, max_epochs=3)
    got = m.mixed(docs, mix).select("doc_id", "mix.*").collect()
    size = {r[0]: len(r[1].split()) for r in rows}
    supply, members = defaultdict(int), defaultdict(list)
    for i, text, lang, source in rows:
        leaf = (f"group{int(source[3:]) // 5}", lang, source)
        supply[leaf] += size[i]
        members[leaf].append((i, text))
    want = by_hand(supply, mix)
    taken = defaultdict(lambda: defaultdict(set))
    for r in got:
        assert r.doc_id not in taken[r.domain, r.lang, r.source][r.epoch] and r.n_tokens == size[r.doc_id]
        taken[r.domain, r.lang, r.source][r.epoch].add(r.doc_id)
    order = spark.createDataFrame([(i, t, e) for x in members.values() for i, t in x for e in range(3)], "doc_id bigint, text string, e int")
    from pyspark.sql import functions as F

    h = {(r.doc_id, r.e): r.h for r in order.select("doc_id", "e", F.xxhash64(F.xxhash64("doc_id", "text"), "e", F.lit(mix.seed)).alias("h")).collect()}
    for leaf, own in members.items():
        whole = int(want[leaf] / supply[leaf] + 1e-9)
        for e in range(whole):
            assert taken[leaf][e] == {i for i, _ in own}
        prefix, held = set(), 0
        for i in sorted((i for i, _ in own), key=lambda i: h[i, whole] if whole < 3 else 0):
            if held >= want[leaf] - whole * supply[leaf] - 1e-6:
                break
            prefix.add(i)
            held += size[i]
        assert taken[leaf][whole] == prefix


def test_odd_rows(spark, odd_docs, no_docs):
    got = m.mixed(odd_docs, Mix())
    assert got.columns == [*odd_docs.columns, "_mix"]
    assert got.where("text is null").count() == 0
    assert m.mixed(no_docs, Mix()).count() == 0
    nothing = m.mixed(odd_docs, Mix(weights={"lang": {k: 0.0 for k in ("en", "de", "fr", "es", "")}}))
    assert nothing.count() == 0


def test_given_documents(spark):
    got = m.mixed(documents(spark), Mix()).select("mix.*").collect()
    by = defaultdict(int)
    for r in got:
        by[r.domain] += r.n_tokens
    assert max(by.values()) < 1.2 * min(by.values())
