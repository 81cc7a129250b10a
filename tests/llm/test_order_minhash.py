import random
from collections import Counter

import numpy as np
import pytest

from sensorspark.llm import order_minhash as o
from sensorspark.llm.components import components


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_equals_the_full_table():
    draw = random.Random(1)
    for _ in range(6000):
        letters = draw.choice([2, 3, 6])
        a = [draw.randrange(letters) for _ in range(draw.randint(0, 14))]
        b = list(a)
        for _ in range(draw.randint(0, 6)):
            kind = draw.random()
            if kind < 0.4 and b:
                b.pop(draw.randrange(len(b)))
            elif kind < 0.8:
                b.insert(draw.randint(0, len(b)), draw.randrange(letters))
            elif b:
                b[draw.randrange(len(b))] = draw.randrange(letters)
        most, true = draw.randint(0, 12), distance(a, b)
        assert o.distance_within(a, b, most) == (true if true <= most else None)


def words(draw, n):
    return [f"w{draw.randrange(4000)}" for _ in range(n)]


def changed(draw, base, n):
    out = list(base)
    for i in draw.sample(range(len(out)), n):
        out[i] = f"x{draw.randrange(10**6)}"
    return out


def test_repeated_shingles_are_numbered():
    codes = o.numbered_shingles([b"a"] * 9)
    assert len(set(codes.tolist())) == 5
    swapped = o.band_keys([b"%d" % i for i in range(40)] + [b"%d" % i for i in range(100, 140)])
    plain = o.band_keys([b"%d" % i for i in range(100, 140)] + [b"%d" % i for i in range(40)])
    # The same shingles but for the seam; sketches remember the order.
    assert len(set(swapped) & set(plain)) < 15


@pytest.mark.parametrize("share, least", [(0.8, 0.9), (0.85, 0.95), (0.9, 0.99)])
def test_alike_texts_share_a_band(share, least):
    # Words are replaced one by one until the shingle sequences have no more than the share in common.
    draw, met, pairs = random.Random(11), 0, 150
    for _ in range(pairs):
        base = [w.encode() for w in words(draw, 300)]
        other, order = list(base), draw.sample(range(300), 300)
        for i in order:
            before = other[i]
            other[i] = b"y%d" % draw.randrange(10**6)
            if (o.shingles(other) == o.shingles(base)).mean() < share:
                other[i] = before
                break
        assert o.distance_within(list(o.shingles(base)), list(o.shingles(other)), o.may_differ(296)) is not None
        met += bool(set(o.band_keys(base)) & set(o.band_keys(other)))
    assert met >= least * pairs


def alignments(docs, monkeypatch):
    """The number of pairs that are aligned, and the classes."""
    listed, plain = [], o._verified

    def counted(pairs, texts):
        listed.append(pairs.count())
        return plain(pairs, texts)

    monkeypatch.setattr(o, "_verified", counted)
    classes = {r.doc_id: r.class_id for r in o.class_ids(docs).collect()}
    monkeypatch.setattr(o, "_verified", plain)
    return sum(listed), classes


def test_texts_with_a_common_passage_cost_few_alignments(spark, partitions, monkeypatch):
    draw = random.Random(12)
    partitions(8)
    passage, per_text = words(draw, 60), []
    for n in (300, 1200):
        texts = []
        for _ in range(n):
            at = draw.randrange(41)
            own = words(draw, 40)
            texts.append(own[:at] + passage + own[at:])
        # Two near copies among them have to be found in the crowd.
        texts.append(changed(draw, texts[n // 2], 2))
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
        cost, classes = alignments(docs, monkeypatch)
        assert classes == {i: n // 2 if i == n else i for i in range(n + 1)}
        per_text.append(cost / n)
    assert per_text[1] < 1.5 * per_text[0] + 10 and per_text[1] < 40


def test_rare_shingles_lose_no_link(spark, partitions):
    draw = random.Random(13)
    partitions(4)
    base = words(draw, 120)
    texts = [changed(draw, base, draw.randint(1, 9)) for _ in range(40)]
    texts += [base[:70] + words(draw, draw.randint(20, 60)) for _ in range(30)]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "v bigint, text string")
    keys = {}
    for r in o.rare_buckets(table).collect():
        keys.setdefault(r.v, set()).add(r.key)
    grams = [o.shingles([w.encode() for w in t]).tolist() for t in texts]
    links = [
        (i, j) for i in range(70) for j in range(i)
        if o.distance_within(grams[i], grams[j], o.may_differ(max(len(grams[i]), len(grams[j])))) is not None
    ]
    assert len(links) > 50
    for i, j in links:
        assert keys[i] & keys[j]


def passage_texts(draw):
    """Texts of a long common passage, some of little else, and some that share rarer parts too."""
    passage, other = words(draw, 300), words(draw, 30)
    texts = [passage[: draw.randint(250, 300)] + words(draw, draw.randint(3, 90)) for _ in range(60)]
    texts += [other[: draw.randint(10, 30)] + passage + words(draw, draw.randint(3, 60)) for _ in range(30)]
    texts += [passage[:40] * 2 + words(draw, draw.randint(0, 20)) for _ in range(20)]
    return texts + [changed(draw, texts[3], 2), words(draw, 50), words(draw, 3)]


@pytest.mark.parametrize("share", [0, 0.5, 1])
def test_rare_buckets_are_the_first_shingles_of_one_order(spark, partitions, monkeypatch, share):
    # Whichever shingles are taken for frequent ones, the rows are the first by one order of all.
    draw = random.Random(14)
    partitions(4)
    texts = passage_texts(draw)
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "v bigint, text string")
    codes = [o.numbered_shingles([w.encode() for w in t]).view("int64").tolist() for t in texts]
    held = Counter(c for of_text in codes for c in of_text)
    frequent = [c for c in held if held[c] > 1 and draw.random() < share]
    monkeypatch.setattr(o, "frequent_shingles", lambda whole: np.array(frequent, np.int64))
    last = {c: i for i, c in enumerate(frequent)}
    expected = set()
    for v, of_text in enumerate(codes):
        order = sorted(of_text, key=lambda c: (last.get(c, -1), held[c], c))
        expected |= {(c, v, len(of_text)) for c in order[: o.may_differ(len(of_text)) + 1] if held[c] > 1}
    got = [tuple(r) for r in o.rare_buckets(table).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_frequent_shingles_are_the_most_frequent_ones(spark, monkeypatch):
    rows = [(v, [1, 2] + [3] * (v < 40) + [4] * (v % 20 == 0) + [100 + v]) for v in range(80)]
    whole = spark.createDataFrame(rows, "v bigint, codes array<bigint>").repartition(2)
    found = o.frequent_shingles(whole).tolist()
    assert found == [3, 1, 2]
    monkeypatch.setattr(o, "FREQUENT", 2)
    assert o.frequent_shingles(whole).tolist() == [1, 2]
    assert o.frequent_shingles(whole.limit(0)).tolist() == []


def test_a_common_passage_is_not_joined_text_by_text(spark, partitions, monkeypatch):
    draw = random.Random(15)
    partitions(4)
    passage, joined = words(draw, 300), []
    table = spark.createDataFrame(
        [(i, " ".join(passage + words(draw, 120))) for i in range(60)], "v bigint, text string"
    )
    plain = type(table).join

    def counted(left, right, on=None, how=None):
        out = plain(left, right, on, how)
        if on == "key":
            joined.append(out.count())
        return out

    monkeypatch.setattr(type(table), "join", counted)
    o.rare_buckets(table)
    # The passage alone has 296 shingles in each of 60 texts.
    assert joined and sum(joined) < 60 * 10


def test_long_texts_are_searched_in_blocks(monkeypatch):
    draw = random.Random(2)
    text = [w.encode() for w in words(draw, 3000)]
    whole = o.band_keys(text)
    monkeypatch.setattr(o, "BLOCK", 64)
    assert o.band_keys(text) == whole
    for n in range(1, 9):
        assert len(o.band_keys(text[:n])) == o.BANDS


@pytest.mark.parametrize("parts", [3, 32])
def test_classes_equal_brute_force(spark, partitions, parts):
    draw = random.Random(3)
    partitions(parts)
    passage = words(draw, 60)
    texts = []
    for _ in range(25):
        base = words(draw, draw.randint(60, 400))
        texts += [base, changed(draw, base, max(1, len(base) // 40)), list(base)]
    # A group of near copies of one text, and texts that only share a passage.
    hub = words(draw, 300)
    texts += [changed(draw, hub, 6) for _ in range(60)]
    texts += [words(draw, 300) + passage + words(draw, 300) for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    got = {r.doc_id: r.class_id for r in o.class_ids(docs).collect()}
    label = list(range(len(rows)))
    grams = [[tuple(t[k : k + 5]) for k in range(len(t) - 4)] for t in texts]
    for i in range(len(rows)):
        for j in range(i):
            longer = max(len(grams[i]), len(grams[j]))
            if abs(len(grams[i]) - len(grams[j])) <= 0.2 * longer:
                near = o.distance_within(grams[i], grams[j], int(0.2 * longer + 1e-9)) is not None
                if near and label[i] != label[j]:
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
    assert got == dict(enumerate(label))
    kept = {r.doc_id for r in o.keep_one(docs).collect()}
    assert kept == set(label)


def test_a_chain_is_one_class(spark):
    # Neighbours in the chain are alike, its ends are not: pivots must not lose the links between.
    draw = random.Random(4)
    text, chain = words(draw, 200), []
    for k in range(12):
        chain.append(list(text))
        text[k * 16 : k * 16 + 16] = words(draw, 16)
    draw.shuffle(chain)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(chain)], "doc_id bigint, text string")
    assert {r.class_id for r in o.class_ids(docs).collect()} == {0}


def test_odd_rows(spark, odd_docs, no_docs):
    got = o.class_ids(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert by[1] == by[2] == 1 and by[4] == by[5] == 4 and by[6] == 6 and by[7] == 7 and by[8] == 8
    kept = o.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7, 8, 9]
    assert o.class_ids(no_docs).count() == 0 and o.keep_one(no_docs).count() == 0
    nameless = odd_docs.where("doc_id is null")
    assert o.class_ids(nameless).count() == 2 and o.keep_one(nameless).count() == 2


def test_components(spark):
    draw = random.Random(9)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    label = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert {r.v: r.component for r in got.collect()} == label
