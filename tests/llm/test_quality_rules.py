import random
import re
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorspark.llm import quality_rules as q
from sensorspark.llm.common import text_of
from tests_llm_data import documents, labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    words = WORD.findall(text)
    triples = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if triples[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(hit),
    )


def test_counts_equal_brute_force():
    draw = random.Random(1)
    texts = ["", " ", "a", "a b a b a b", "é#é é#é é#é é#é", "x\n\nx\n \nx", "\x1cq\x85 \xa0z", "a\rb\x0bc\x0cd"]
    texts += ["".join(draw.choice("ab é\n\t#*") for _ in range(draw.randint(0, 80))) for _ in range(500)]
    for t in texts:
        assert q.measure_text(t)[:5] == by_hand(t), repr(t)


def test_many_distinct_words_use_the_wide_codes():
    ids = np.array([1, 2, 3, 9, 1, 2, 3, 8])
    assert q.repeated_words(ids, 1 << 22) == q.repeated_words(ids, 10) == 6


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 3, 0.2), (50, 0, 0.05), (30, 29, 0.9)):
        exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert q.binomial_tail(k, n, p) == pytest.approx(exact)
    assert q.binomial_tail(5, 5, 0.1) == 1.0


def rows_with_symbols(spark, good, bad, lost, copies=1):
    """Documents of 101 words; bad ones, and ``lost`` good ones, are full of symbols."""
    clean = " ".join(f"w{i}" for i in range(100))
    noisy = " ".join(f"##$$%%{i}" for i in range(100))
    rows = [(i, f"{noisy if i < lost else clean} {i}", 1) for i in range(good)]
    rows += [(10**6 + i, f"{noisy} bad{i}", 0) for i in range(bad)]
    rows = [(doc_id + 10**7 * k, text, label) for doc_id, text, label in rows for k in range(copies)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    measured = table.select("doc_id", F.md5("text").alias("fp"), q.measures(text_of(table)).alias("m"))
    return measured, table.select("doc_id", "quality")


def test_cutoffs_need_proof(spark):
    # Enough clean holdout rows prove the cutoff; too few, or too many lost ones, do not.
    few = q.calibrate(*rows_with_symbols(spark, 300, 50, 0))
    lossy = q.calibrate(*rows_with_symbols(spark, 1000, 50, 30))
    sure = q.calibrate(*rows_with_symbols(spark, 1000, 50, 0))
    assert [c.rule for c in few] == [] and "symbol_share" not in {c.rule for c in lossy}
    assert "symbol_share" in {c.rule for c in sure}
    for c in sure:
        assert q.binomial_tail(c.rejected_good, c.good, 0.05 / len(q.LADDERS)) <= 0.05 / 15


def test_copies_are_one_trial(spark):
    # Ten copies of each of too few texts prove nothing; a proof counts distinct texts only.
    assert q.calibrate(*rows_with_symbols(spark, 300, 50, 0, copies=10)) == []
    sure = q.calibrate(*rows_with_symbols(spark, 1000, 50, 0, copies=3))
    assert sure and {c.good for c in sure} == {1000}


def test_rejection_stays_below_alpha():
    # Holdouts drawn from a population whose true rejection rates are known.
    draw, alpha, delta, draws = np.random.default_rng(5), 0.05, 0.05, 400
    cells = [(band, rule) for band in range(len(q.BANDS) + 1) for rule in q.LADDERS]
    truth = {}
    for band, rule in cells:
        # Steps reject ever more; the rates cross the rule's share of alpha part of the way.
        truth[band, rule] = np.linspace(0.001, 0.03, len(q.LADDERS[rule]))
    broken = used = 0
    for _ in range(draws):
        n, by = 2000, {}
        for band in range(len(q.BANDS) + 1):
            by[band, 1], by[band, 0] = {"n": n}, {"n": n}
            for rule in q.LADDERS:
                # One level per text, so that the steps of a ladder nest.
                level = draw.random(n)
                for step, rate in enumerate(truth[band, rule]):
                    by[band, 1][f"{rule}_{step}"] = int((level < rate).sum())
                    by[band, 0][f"{rule}_{step}"] = int(n * min(1.0, 0.3 + 0.6 * step / 13))
        cutoffs = q.chosen(by, alpha, delta)
        used += len(cutoffs)
        broken += any(
            truth[c.stratum, c.rule][q.LADDERS[c.rule].index(c.value)] > alpha / len(q.LADDERS) for c in cutoffs
        )
    assert used > 10 * draws and broken <= delta * draws


def test_report_on_odd_rows(spark, odd_docs, no_docs, no_labels):
    got = q.report(odd_docs, no_labels).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)
    assert q.report(no_docs, no_labels).count() == 0


def test_keep_good_keeps_columns_and_rows(spark, odd_docs, no_docs, no_labels):
    kept = q.keep_good(odd_docs, no_labels)
    assert kept.columns == odd_docs.columns
    # Only the long text has enough words without repeating itself too much.
    measured = q.report(odd_docs, no_labels).where("kept").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in measured)
    assert q.keep_good(no_docs, no_labels).count() == 0


def test_held_documents(spark):
    docs, known = documents(spark), labels(spark)
    got = q.report(docs, known).join(known, "doc_id")
    good = got.where("quality = 1 and not base_failed")
    assert good.where("kept").count() >= 0.95 * good.count()
    same = q.keep_good(docs, known).select("doc_id").exceptAll(q.report(docs, known).where("kept").select("doc_id"))
    assert same.count() == 0
