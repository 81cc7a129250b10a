import numpy as np
import pytest

from sensorspark.llm import rule_ensemble as r
from tests_llm_data import documents, labels


def test_columns_equal_the_model(spark):
    draw = np.random.default_rng(1)
    x = draw.random((400, len(r.NAMES)))
    y = ((x[:, 0] > 0.5) & (x[:, 5] <= 0.7)).astype(float)
    model = r.fit(x, y)
    logits = model.intercept + r._fires(list(model.rules), x) @ np.array(model.weights)
    table = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], ["i", *r.NAMES])
    got = [row.s for row in table.select("i", model.column().alias("s")).orderBy("i").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-logits)), atol=1e-5)
    assert ((np.array(got) >= 0.5) == (y == 1)).mean() > 0.97
    # The lasso leaves few of the rules, and each is a path of at most DEPTH tests.
    assert 0 < len(model.rules) < len(r._rules(x, y)) and max(map(len, model.rules)) <= r.DEPTH


def test_lasso_reaches_the_optimality_conditions():
    draw = np.random.default_rng(2)
    a = (draw.random((300, 12)) > 0.5).astype(np.float32)
    y = (a[:, 0] + draw.random(300) > 1).astype(np.float32)
    weight = np.full(300, 1 / 300, np.float32)
    w, b = r._lasso(a, y, weight)
    slope = a.T @ (weight * (1 / (1 + np.exp(-(a @ w + b))) - y))
    assert np.all(np.abs(slope[w == 0]) <= r.PENALTY + 2e-4)
    assert np.allclose(slope[w != 0], -np.sign(w[w != 0]) * r.PENALTY, atol=3e-4)


def test_statistics(spark):
    texts = ["", "Ab cd.\nAb cd.\nX1 #!", " ", "é É"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = table.select("i", *[c.alias(n) for n, c in r.statistics(table.t).items()]).orderBy("i").collect()
    assert all(v == 0 for k, v in got[0].asDict().items() if k != "i")
    assert got[1].n_words == 6 and got[1].distinct_words == pytest.approx(4 / 6)
    assert got[1].distinct_lines == pytest.approx(2 / 3) and got[1].capitals == pytest.approx(3 / 19)
    assert got[2].n_words == 0 and got[3].capitals == pytest.approx(1 / 3)


def test_odd_rows(spark, odd_docs, no_docs, no_labels):
    got = r.scored(odd_docs, no_labels).collect()
    assert len(got) == odd_docs.count() and {x.score for x in got} == {0.5}
    assert r.scored(no_docs, no_labels).count() == 0
    one = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0), (2, 1, 1), (8, 1, 0)], "doc_id bigint, quality int, toxic int")
    scores = {x.score for x in r.scored(odd_docs, one).collect()}
    assert len(scores) == 1 and 0.5 < scores.pop() < 1


def test_held_out_accuracy(spark):
    got = r.scored(documents(spark), labels(spark)).join(labels(spark), "doc_id").where("held_out").collect()
    right = sum(x.predicted == x.quality for x in got)
    assert len(got) > 5 and right >= 0.9 * len(got)
