import numpy as np

from sensorspark.llm import rp_forest as f
from tests_llm_data import read

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank int"


def exact(rows, every):
    """Brute force in double precision, ties to the smaller id."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            best = {}
            for j, x in good:
                if j != i:
                    best[j] = float(q @ x) / float(np.sqrt(q @ q) * np.sqrt(x @ x))
            out[i] = sorted(best, key=lambda j: (-round(best[j], 12), j))[:5], best
    return out


def test_odd_vectors_and_copies_equal_brute_force(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.standard_normal(8).astype(np.float32)]) for i in range(200)]
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(400)]
    rows += [(50_000, None), (50_050, []), (50_100, [0.0] * 8), (50_150, [float("nan")] * 8), (50_200, [None] * 8), (None, same), (3, rows[3][1]), (50, rows[50][1])]
    rows += [(50_250, [1.0, float("inf")] + [0.0] * 6)]
    table = spark.createDataFrame([(i, v, None, 1) for i, v in rows], SCHEMA).repartition(7)
    got = {}
    for r in f.neighbours(table).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact(rows, 50)
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert [v for _, v, _ in found] == want[q][0]
        assert np.allclose([s for _, _, s in found], [want[q][1][v] for _, v, _ in found], atol=1e-12)


def test_blocks_change_nothing(spark, monkeypatch):
    table = read(spark, "embeddings")
    plain = sorted(map(tuple, f.neighbours(table).collect()))
    monkeypatch.setattr(f, "BLOCK_ROWS", 7)
    monkeypatch.setattr(f, "BLOCK_QUERIES", 3)
    cut = sorted(map(tuple, f.neighbours(table).collect()))
    assert [x[:3] for x in plain] == [x[:3] for x in cut]


def test_recall_with_many_leaves(spark):
    draw = np.random.default_rng(2)
    x = draw.standard_normal((6000, 32)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in f.neighbours(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = f.unit(x.astype(float))
    hits = 0
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & got[q])
    assert hits >= 0.9 * 5 * 120


def test_empty_and_tiny_tables(spark):
    assert f.neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], 1, 1)], SCHEMA)
    assert f.neighbours(one).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0], 1, 1), (1, [2.0, 4.0], 1, 1)], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id) for r in f.neighbours(two).collect()] == [(0, 1, 1)]
