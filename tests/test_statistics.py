"""Quantiles against numpy, summaries, correlations, and guards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorspark.operators import profile, stats


def quantile_map(df, by):
    return {
        (tuple(r[c] for c in by), round(r["prob"], 6)): r["quantile"] for r in df.collect()
    }


@pytest.mark.parametrize("limit,cuts,accuracy", [(50_000, 1024, 10_000), (20, 16, 40)])
def test_grouped_quantiles_equal_numpy(spark, monkeypatch, limit, cuts, accuracy):
    """With a limit of 20 rows most groups take several rounds, and the coarse sketch also misses."""
    monkeypatch.setattr(stats, "BRACKET_ROWS", limit)
    monkeypatch.setattr(stats, "CUTS", cuts)
    monkeypatch.setattr(stats, "CUT_ACCURACY", accuracy)
    rng = np.random.default_rng(1)
    groups = {
        "plain": rng.normal(size=4000),
        "ties": np.where(rng.random(4000) < 0.34, 7.0, rng.normal(size=4000)),
        "outlier": np.append(rng.random(999), 1e12),
        "constant": np.full(700, 3.5),
        "single": np.array([2.0]),
        "pair": np.array([1.0, 2.0]),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("plain", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = quantile_map(stats.grouped_quantiles(df, ["g"], "v", probs), ["g"])
    for g, vs in groups.items():
        for p in probs:
            assert got[(g,), p] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12), (g, p)


def test_no_sort_grows_with_the_group(spark):
    """Ten million distinct values in one group, beside a value that fills a third of another."""
    n = 10**7
    v = (F.col("id") * 7919 % n).cast("double")
    df = spark.range(n).select(
        (F.col("id") % 4 == 0).alias("g"), F.when((F.col("id") % 4 == 0) & (F.col("id") % 3 == 0), 5.5).otherwise(v).alias("_v")
    )
    found = stats._Brackets(df, ["g"], [0.25, 0.5], stats.linear_position, True)
    rounds = 0
    while found.open:
        found.narrow()
        rounds += 1
    assert rounds <= 2 and found.table.agg(F.max("_left")).first()[0] <= stats.BRACKET_ROWS
    got = quantile_map(stats.grouped_quantiles(df, ["g"], "_v", [0.25, 0.5], few_groups=True), ["g"])
    ids = np.arange(n)
    values = (ids * 7919 % n).astype(float)
    values[(ids % 12) == 0] = 5.5
    for g in (True, False):
        part = values[(ids % 4 == 0) == g]
        assert [got[(g,), p] for p in (0.25, 0.5)] == list(np.quantile(part, [0.25, 0.5]))


def test_ungrouped_and_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    whole = quantile_map(stats.grouped_quantiles(df, [], "v", [0.5]), [])
    assert whole[(), 0.5] == 3.0
    per = quantile_map(stats.grouped_quantiles(df, ["g"], "v", [0.5]), ["g"])
    assert per[(None,), 0.5] == 2.0 and per[("a",), 0.5] == 5.0


def test_six_numbers_and_na_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,)], "x double")
    (row,) = stats.six_number_summary(df, ["x"]).collect()
    assert (row["min"], row["q1"], row["median"], row["q3"], row["max"]) == (
        1.0, 1.75, 3.0, 5.5, 10.0,
    )
    assert row["na_count"] == 1 and row["mean"] == 4.25


def test_iqr_counts(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 12), 100]], "x double")
    assert stats.iqr_outlier_counts(df, ["x"]).first()[0] == 1


def test_correlation_is_listwise(spark):
    rows = [(1.0, 2.0, 1.0), (2.0, 4.0, None), (3.0, 1.0, 2.0), (4.0, 3.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["var1"], r["var2"]): r["value"]
           for r in stats.correlation_matrix(df, ["a", "b", "c"]).collect()}
    full = np.array([r for r in rows if None not in r])
    assert got["a", "b"] == pytest.approx(np.corrcoef(full[:, 0], full[:, 1])[0, 1])
    assert got["a", "b"] == got["b", "a"] and got["c", "c"] == 1.0
    top = stats.top_correlations(stats.correlation_matrix(df, ["a", "b", "c"])).collect()
    assert len(top) == 3 and all(r["var1"] < r["var2"] for r in top)


def test_standardize_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double")
    out = stats.standardize(df, ["x", "y"]).orderBy("x").collect()
    assert out[0]["x_z"] == pytest.approx(-np.sqrt(0.5)) and out[0]["y_z"] is None


def test_missing_profile(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, 4)], "a int, b int")
    got = [tuple(r) for r in profile.missing_profile(df).collect()]
    assert got == [("b", 2, 66.67), ("a", 1, 33.33)]


def test_peaks_keep_ties(spark):
    df = spark.createDataFrame([(0, 5.0), (1, 7.0), (2, 7.0), (3, None)], "hour int, v double")
    got = profile.peak_groups(df, "hour", {"v": "v"}).collect()
    assert sorted(r["hour"] for r in got) == [1, 2]


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    df = spark.createDataFrame([(float(v), "k") for v in range(0, 101)], "v double, c string")
    got = {r["bin"]: r["count"] for r in profile.histogram(df, "v", "c").collect()}
    assert min(got) == 0 and max(got) == 49 and sum(got.values()) == 101 and got[49] == 3
    flat = spark.createDataFrame([(2.0, "k")] * 4, "v double, c string")
    assert [tuple(r) for r in profile.histogram(flat, "v", "c").collect()] == [(0, "k", 4)]


def test_sample_is_exact_and_repeatable(spark, partitions):
    df = spark.range(1000)
    first = {r["id"] for r in profile.sample_rows(df, "id", 100).collect()}
    partitions(32)
    second = {r["id"] for r in profile.sample_rows(df.repartition(7), "id", 100).collect()}
    assert len(first) == 100 and first == second
    assert profile.sample_rows(df, "id", 5000).count() == 1000


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, o int, v string")
    got = {r["k"]: r["v"] for r in profile.keep_first(df, ["k"], [F.col("o")]).collect()}
    assert got == {"a": "y", "b": "z"}
