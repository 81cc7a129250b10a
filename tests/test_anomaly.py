"""Detectors on constant, missing and degenerate inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorspark.operators import anomaly, sequence

METRICS = anomaly.METRICS
SCHEMA = "t int, hour int, total_vehicles double, avg_AQI double, total_energy_kwh double"


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, i % 24, *map(lambda v: None if v is None else float(v), r)) for i, r in enumerate(rows)],
        SCHEMA,
    )


def test_zero_spread_gives_null_zscores_and_no_trailing_flags(spark):
    df = frame(spark, [(5, 1, 1)] * 30 + [(50, 1, 1)])
    z = anomaly.zscore_flags(df).orderBy("t").collect()
    assert z[-1]["traffic_anomaly"] is True and z[-1]["aqi_anomaly"] is None
    trailing = anomaly.trailing_flags(sequence.with_row_id(df, ["t"])).orderBy("t").collect()
    assert [r["traffic_anomaly_ma"] for r in trailing] == [False] * 31


def test_trailing_flag_is_null_only_for_a_missing_value(spark):
    rng = np.random.default_rng(0)
    rows = [(v, 1, 1) for v in rng.normal(size=30)] + [(None, 1, 1), (99, 1, 1)]
    got = anomaly.trailing_flags(sequence.with_row_id(frame(spark, rows), ["t"]))
    flags = [r["traffic_anomaly_ma"] for r in got.orderBy("t").collect()]
    assert flags[:24] == [False] * 24 and flags[30] is None and flags[31] is True


def test_severity_carries_null(spark):
    flags = {f"{m}_{s}": True for m in METRICS for s in anomaly.METHODS.values()}
    base = spark.range(2).withColumns({k: F.lit(v) for k, v in flags.items()})
    df = base.withColumn("aqi_anomaly", F.when(F.col("id") == 0, True))
    got = anomaly.severity(df).orderBy("id").collect()
    assert (got[0]["overall_severity"], got[0]["severity_level"]) == (4, "Critical")
    assert (got[1]["aqi_severity"], got[1]["overall_severity"], got[1]["severity_level"]) == (
        None, None, None,
    )


@pytest.mark.parametrize("n,scored", [(10, False), (11, True)])
def test_mahalanobis_needs_more_than_ten_rows(spark, n, scored):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3))
    got = anomaly.mahalanobis_flags(frame(spark, [*x, (None, 1, 1)])).orderBy("t").collect()
    distances = [r["mahalanobis_distance"] for r in got]
    assert distances[-1] is None and got[-1]["multivariate_anomaly"] is False
    if not scored:
        assert distances == [None] * (n + 1)
        return
    centred = x - x.mean(axis=0)
    want = np.einsum("ij,jk,ik->i", centred, np.linalg.inv(np.cov(x.T)), centred)
    assert distances[:-1] == pytest.approx(list(want))


def test_mahalanobis_with_collinear_metrics(spark):
    got = anomaly.mahalanobis_flags(frame(spark, [(i, 2 * i, i * i) for i in range(20)])).collect()
    assert all(r["mahalanobis_distance"] is None for r in got)
    assert not any(r["multivariate_anomaly"] for r in got)


def test_score_all_equals_the_single_detectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3)) ** 3
    rows = [[None if rng.random() < 0.1 else v for v in r] for r in x]
    df = sequence.with_row_id(frame(spark, rows), ["t"])
    whole = {r["t"]: r for r in anomaly.score_all(df).collect()}
    for part in (
        anomaly.zscore_flags(df), anomaly.iqr_flags(df), anomaly.trailing_flags(df),
        anomaly.hour_of_day_flags(df), anomaly.mahalanobis_flags(df),
    ):
        added = [c for c in part.columns if c not in df.columns]
        for r in part.collect():
            for c in added:
                mine, other = whole[r["t"]][c], r[c]
                assert mine == (pytest.approx(other) if isinstance(other, float) else other), c
    summary = {r["metric"]: r for r in anomaly.method_summary(anomaly.score_all(df)).collect()}
    flagged = sum(bool(r["traffic_anomaly"]) for r in whole.values())
    assert summary["Traffic"]["zscore_anomalies"] == flagged
