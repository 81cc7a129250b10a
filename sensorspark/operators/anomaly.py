"""Anomaly detectors on the hourly table: z-score, quartile fences, trailing window, hour of day,
severity score, and the Mahalanobis distance over three metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorspark.functions import calendar
from sensorspark.functions.scores import row_max, severity_label
from sensorspark.operators.sequence import HaloFrames
from sensorspark.operators.stats import covariance_row, mean_sd_row, quantile_row
from sensorspark.session import with_scalars

METRICS = {"traffic": "total_vehicles", "aqi": "avg_AQI", "energy": "total_energy_kwh"}
METHODS = {"zscore": "anomaly", "iqr": "anomaly_iqr", "ma": "anomaly_ma", "time": "time_anomaly"}

# Fixed value: 99.9 % quantile of the chi-square distribution with 3 degrees of freedom.
CHI2_999_DF3 = 16.266236196238129


def flag_name(metric: str, method: str) -> str:
    return f"{metric}_{METHODS[method]}"


def zscore_flags(
    df: DataFrame,
    metrics: dict[str, str] = METRICS,
    threshold: float = 3.0,
    source: DataFrame | None = None,
) -> DataFrame:
    """``abs((x − mean) / sd) > threshold`` per metric; NULL where x is NULL or sd is zero.

    ``source`` is the table to take the statistics from when ``df`` is a longer plan over it.
    """
    cols = list(metrics.values())
    scored = with_scalars(df, mean_sd_row(df if source is None else source, cols))
    flags = {
        flag_name(m, "zscore"): F.expr(
            f"abs(try_divide(`{c}` - `{c}_mean`, `{c}_sd`)) > {float(threshold)}D"
        )
        for m, c in metrics.items()
    }
    return scored.withColumns(flags).drop(*[f"{c}_{s}" for c in cols for s in ("mean", "sd")])


def iqr_flags(
    df: DataFrame,
    metrics: dict[str, str] = METRICS,
    multiplier: float = 1.5,
    source: DataFrame | None = None,
) -> DataFrame:
    """Outside ``[q1 − k·iqr, q3 + k·iqr]`` per metric; NULL where x is NULL."""
    cols = list(metrics.values())
    quartiles = quantile_row(df if source is None else source, cols, {"q1": 0.25, "q3": 0.75})
    fenced = with_scalars(df, quartiles)

    def outside(c: str) -> Column:
        spread = f"{float(multiplier)}D * (`{c}_q3` - `{c}_q1`)"
        return F.expr(f"`{c}` < `{c}_q1` - {spread} or `{c}` > `{c}_q3` + {spread}")

    flags = {flag_name(m, "iqr"): outside(c) for m, c in metrics.items()}
    return fenced.withColumns(flags).drop(*[f"{c}_{s}" for c in cols for s in ("q1", "q3")])


def trailing_flags(
    numbered: DataFrame,
    metrics: dict[str, str] = METRICS,
    window: int = 24,
    threshold: float = 2.0,
    block_rows: int | None = None,
) -> DataFrame:
    """``abs(x − mean) > threshold · sd`` against the ``window`` rows before the current one.

    FALSE for the first ``window`` rows and wherever the earlier rows have no positive sd; NULL
    where only x is missing.  Needs the ``row_id`` of ``sequence.with_row_id``.
    """
    extra = {} if block_rows is None else {"block_rows": block_rows}
    frames = HaloFrames(numbered, window, **extra)
    past = frames.window(-window, -1)

    def flag(c: str) -> Column:
        sd = F.stddev_samp(c).over(past)
        return (
            F.when(F.col("row_id") <= window, F.lit(False))
            .when(sd.isNull() | (sd <= 0), F.lit(False))
            .otherwise(F.abs(F.col(c) - F.avg(c).over(past)) > threshold * sd)
        )

    added = {flag_name(m, "ma"): flag(c) for m, c in metrics.items()}
    return frames.own(frames.rows.withColumns(added))


def hour_profile_sd(df: DataFrame, metrics: dict[str, str] = METRICS) -> DataFrame:
    """Mean and sample sd of each metric per hour of day: 24 rows at most."""
    return df.groupBy("hour").agg(
        *[F.avg(c).alias(f"{m}_mean") for m, c in metrics.items()],
        *[F.stddev_samp(c).alias(f"{m}_sd") for m, c in metrics.items()],
    )


def hour_of_day_flags(
    df: DataFrame,
    metrics: dict[str, str] = METRICS,
    threshold: float = 2.0,
    profile: DataFrame | None = None,
) -> DataFrame:
    """``abs(x − mean_h) > threshold · sd_h`` with the statistics of the row's hour of day.

    The profile is aggregated and broadcast (24 rows); a window per hour would leave the whole
    table to 24 tasks.  ``df`` may be a stream when ``profile`` comes from a static table.
    """
    stats = hour_profile_sd(df, metrics) if profile is None else profile
    joined = df.join(F.broadcast(stats), "hour", "left")
    flags = {
        flag_name(m, "time"): F.expr(
            f"abs(`{c}` - `{m}_mean`) > {float(threshold)}D * `{m}_sd`"
        )
        for m, c in metrics.items()
    }
    return joined.withColumns(flags).drop(*[f"{m}_{s}" for m in metrics for s in ("mean", "sd")])


def severity(df: DataFrame, metrics: dict[str, str] = METRICS) -> DataFrame:
    """Agreeing detectors per metric, their maximum over metrics, and its label (NULLs carry)."""

    def agreeing(m: str) -> Column:
        return F.expr(" + ".join(f"cast(`{flag_name(m, method)}` as int)" for method in METHODS))

    scored = df.withColumns({f"{m}_severity": agreeing(m) for m in metrics})
    scored = scored.withColumn(
        "overall_severity", row_max(*[F.col(f"{m}_severity") for m in metrics])
    )
    return scored.withColumn("severity_level", severity_label(F.col("overall_severity")))


def mahalanobis_flags(
    df: DataFrame,
    metrics: dict[str, str] = METRICS,
    source: DataFrame | None = None,
    threshold: float = CHI2_999_DF3,
    min_rows: int = 10,
    min_det: float = 1e-10,
) -> DataFrame:
    """Squared Mahalanobis distance over three metrics and its flag.

    Centre and covariance come from one aggregate over the complete rows; the 3×3 inverse is
    written out as column expressions.  With ``min_rows`` rows or fewer, or a singular covariance,
    every flag is FALSE and every distance NULL; incomplete rows get the same.  ``source`` is the
    table to take the statistics from when ``df`` is a longer plan over the same rows.
    """
    cols = list(metrics.values())
    if len(cols) != 3:
        raise ValueError("the closed-form inverse is written for three metrics")
    stats = covariance_row(df if source is None else source, cols)

    def s(i: int, j: int) -> str:
        return f"cov_{min(i, j)}_{max(i, j)}"

    def cofactor(i: int, j: int) -> str:
        (a, b), (c, d) = [[x for x in range(3) if x != k] for k in (i, j)]
        minor = f"({s(a, c)} * {s(b, d)} - {s(a, d)} * {s(b, c)})"
        return minor if (i + j) % 2 == 0 else f"(-{minor})"

    det = " + ".join(f"{s(0, j)} * {cofactor(0, j)}" for j in range(3))
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    usable = f"n > {int(min_rows)} and {det} > {float(min_det)}D"
    inverse = stats.selectExpr(
        *[f"mean_{i} as _m{i}" for i in range(3)],
        *[f"case when {usable} then {cofactor(i, j)} / ({det}) end as _inv{i}{j}" for i, j in pairs],
    )
    placed = with_scalars(df, inverse)
    delta = [f"(`{c}` - _m{i})" for i, c in enumerate(cols)]
    distance = F.expr(
        " + ".join(
            f"{1 if i == j else 2}D * {delta[i]} * {delta[j]} * _inv{i}{j}" for i, j in pairs
        )
    )
    return (
        placed.withColumn("mahalanobis_distance", distance)
        .withColumn(
            "multivariate_anomaly",
            F.coalesce(F.col("mahalanobis_distance") > threshold, F.lit(False)),
        )
        .drop(*[f"_m{i}" for i in range(3)], *[f"_inv{i}{j}" for i, j in pairs])
    )


def score_all(numbered: DataFrame, metrics: dict[str, str] = METRICS) -> DataFrame:
    """Every detector, severity and the multivariate distance on one numbered hourly table.

    The trailing windows come first: their statistics need the frame order, everything after them
    is a projection over scalars and one broadcast profile, so the table is shuffled once.
    Statistics are always taken from ``numbered`` itself, never from another detector's output.
    """
    trailed = trailing_flags(numbered, metrics)
    flagged = iqr_flags(zscore_flags(trailed, metrics, source=numbered), metrics, source=numbered)
    timed = hour_of_day_flags(flagged, metrics, profile=hour_profile_sd(numbered, metrics))
    return severity(mahalanobis_flags(timed, metrics, source=numbered), metrics)


def anomaly_records(scored: DataFrame) -> DataFrame:
    """Rows with any severity, in the 17 columns of the record mart."""
    return (
        scored.where(F.col("overall_severity") > 0)
        .withColumn("day_of_week", calendar.weekday_name(F.col("date")))
        .select(
            "timestamp",
            "date",
            "hour",
            "day_of_week",
            *METRICS.values(),
            *[flag_name(m, "zscore") for m in METRICS],
            "multivariate_anomaly",
            *[f"{m}_severity" for m in METRICS],
            "overall_severity",
            "severity_level",
            "mahalanobis_distance",
        )
    )


def severity_distribution(scored: DataFrame) -> DataFrame:
    """Rows per label; rows without a label are not counted."""
    return (
        scored.where(F.col("severity_level").isNotNull())
        .groupBy(F.col("severity_level").alias("level"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def severity_summary(scored: DataFrame) -> DataFrame:
    """Rows and metric means per label; the unlabelled rows form a group of their own."""
    return scored.groupBy("severity_level").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("total_vehicles").alias("avg_traffic"),
        F.avg("avg_AQI").alias("avg_aqi"),
        F.avg("total_energy_kwh").alias("avg_energy"),
    )


def severity_heatmap(scored: DataFrame) -> DataFrame:
    """Mean severity and number of anomalous rows per (day of week, hour); Monday sorts first."""
    return scored.groupBy(
        calendar.monday_first(F.col("date")).alias("day_index"),
        calendar.weekday_name(F.col("date")).alias("day_of_week"),
        "hour",
    ).agg(
        F.avg("overall_severity").alias("avg_severity"),
        F.count_if(F.col("overall_severity") > 0).alias("anomaly_count"),
    )


def method_summary(scored: DataFrame) -> DataFrame:
    """Flagged rows per metric and detector, plus the multivariate count: one aggregate."""
    labels = {"traffic": "Traffic", "aqi": "Air Quality", "energy": "Energy"}
    counts = scored.agg(
        *[
            F.count_if(F.col(flag_name(m, method))).alias(f"{m}_{method}")
            for m in METRICS
            for method in METHODS
        ],
        F.count_if("multivariate_anomaly").alias("_multi"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(labels[m]).alias("metric"),
                F.col(f"{m}_zscore").alias("zscore_anomalies"),
                F.col(f"{m}_iqr").alias("iqr_anomalies"),
                F.col(f"{m}_ma").alias("moving_avg_anomalies"),
                F.col(f"{m}_time").alias("time_based_anomalies"),
                F.col("_multi").alias("multivariate_anomalies"),
            )
            for m in METRICS
        ]
    )
    return counts.select(F.inline(rows))


def high_severity_points(scored: DataFrame, at_least: int = 3) -> DataFrame:
    return scored.where(F.col("overall_severity") >= at_least)


def flagged_points(scored: DataFrame, metric: str, method: str = "zscore") -> DataFrame:
    """Rows one detector flags on one metric (NULL flags are not points)."""
    return scored.where(F.col(flag_name(metric, method)))
