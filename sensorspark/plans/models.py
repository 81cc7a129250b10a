"""Forecast queries.  Each trains on the chronological first part of the feature frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorspark.operators import features, forecast, sequence
from sensorspark.plans.anomalies import _FEATURE_SQL, numbered_master
from sensorspark.plans.registry import query
from sensorspark.session import materialize, scratch_path, with_scalars
from sensorspark.sources import tables

NAMES = list(features.MODELS)


def _fit_all(split: DataFrame, names: list[str] = NAMES) -> dict:
    train_rows, _ = forecast.split_parts(split)
    return {name: forecast.train(train_rows, name) for name in names}


def _predictions(split: DataFrame, names: list[str] = NAMES) -> DataFrame:
    _, test_rows = forecast.split_parts(split)
    parts = [forecast.predict(m, test_rows, name) for name, m in _fit_all(split, names).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _metrics_query(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        split = features.split_frame(numbered_master(spark, d))
        return forecast.metrics(_predictions(split, [name]))

    return run


for _name in NAMES:
    query(f"rf_{_name}_metrics")(_metrics_query(_name))


@query("model_performance")
def model_performance(spark: SparkSession, d: str) -> DataFrame:
    split = features.split_frame(numbered_master(spark, d))
    return forecast.performance_table(forecast.metrics(_predictions(split)))


@query("actual_vs_predicted")
def actual_vs_predicted(spark: SparkSession, d: str) -> DataFrame:
    split = features.split_frame(numbered_master(spark, d))
    return forecast.test_series(_predictions(split), split)


def numbered_again(rows: DataFrame) -> DataFrame:
    """The rows written with dense numbers of their own."""
    return materialize(sequence.with_row_id(rows.drop("row_id"), ["timestamp"], "bag-rows"), "bag-rows")


def _importance_query(name: str, permuted: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        train_rows, _ = forecast.split_parts(features.split_frame(numbered_master(spark, d)))
        if permuted:
            return forecast.permutation_importance(numbered_again(train_rows), name)
        return forecast.impurity_importance(spark, forecast.train(train_rows, name), name)

    return run


for _name in NAMES:
    if _name != "traffic":
        query(f"feature_importance_impurity_{_name}")(_importance_query(_name, False))
        query(f"feature_importance_permutation_{_name}")(_importance_query(_name, True))


@query("feature_importance_impurity")
def feature_importance_impurity(spark: SparkSession, d: str) -> DataFrame:
    split = features.split_frame(numbered_master(spark, d))
    fitted = _fit_all(split, ["traffic"])["traffic"]
    return forecast.impurity_importance(spark, fitted, "traffic")


@query("feature_importance_permutation")
def feature_importance_permutation(spark: SparkSession, d: str) -> DataFrame:
    split = features.split_frame(numbered_master(spark, d))
    train_rows, _ = forecast.split_parts(split)
    return forecast.permutation_importance(numbered_again(train_rows), "traffic")


def scenarios(numbered: DataFrame) -> DataFrame:
    """(hour, weekend, temperature, humidity) with both values inside their accepted ranges."""
    weather = ("temperature", "humidity")
    bounds = numbered.agg(
        *[f(c).alias(f"{c}_{n}") for c in weather for n, f in (("low", F.min), ("high", F.max), ("mean", F.avg))]
    )
    cells = numbered.groupBy("hour", F.col("is_weekend").alias("weekend")).agg(*[F.avg(c).alias(c) for c in weather])

    def onto(c: str) -> Column:
        low, high = forecast.SCENARIO_RANGES[c]
        part = F.try_divide(
            F.coalesce(F.col(c), F.col(f"{c}_mean")) - F.col(f"{c}_low"), F.col(f"{c}_high") - F.col(f"{c}_low")
        )
        return (low + (high - low) * F.coalesce(part, F.lit(0.5))).alias(c)

    return with_scalars(cells, bounds).select("hour", "weekend", *[onto(c) for c in weather])


@query("scenario_scores")
def scenario_scores(spark: SparkSession, d: str) -> DataFrame:
    """One scenario per (hour, weekend) that occurs, at its mean weather on the accepted scale.

    The given values reach from 0 to 100 and more, hence a linear map of their range over the whole
    table onto the accepted one.  Where a cell has no weather, the table's mean stands in.
    """
    numbered = numbered_master(spark, d)
    split = features.split_frame(numbered)
    return forecast.score_scenarios(_fit_all(split), scenarios(numbered), numbered)


@query(
    "model_roundtrip",
    f"""WITH {_FEATURE_SQL}, n AS (SELECT count(*) AS n FROM model)
SELECT n - CAST(floor(0.8 * n) AS BIGINT) AS test_rows, 0 AS differing FROM n""",
)
def model_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Save a model, load it, and count test rows the two score differently."""
    split = features.split_frame(numbered_master(spark, d))
    train_rows, test_rows = forecast.split_parts(split)
    fitted = forecast.train(train_rows, "energy")
    path = scratch_path(spark, "model")
    tables.write_model(fitted, path)
    before = forecast.predict(fitted, test_rows, "energy").select("row_id", "predicted")
    after = forecast.predict(tables.read_model(path), test_rows, "energy").select(
        "row_id", F.col("predicted").alias("reloaded")
    )
    return before.join(after, "row_id").agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.count_if(F.col("predicted") != F.col("reloaded")).alias("differing"),
    )


@query(
    "model_bundle",
    f"""WITH {_FEATURE_SQL}, n AS (SELECT count(*) AS n FROM model)
SELECT unnest({NAMES!r}) AS model, least(100, n - CAST(floor(0.8 * n) AS BIGINT)) AS predictions, 0 AS differing, true AS has_metrics FROM n""",
)
def model_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Three models with their metrics and first 100 predictions, written as one bundle; the models that
    are read back have to predict what the bundle says."""
    split = materialize(features.split_frame(numbered_master(spark, d)), "split")
    _, test_rows = forecast.split_parts(split)
    fitted = _fit_all(split)
    members = {}
    for name, model in fitted.items():
        predictions = materialize(forecast.predict(model, test_rows, name), "predictions")
        members[f"{name}_metrics"] = forecast.metrics(predictions)
        members[f"{name}_predictions"] = predictions.orderBy("row_id").limit(100)
    path = scratch_path(spark, "models")
    tables.write_bundle(members, path, fitted)
    stored = tables.read_bundle(spark, path)
    parts = []
    for name in NAMES:
        again = forecast.predict(stored.models[name], test_rows, name).select("row_id", F.col("predicted").alias("again"))
        joined = stored.tables[f"{name}_predictions"].join(again, "row_id", "left")
        off = joined.agg(
            F.lit(name).alias("model"), F.count(F.lit(1)).alias("predictions"),
            F.count_if(~F.col("predicted").eqNullSafe(F.col("again"))).alias("differing"),
        )
        metrics = stored.tables[f"{name}_metrics"].agg(
            ((F.count(F.lit(1)) == 1) & F.every(F.col("rmse") >= F.col("mae"))).alias("has_metrics")
        )
        parts.append(with_scalars(off, metrics))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("model_report")
def model_report(spark: SparkSession, d: str) -> DataFrame:
    """The text report on the models, written and read back line by line."""
    split = materialize(features.split_frame(numbered_master(spark, d)), "split")
    lines = forecast.performance_lines(materialize(forecast.metrics(_predictions(split)), "metrics"), split)
    path = scratch_path(spark, "model-report")
    tables.write_lines(lines, path)
    return spark.read.text(path)
