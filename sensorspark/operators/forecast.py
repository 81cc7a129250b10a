"""Random-forest forecasts: training, chronological evaluation, importances, scenario scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorspark.functions import calendar
from sensorspark.operators import bagged, sequence
from sensorspark.operators.features import MODELS, SERIES
from sensorspark.session import with_scalars

# Forest size, features tried per split and smallest node.
NUM_TREES = 100
FEATURES_PER_SPLIT = 4
MIN_NODE = 5
# Trees end by node size alone; this is the deepest that Spark allows.
MAX_DEPTH = 30


def train(
    train_rows: DataFrame,
    model: str,
    seed: int = 123,
) -> PipelineModel:
    """One forest of ``features.MODELS``; trees grow level by level across the executors."""
    label, inputs = MODELS[model]
    if train_rows.isEmpty():
        raise ValueError(f"no complete rows to train the {model} model on")
    forest = RandomForestRegressor(
        labelCol=label,
        featuresCol="features",
        predictionCol="predicted",
        numTrees=NUM_TREES,
        featureSubsetStrategy=str(FEATURES_PER_SPLIT),
        minInstancesPerNode=MIN_NODE,
        maxDepth=MAX_DEPTH,
        seed=seed,
    )
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    return Pipeline(stages=[assembler, forest]).fit(train_rows.select(label, *inputs))


def split_parts(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split.where("is_train"), split.where(~F.col("is_train"))


def predict(fitted: PipelineModel, rows: DataFrame, model: str) -> DataFrame:
    """(model, row_id, timestamp, actual, predicted)."""
    label, _ = MODELS[model]
    return fitted.transform(rows).select(
        F.lit(model).alias("model"),
        "row_id",
        "timestamp",
        F.col(label).alias("actual"),
        "predicted",
    )


def metrics(predictions: DataFrame) -> DataFrame:
    """RMSE, MAE and squared correlation of actual and predicted, per model, in one pass."""
    error = F.col("actual") - F.col("predicted")
    return predictions.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.pow(F.corr("actual", "predicted"), 2).alias("r2"),
    )


def performance_table(metric_rows: DataFrame) -> DataFrame:
    """The rounded report: two decimals for errors, four for the squared correlation."""
    return metric_rows.select(
        "model",
        F.round("rmse", 2).alias("rmse"),
        F.round("mae", 2).alias("mae"),
        F.round("r2", 4).alias("r_squared"),
    )


UNITS = {"energy": " kWh"}


def performance_lines(metric_rows: DataFrame, split: DataFrame) -> DataFrame:
    """(position, value): the text report on the models, numbers of rows first."""
    rows = split.agg(F.count_if("is_train").alias("_train"), F.count_if(~F.col("is_train")).alias("_test"))
    head = rows.select(
        F.posexplode(
            F.array(
                F.lit("MODEL PERFORMANCE SUMMARY"), F.lit("=" * 60), F.lit(""),
                F.concat(F.lit("Training Records: "), F.col("_train")), F.concat(F.lit("Test Records: "), F.col("_test")), F.lit(""),
            )
        ).alias("position", "value")
    )
    table = performance_table(metric_rows)
    parts = [head]
    for place, name in enumerate(MODELS, 1):
        unit = UNITS.get(name, "")
        lines = F.array(
            F.lit(f"{place}. {name.upper()} MODEL"),
            F.concat(F.lit("  RMSE: "), F.format_string("%.2f", "rmse"), F.lit(unit)),
            F.concat(F.lit("  MAE: "), F.format_string("%.2f", "mae"), F.lit(unit)),
            F.concat(F.lit("  R²: "), F.coalesce(F.format_string("%.4f", "r_squared"), F.lit("NA"))),
            F.lit(""),
        )
        own = table.where(F.col("model") == name).select(F.posexplode(lines).alias("position", "value"))
        parts.append(own.withColumn("position", F.col("position") + 10 * place))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def test_series(predictions: DataFrame, split: DataFrame, n: int = 500) -> DataFrame:
    """The first ``n`` test rows per model with a 1-based time index."""
    first = split.agg(F.min(F.when(~F.col("is_train"), F.col("row_id"))).alias("_first"))
    indexed = with_scalars(predictions, first).withColumn(
        "time", F.col("row_id") - F.col("_first") + 1
    )
    return indexed.where(F.col("time") <= n).select(
        "model", "time", "timestamp", "actual", "predicted"
    )


def impurity_importance(
    spark: SparkSession, fitted: PipelineModel, model: str, top: int = 5
) -> DataFrame:
    """Impurity-based importance, strongest first; the model holds one weight per input."""
    _, inputs = MODELS[model]
    weights = fitted.stages[-1].featureImportances.toArray()
    rows = [(name, float(w)) for name, w in zip(inputs, weights)]
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(top)


def permutation_importance(rows: DataFrame, model: str, seed: int = 123, top: int = 5) -> DataFrame:
    """(feature, importance): mean rise of the trees' out-of-bag errors over its standard error, when
    one input is shuffled; strongest first.

    ``rows`` are written training rows with a dense ``row_id`` from 1.  A second numbering in the order
    of a seeded digest pairs every row with a random donor (an equi-join on unique integers).
    """
    label, inputs = MODELS[model]
    forest = bagged.grow(rows, inputs, label, NUM_TREES, FEATURES_PER_SPLIT, seed)
    errors = bagged.tree_errors(forest, rows, shuffled(rows, inputs, seed), label)
    return bagged.importance(errors, inputs).select("feature", "importance").orderBy(F.desc("importance"), "feature").limit(top)


def shuffled(rows: DataFrame, inputs: list[str], seed: int) -> DataFrame:
    """(row_id, donor): the inputs of another row, a random one-to-one pairing."""
    digest = F.md5(F.concat(F.col("row_id").cast("string"), F.lit(f":{seed}")))
    drawn = rows.select(F.array(*[F.col(c).cast("double") for c in inputs]).alias("donor"), digest.alias("_draw"), F.col("row_id").alias("_key"))
    return sequence.with_row_id(drawn, ["_draw", "_key"], "donors").select("row_id", "donor")


SCENARIO_RANGES = {"hour": (0, 23), "temperature": (-10.0, 40.0), "humidity": (0.0, 100.0)}


def checked_scenarios(scenarios: DataFrame) -> DataFrame:
    """Fail on values outside the accepted ranges, or missing, instead of scoring them."""
    kinds = dict(scenarios.dtypes)

    def checked(c: str, lo: float, hi: float) -> Column:
        outside = F.raise_error(F.lit(f"{c} must lie in {lo}..{hi}")).cast(kinds[c])
        missing = F.raise_error(F.lit(f"{c} is missing")).cast(kinds[c])
        return F.when(F.col(c).isNull(), missing).when(F.col(c).between(lo, hi), F.col(c)).otherwise(outside)

    return scenarios.withColumns(
        {c: checked(c, lo, hi) for c, (lo, hi) in SCENARIO_RANGES.items()}
    )


def scenario_inputs(scenarios: DataFrame, master: DataFrame) -> DataFrame:
    """What-if rows (hour, weekend, temperature, humidity) completed with the table's means."""
    means = master.agg(
        *[F.avg(c).alias(c) for c in SERIES.values()], F.avg("avg_NO2").alias("avg_NO2")
    )
    filled = with_scalars(checked_scenarios(scenarios), means)
    history = {
        f"{name}_{kind}": F.col(c) for name, c in SERIES.items() for kind in ("lag1", "lag24", "ma7")
    }
    return filled.withColumns(
        {
            **history,
            "is_weekend_num": F.col("weekend").cast("int"),
            "weekday_num": F.when(F.col("weekend"), 1).otherwise(3),
            "hour_sin": calendar.hour_sin(F.col("hour")),
            "hour_cos": calendar.hour_cos(F.col("hour")),
            "wind_speed": F.lit(10.0),
            "precipitation_mm": F.lit(0.0),
        }
    )


def score_scenarios(
    fitted: dict[str, PipelineModel], scenarios: DataFrame, master: DataFrame
) -> DataFrame:
    """Each scenario with the prediction of every model."""
    out = scenario_inputs(scenarios, master)
    for name, model in fitted.items():
        out = (
            model.transform(out)
            .withColumnRenamed("predicted", f"predicted_{name}")
            .drop("features")
        )
    return out.select(
        "hour", "weekend", "temperature", "humidity", *[f"predicted_{m}" for m in fitted]
    )
