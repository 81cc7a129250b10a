"""Named queries over the given tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, FloatType

from sensorspark.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6
# Means of decimal prices often end in an exact half of the last digit, where the order in which a
# cluster adds the values would decide the rounding; the nudge settles such ties upwards.
NUDGE = 1e-10


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return rounded(build(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round floating columns of a report, so that equal answers print equally.

    Adding 0.0 at the end turns a negative zero into a plain one.
    """
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.selectExpr(
        *[
            f"round(`{c}` + {NUDGE}D, {digits}) + 0D as `{c}`" if c in floats else f"`{c}`"
            for c in df.columns
        ]
    )


def r(expression: str, alias: str) -> str:
    """The same rounding in SQL."""
    return f"round(({expression}) + 1e-10, {DIGITS}) + 0.0 AS {alias}"


def rs(*columns: str) -> str:
    return ", ".join(r(c, c) for c in columns)
