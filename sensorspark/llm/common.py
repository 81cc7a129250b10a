"""Helpers that several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorspark.session import prepare as prepare_session

# Bounds on one Arrow batch, so that a Python worker holds few whole texts at a time.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20


def prepare(spark: SparkSession) -> None:
    prepare_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores put in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus


def labels_of(labels: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """(key, label): one row per labelled document; the smaller label wins where rows disagree."""
    return (
        labels.where(F.col(key).isNotNull() & F.col(name).isin(0, 1))
        .groupBy(F.col(key).alias("label_key"))
        .agg(F.min(name).cast("int").alias("label"))
    )
