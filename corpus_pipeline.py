"""The training-data pipeline: from raw documents to packed token windows.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``.  Stages look at all rows their predecessor kept, and their decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorspark.llm import mixing, order_minhash, packing, pii, quality_rules
from sensorspark.llm.common import prepare, table
from sensorspark.llm.plans import TARGETS
from sensorspark.session import materialize

# No stage's choice of rows can be written in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff go."""
    prepare(spark)
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id."""
    prepare(spark)
    return order_minhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; the character counts follow the new texts."""
    prepare(spark)
    clean = pii.redact(docs)
    kind = dict(docs.dtypes).get("n_chars")
    return clean.withColumn("n_chars", F.length("text").cast(kind)) if kind else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows chosen to meet the target weights; a row comes once per epoch."""
    prepare(spark)
    return mixing.mixed(docs, TARGETS).select(*[f"`{c}`" for c in docs.columns])


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their token ids, window and offset."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", reject_poor),
    ("order_minhash", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written before the next reads it."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
