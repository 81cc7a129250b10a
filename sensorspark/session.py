"""Session settings and the shared scratch area.

Intermediate tables that several later steps read (the hourly master, an ordered series,
one round of an iterative job) are written once as parquet under the folder that
``spark.checkpoint.dir`` names.  A written table survives lost executors, cuts the lineage and
keeps column pruning and filter pushdown, none of which a cached DataFrame gives.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
# Recording the Python call site of every column expression costs several milliseconds each, which
# dominates the planning of wide queries.
DEBUGGING_KEY = "spark.python.sql.dataFrameDebugging.enabled"


def get_session(app: str = "sensorspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` entries override the defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        DEBUGGING_KEY: "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the Python workers, which may run where it is not installed.

    Spark itself copies the archive from the driver to every executor, later ones too.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="sensorspark-code-")) / "sensorspark_code.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for path in sorted(root.rglob("*.py")):
            file.write(path, path.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def prepare(spark: SparkSession) -> None:
    """What every query relies on: calendar features are defined in UTC, whatever the cluster's local
    zone is, and Python workers can import this package."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Only a local session may fall back to a temporary folder; on a cluster every executor has
    to see the same path, so a missing setting is an error there.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root.rstrip("/")
    # local-cluster starts executors of their own, which a temporary folder of the driver may not suit.
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    return _local_scratch()


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="sensorspark-")


def scratch_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/sensorspark/{app}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the scratch area and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_observed(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``materialize`` and aggregates of the written rows, taken while they are written."""
    seen = Observation()
    observed = df.observe(seen, *[c.alias(n) for n, c in measures.items()])
    return materialize(observed, name), seen.get


def with_scalars(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row of ``df``.

    The aggregate becomes an uncorrelated scalar subquery: Spark evaluates it once and ships one
    struct, so there is neither a join nor a window over the whole frame.
    """
    packed = row.select(F.struct(*row.columns)).scalar()
    return (
        df.withColumn("_row", packed)
        .select("*", *[F.col(f"_row.{c}").alias(c) for c in row.columns])
        .drop("_row")
    )


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only after counting: ``df`` must be a cheap (materialised) table."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def default_tasks(df: DataFrame) -> int:
    """Task count for steps whose cost is computation, which byte-based coalescing cannot see."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def any_null(*cols: Column) -> Column:
    out = cols[0].isNull()
    for c in cols[1:]:
        out = out | c.isNull()
    return out
