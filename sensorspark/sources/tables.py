"""Readers and writers: CSV interchange, typed tables, result bundles, models and reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from sensorspark.functions.calendar import parse_timestamp
from sensorspark.sources.schemas import RAW_SCHEMAS

CSV_OPTIONS = {"header": "true", "nullValue": "NA", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def _stamps(schema: StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, TimestampType)]


def _read_text(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The CSV with its timestamps as text."""
    stamps = _stamps(schema)
    loose = StructType([StructField(f.name, StringType()) if f.name in stamps else f for f in schema.fields])
    return spark.read.schema(loose).options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header.  Timestamps may be dates or have seconds, with or without a fraction; text
    that is none of these gives NULL and is counted by ``unreadable_stamps``."""
    return _read_text(spark, path, schema).withColumns({c: parse_timestamp(F.col(c)) for c in _stamps(schema)})


def unreadable_stamps(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One row: for each timestamp column, how many values are there but cannot be read."""
    return _read_text(spark, path, schema).agg(
        *[F.count_if(F.col(c).isNotNull() & parse_timestamp(F.col(c)).isNull()).alias(c) for c in _stamps(schema)]
    )


@dataclass(frozen=True)
class CheckedCsv:
    """``accepted`` has the schema's columns; ``rejected`` has file, line and reasons, an array of
    (column, value, expected); ``counts`` has read, accepted and rejected rows per file."""

    accepted: DataFrame
    rejected: DataFrame
    counts: DataFrame


def read_checked(spark: SparkSession, path: str, schema: StructType, header: bool = True) -> CheckedCsv:
    """CSV of which every line ends up in exactly one of two tables.

    A line is rejected when its number of columns is wrong (short and long lines, and lines in which
    a stray quote swallows the rest) or when a cell cannot be read as its column's type; all such cells
    of a line are reported.  ``NA`` and empty cells are missing values, not errors.  Blank lines are no
    lines.
    """
    corrupt = "_corrupt"
    while corrupt in schema.fieldNames():
        corrupt = "_" + corrupt
    text = StructType([*[StructField(f.name, StringType()) for f in schema.fields], StructField(corrupt, StringType())])
    # Without pruning every read sees all columns, hence the same lines as wrong.
    options = CSV_OPTIONS | {
        "header": str(header).lower(), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt, "columnPruning": "false",
    }
    lines = spark.read.schema(text).options(**options).csv(path).select("*", F.col("_metadata.file_path").alias("_file"))

    def typed(f: StructField) -> Column:
        cell = F.col(f"`{f.name}`")
        if isinstance(f.dataType, TimestampType):
            return parse_timestamp(cell)
        return cell if isinstance(f.dataType, StringType) else F.trim(cell).try_cast(f.dataType)

    def problem(f: StructField) -> Column:
        cell = F.col(f"`{f.name}`")
        told = F.struct(F.lit(f.name).alias("column"), cell.alias("value"), F.lit(f.dataType.simpleString()).alias("expected"))
        return F.when(cell.isNotNull() & typed(f).isNull(), told)

    shape = F.struct(
        F.lit(None).cast("string").alias("column"), F.col(corrupt).alias("value"), F.lit(f"{len(schema)} columns").alias("expected")
    )
    cells = F.filter(F.array(*[problem(f) for f in schema.fields]), lambda p: p.isNotNull())
    judged = lines.withColumn("_reasons", F.when(F.col(corrupt).isNotNull(), F.array(shape)).otherwise(cells))
    good = F.size("_reasons") == 0
    whole = F.coalesce(F.col(corrupt), F.to_csv(F.struct(*[f"`{f.name}`" for f in schema.fields]), {"nullValue": "NA"}))
    return CheckedCsv(
        judged.where(good).select(*[typed(f).alias(f.name) for f in schema.fields]),
        judged.where(~good).select(F.col("_file").alias("file"), whole.alias("line"), F.col("_reasons").alias("reasons")),
        judged.groupBy(F.col("_file").alias("file")).agg(
            F.count(F.lit(1)).alias("read"), F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected")
        ),
    )


def read_raw(spark: SparkSession, feed: str, path: str) -> DataFrame:
    """One of the raw feeds (``traffic``, ``air_quality``, ``energy``, ``weather``) from CSV."""
    return read_csv(spark, path, RAW_SCHEMAS[feed])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_by_month(df: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Typed table partitioned by calendar month, so time-range filters prune whole folders.

    The rebalance hint groups rows by month and lets adaptive execution split a month that is too
    big for one task, so a hot month is written by many tasks and a small one makes one file.
    """
    dated = df.withColumn("month", F.date_format(ts, "yyyy-MM"))
    write_table(dated.hint("rebalance", F.col("month")), path, partition_by="month")


def ensure(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the table at ``path``; build and write it first when it does not exist.

    A folder left behind by a write that never committed holds no data files and is rebuilt.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    write_table(build(), path)
    return spark.read.parquet(path)


class BundleError(ValueError):
    """A bundle that is absent, half-written or not what its manifest says."""


@dataclass(frozen=True)
class Bundle:
    version: int
    tables: dict[str, DataFrame]
    models: dict[str, PipelineModel]


MANIFEST = "version bigint, member string, kind string, schema string, n bigint, digest string"


def content_digest(df: DataFrame) -> DataFrame:
    """One row (n, digest): rows and a sum of row hashes, which no order of rows changes."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def _manifest(spark: SparkSession, prefix: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).json(f"{prefix}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_bundle(tables: Mapping[str, DataFrame], prefix: str, models: Mapping[str, PipelineModel] | None = None) -> int:
    """A named set of result tables and models under ``prefix``; returns its version.

    Every version has a folder of its own.  Its manifest (names, schemas, row counts and digests of
    the tables as read back) is appended last, in one committed write: a bundle whose writing broke off
    has no manifest, and readers go on seeing the version before.
    """
    spark = next(iter(tables.values())).sparkSession
    known = _manifest(spark, prefix)
    version = 1 if known is None else (known.agg(F.max("version")).first()[0] or 0) + 1
    told = []
    for name, df in tables.items():
        path = f"{prefix}/{version}/{name}"
        write_table(df, path)
        stored = read_table(spark, path, df.schema)
        n, digest = content_digest(stored).first()
        told.append((version, name, "table", df.schema.json(), n, digest))
    for name, model in (models or {}).items():
        write_model(model, f"{prefix}/{version}/{name}")
        told.append((version, name, "model", None, None, None))
    # One row per member.
    spark.createDataFrame(told, MANIFEST).coalesce(1).write.mode("append").json(f"{prefix}/manifest")
    return version


def read_bundle(spark: SparkSession, prefix: str, version: int | None = None, verify: bool = True) -> Bundle:
    """The latest (or a given) complete version; ``verify`` compares its tables with the manifest."""
    known = _manifest(spark, prefix)
    latest = None if known is None else known.agg(F.max("version")).first()[0]
    version = version or latest
    told = [] if latest is None else known.where(F.col("version") == version).collect()
    if not told:
        raise BundleError(f"no complete bundle at {prefix}")
    found, models = {}, {}
    for r in told:
        path = f"{prefix}/{version}/{r['member']}"
        if r["kind"] == "model":
            models[r["member"]] = read_model(path)
            continue
        try:
            df = read_table(spark, path, StructType.fromJson(json.loads(r["schema"])))
            same = not verify or tuple(content_digest(df).first()) == (r["n"], r["digest"])
        except AnalysisException as error:
            raise BundleError(f"member {r['member']} of {prefix} is missing") from error
        if not same:
            raise BundleError(f"member {r['member']} of {prefix} differs from the manifest")
        found[r["member"]] = df
    return Bundle(version, found, models)


def write_anomaly_marts(marts: Mapping[str, DataFrame], prefix: str) -> None:
    """Anomaly records, severity summary and method summary, as CSV and as parquet."""
    for name, df in marts.items():
        write_csv(df, f"{prefix}/csv/{name}")
        write_table(df, f"{prefix}/parquet/{name}")


def write_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def read_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def findings_lines(findings: DataFrame) -> DataFrame:
    """Key/value findings as ``key: value`` text lines in report order."""
    return findings.orderBy("position").select(F.concat_ws(": ", "key", "value").alias("value"))


def write_findings(findings: DataFrame, path: str) -> None:
    """Text report; a report holds a fixed, small number of lines, hence the single file."""
    findings_lines(findings).coalesce(1).write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """(position, value) as a text file in order; a report has a fixed, small number of lines."""
    lines.orderBy("position").select("value").coalesce(1).write.mode("overwrite").text(path)


def preview(df: DataFrame, order_by: list[Column], n: int = 1000) -> DataFrame:
    """The first ``n`` rows in a stated order (a top-n heap per task, not a full sort)."""
    return df.orderBy(*order_by).limit(n)
