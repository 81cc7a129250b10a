"""Streaming twins of the hourly rollup, the trailing-window and hour-of-day detectors, and of model
scoring.  Each takes and returns a streaming DataFrame; sinks and checkpoints are the caller's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from sensorspark.operators import anomaly
from sensorspark.session import scratch_path


def read_stream(
    spark: SparkSession, path: str, schema: StructType, pattern: str | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def hourly_rollup(
    readings: DataFrame, entity: str, value: str, ts: str = "timestamp", lateness: str = "2 hours"
) -> DataFrame:
    """Per (hour, entity): count, sum and mean; an hour is emitted once the watermark closes it, so the
    latest hours stay out until later readings arrive."""
    return (
        readings.withWatermark(ts, lateness)
        .groupBy(F.window(ts, "1 hour"), entity)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(value).alias("total"),
            F.avg(value).alias("mean"),
        )
        .select(F.col("window.start").alias("timestamp"), entity, "n", "total", "mean")
    )


class TrailingProcessor(StatefulProcessor):
    """Rows wait in state, by time, until the watermark reaches them; a timer then lets them go in time
    order, whatever trigger and file they came with.

    The state of an entity is the waiting values by time, its last ``window`` values, and how many it has
    seen.  A trigger's rows pass one by one; none of it is held but the waiting rows themselves, whose
    number the allowed lateness bounds.
    """

    def __init__(self, entity: str, value: str, window: int, threshold: float):
        self.entity, self.value, self.window, self.threshold = entity, value, window, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at timestamp", "held array<double>")
        self.past = handle.getValueState("past", "held array<double>, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for at, value in zip(frame["timestamp"], frame[self.value].to_numpy("float64")):
                time = (at.to_pydatetime(),)
                if self.waiting.containsKey(time):
                    held = [*self.waiting.getValue(time)[0], float(value)]
                else:
                    held = [float(value)]
                    # A timer fires once the watermark is beyond it, hence when it reaches the row's time.
                    self.handle.registerTimer(_millis(at) - 1)
                self.waiting.updateValue(time, (held,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs() + 1, unit="ms")
        time = (at.to_pydatetime(),)
        if not self.waiting.containsKey(time):
            return
        values = sorted(self.waiting.getValue(time)[0], key=lambda v: (np.isnan(v), v))
        self.waiting.removeKey(time)
        past, seen = self.past.get() if self.past.exists() else ([], 0)
        past, flags = list(past), []
        for value in values:
            known = np.array(past, "float64")
            known = known[~np.isnan(known)]
            sd = known.std(ddof=1) if len(known) > 1 else 0.0
            judged = seen >= self.window and sd > 0
            missing = judged and np.isnan(value)
            flags.append(pd.NA if missing else bool(judged and abs(value - known.mean()) > self.threshold * sd))
            past, seen = [*past, value][-self.window :], seen + 1
        self.past.update((past, seen))
        yield pd.DataFrame(
            {"timestamp": at, self.entity: key[0], self.value: values, "is_anomaly": pd.array(flags, dtype="boolean")}
        )

    def close(self) -> None:
        pass


def _millis(at: pd.Timestamp) -> int:
    return at.value // 1_000_000


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def trailing_flags(
    hourly: DataFrame, entity: str, value: str, window: int = 24, threshold: float = 2.0, lateness: str = "0 seconds"
) -> DataFrame:
    """Flag each hour against the ``window`` hours its entity had before it; like the batch detector, a
    missing value has no flag.

    Hours may arrive in any order within ``lateness``; what is later is refused and counted by Spark
    (``late_rows``).  An hour is judged once the watermark reaches it.  ``timestamp`` must be whole
    milliseconds.  State lives in the RocksDB store, which this sets for the session.
    """
    hourly.sparkSession.conf.set(STATE_STORE, ROCKS)
    return (
        hourly.select("timestamp", F.col(entity).cast("string").alias(entity), F.col(value).cast("double").alias(value))
        .withWatermark("timestamp", lateness)
        .groupBy(entity)
        .transformWithStateInPandas(
            TrailingProcessor(entity, value, window, threshold),
            f"timestamp timestamp, {entity} string, {value} double, is_anomaly boolean",
            "append",
            "eventTime",
        )
    )


def hour_flags(stream: DataFrame, profile: DataFrame, threshold: float = 2.0) -> DataFrame:
    """The hour-of-day detector against a static 24-row profile."""
    return anomaly.hour_of_day_flags(stream, threshold=threshold, profile=profile)


def scores(stream: DataFrame, fitted: PipelineModel, keep: list[str]) -> DataFrame:
    """Predictions of a fitted model on complete feature rows."""
    return fitted.transform(stream).select(*keep, "predicted")


def late_rows(query: StreamingQuery) -> int:
    """Rows that stateful operators of ``query`` have refused because the watermark had passed them."""
    return sum(op.numRowsDroppedByWatermark for progress in query.recentProgress for op in progress.stateOperators)


def run_available(stream: DataFrame, name: str, seen: list[StreamingQuery] | None = None) -> tuple[str, StructType]:
    """Process everything that is there, append to a parquet table and return its path; the finished
    query is added to ``seen``.

    The sink commits files per trigger and the checkpoint sits beside it in the shared folder, so a
    restarted query neither loses nor repeats rows.
    """
    path = scratch_path(stream.sparkSession, name)
    started = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    if seen is not None:
        seen.append(started)
    return f"{path}/table", stream.schema


def read_result(spark: SparkSession, result: tuple[str, StructType]) -> DataFrame:
    path, schema = result
    return spark.read.schema(schema).parquet(path)
