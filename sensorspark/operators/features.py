"""Feature frame of the forecasting models: lags, rolling means, cyclic and calendar numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorspark.functions import calendar
from sensorspark.functions.clean import complete_cases
from sensorspark.operators import sequence

SERIES = {"vehicles": "total_vehicles", "aqi": "avg_AQI", "energy": "total_energy_kwh"}
LAGS = {f"{name}_lag{k}": (c, k) for name, c in SERIES.items() for k in (1, 24)}
ROLLING = {f"{name}_ma7": c for name, c in SERIES.items()}

_SHARED = ["hour", "is_weekend_num", "weekday_num"]
_CYCLE = ["hour_sin", "hour_cos", "temperature", "humidity"]
MODELS = {
    "traffic": (
        "total_vehicles",
        [*_SHARED, "vehicles_lag1", "vehicles_lag24", "vehicles_ma7", *_CYCLE, "avg_AQI",
         "precipitation_mm"],
    ),
    "aqi": (
        "avg_AQI",
        [*_SHARED, "aqi_lag1", "aqi_lag24", "aqi_ma7", *_CYCLE, "wind_speed", "total_vehicles",
         "avg_NO2"],
    ),
    "energy": (
        "total_energy_kwh",
        [*_SHARED, "energy_lag1", "energy_lag24", "energy_ma7", *_CYCLE, "total_vehicles"],
    ),
}


def model_frame(numbered: DataFrame, leak_free: bool = False) -> DataFrame:
    """All features, rows complete in every column.

    Lags and rolling means count rows, not hours.  All of them share one pass over the blocks.
    The rolling mean holds the current row, and so the value a model predicts; ``leak_free`` ends
    it one row earlier.
    """
    shift = 1 if leak_free else 0
    frames = sequence.HaloFrames(numbered, max(k for _, k in LAGS.values()))
    lags = {name: F.lag(c, k).over(frames.ordered()) for name, (c, k) in LAGS.items()}
    means = {name: sequence.full_mean(c, frames, 7, shift) for name, c in ROLLING.items()}
    hour = F.col("hour")
    encoded = {
        "hour_sin": calendar.hour_sin(hour),
        "hour_cos": calendar.hour_cos(hour),
        "is_weekend_num": F.col("is_weekend").cast("int"),
        "weekday_num": calendar.weekday_number(F.col("timestamp")),
    }
    return complete_cases(frames.own(frames.rows.withColumns({**lags, **means})).withColumns(encoded))


def split_frame(
    numbered: DataFrame, fraction: float = 0.8, leak_free: bool = False
) -> DataFrame:
    """The feature frame renumbered over its complete rows, with the chronological split."""
    frame = model_frame(numbered, leak_free).drop("row_id")
    return sequence.chronological_split(
        sequence.with_row_id(frame, ["timestamp"], "features"), fraction
    )
