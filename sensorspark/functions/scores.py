"""Bins, labels and small formulas on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorspark.session import any_null

# Air-quality bands (left-closed lower bounds) and the energy tariff.
AQI_BANDS = [
    (0, "Good"),
    (50, "Moderate"),
    (100, "Unhealthy_Sensitive"),
    (150, "Unhealthy"),
    (200, "Very_Unhealthy"),
    (300, "Hazardous"),
]
COST_PER_KWH = 0.12

# Number of agreeing detectors → label; more than three is Critical.
SEVERITY_LEVELS = ["Normal", "Low", "Medium", "High"]


def aqi_category(aqi: Column) -> Column:
    """Left-closed bins; below zero or missing gives NULL."""
    out = F.when(aqi.isNull() | (aqi < 0), F.lit(None).cast("string"))
    for lower, label in reversed(AQI_BANDS):
        out = out.when(aqi >= lower, label)
    return out


def traffic_light(aqi: Column) -> Column:
    return F.when(aqi < 50, "green").when(aqi < 100, "yellow").when(aqi.isNotNull(), "red")


def row_max(*cols: Column) -> Column:
    """Largest of the columns; NULL as soon as one of them is NULL."""
    return F.when(~any_null(*cols), F.greatest(*cols))


def simple_aqi(pm25: Column, pm10: Column, no2: Column) -> Column:
    return row_max(pm25 * 2, pm10 * 1.5, no2 * 1.8)


def energy_cost(kwh: Column) -> Column:
    return kwh * COST_PER_KWH


def severity_label(severity: Column) -> Column:
    out = F.when(severity >= len(SEVERITY_LEVELS), "Critical")
    for level, label in enumerate(SEVERITY_LEVELS):
        out = out.when(severity == level, label)
    return out


def cluster_label(cluster: Column) -> Column:
    return F.when(cluster == 0, "Anomaly").otherwise(
        F.concat(F.lit("Cluster "), cluster.cast("string"))
    )


def silhouette_band(score: Column) -> Column:
    return (
        F.when(score > 0.7, "strong")
        .when(score > 0.5, "reasonable")
        .when(score > 0.25, "weak")
        .when(score.isNotNull(), "none")
    )
