"""Importing this module registers every query."""

from sensorspark.plans import (  # noqa: F401
    anomalies,
    clusters,
    densities,
    exchange,
    models,
    relational,
    streams,
)
from sensorspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
