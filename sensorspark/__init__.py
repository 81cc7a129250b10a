"""Spark-native analytics for hourly sensor and metering data."""
