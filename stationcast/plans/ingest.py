"""Payload rows -> readings: the backfill, the hourly run and the station feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcast import schema as S
from stationcast.functions.cleaning import (coerce_int, coerce_numeric, conform, parse_timestamp,
                                            placeholder_targets, require_aqi, stamp_ingestion,
                                            time_features, with_time, zero_fill)
from stationcast.operators.joins import merge_hourly, nearest_reading
from stationcast.sources.payloads import merge_targets


def _finish(rows: DataFrame, fill: bool) -> DataFrame:
    typed = coerce_int(coerce_numeric(rows))
    return conform(zero_fill(typed) if fill else typed)


def backfill_readings(air: DataFrame, weather: DataFrame, fill: bool = True,
                      need_aqi: bool = False) -> DataFrame:
    """Every joined hour as a reading stamped with its own time.

    ``need_aqi`` drops hours without an index before missing values become 0.
    """
    return merged_readings(merge_hourly(air, weather), fill, need_aqi)


def merged_readings(merged: DataFrame, fill: bool = True, need_aqi: bool = False) -> DataFrame:
    """Joined hours as readings."""
    rows = merged.withColumns({"timestamp": F.col("time"), S.TIME: F.col("time")})
    rows = require_aqi(rows) if need_aqi else rows
    return _finish(placeholder_targets(time_features(with_time(rows))), fill)


def hourly_readings(air: DataFrame, weather: DataFrame, requests: DataFrame, fill: bool = True) -> DataFrame:
    """For each (city, requested_at): the reading nearest to the requested hour, stamped with the
    request time."""
    rows = nearest_reading(merge_hourly(air, weather), requests).withColumn("timestamp", F.col("time"))
    rows = stamp_ingestion(time_features(rows), F.col("requested_at"))
    return _finish(placeholder_targets(rows, S.TIME), fill)


def feed_readings(feeds: DataFrame, now: Column | None = None, fill: bool = True) -> DataFrame:
    """Station-feed payloads as readings stamped with the run time."""
    rows = merge_targets(feeds).withColumn("timestamp", parse_timestamp(F.col("timestamp")))
    return _finish(time_features(stamp_ingestion(with_time(rows), now)), fill)
