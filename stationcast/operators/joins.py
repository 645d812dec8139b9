"""Joining the hourly feeds, and finding the reading nearest to a request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcast import schema as S


def merge_hourly(air: DataFrame, weather: DataFrame) -> DataFrame:
    """Rows both feeds have, by station and time."""
    return air.join(weather, [S.STATION, "time"], "inner")


def nearest_reading(merged: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (city, requested_at): the reading of that day nearest to the request's full
    hour, the earlier one on ties. A request whose day has no reading gets no row.

    Request hours lie on the hour grid, so of all readings between two full hours only the first and
    the last can be nearest. Reducing to those first leaves at most 48 readings and 24 different
    request hours per station and day, whatever the number of rows.
    """
    payload = F.struct(*[c for c in merged.columns if c not in (S.STATION, "time")])
    micros = F.unix_micros("time")
    edges = (merged
             .groupBy(S.STATION, F.date_trunc("hour", "time").alias("_slot"))
             .agg(F.min(F.struct(F.col("time"), payload.alias("row"))).alias("first"),
                  F.min(F.struct((-micros).alias("later"), F.col("time"), payload.alias("row"))).alias("last"))
             .select(S.STATION, F.to_date("_slot").alias("_day"), F.inline(F.array(
                 F.struct("first.time", "first.row"), F.struct("last.time", "last.row")))))
    hours = (requests.select(S.STATION, F.date_trunc("hour", "requested_at").alias("_hour")).distinct()
             .withColumn("_day", F.to_date("_hour")))
    distance = F.abs(F.unix_micros("time") - F.unix_micros("_hour"))
    nearest = (hours.join(edges, [S.STATION, "_day"])
               .groupBy(S.STATION, "_hour")
               .agg(F.min(F.struct(distance.alias("away"), F.col("time"), F.col("row"))).alias("best")))
    return (requests.withColumn("_hour", F.date_trunc("hour", "requested_at"))
            .join(nearest, [S.STATION, "_hour"])
            .select(*requests.columns, "best.time", "best.row.*"))
