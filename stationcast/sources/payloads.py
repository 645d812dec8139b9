"""Landed JSON payloads -> rows.

Each parser takes a DataFrame of payloads, so the same code serves a batch read, a file stream and
payloads that are already in a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast import schema as S
from stationcast.functions.cleaning import co_to_mg, parse_timestamp, to_number


# --- station feed --------------------------------------------------------------------------

def _is_ok() -> Column:
    """Status ok and an object as data; get_json_object gives null for text that is no JSON."""
    is_object = F.get_json_object("data", "$").startswith("{")
    return F.coalesce((F.col("status") == "ok") & is_object, F.lit(False))


def accepted(envelopes: DataFrame) -> DataFrame:
    """Payload objects (column ``data``) of the envelopes that carry a reading."""
    return envelopes.where(_is_ok()).select(F.from_json("data", S.FEED).alias("data"))


def rejected(envelopes: DataFrame) -> DataFrame:
    """The other envelopes with the reason they give."""
    reason = F.when(F.col("status") == "ok", F.lit("data is no object")).otherwise(
        F.coalesce("data", F.lit("Unknown API error")))
    return envelopes.where(~_is_ok()).select("status", reason.alias("reason"))


def _feed_fields() -> list[Column]:
    d = "data."
    return ([F.col(d + "city.name").alias(S.STATION), F.col(d + "time.s").alias("timestamp"),
             F.col(d + "aqi").alias("aqi")]
            + [F.col(f"{d}iaqi.{key}.v").alias(name) for key, name in S.FEED_KEYS.items()])


def _forecast_fields() -> list[Column]:
    """The entry three days ahead, or the last one of a shorter forecast."""
    days = F.col("data.forecast.daily.pm25")
    entry = (F.when(F.size(days) >= 4, F.get(days, 3))
             .when(F.size(days) > 0, F.element_at(days, -1)))
    return [entry["avg"].alias("target_aqi"), entry["day"].alias("target_day")]


def flatten_reading(feeds: DataFrame) -> DataFrame:
    """13 flat text fields; whatever the payload lacks is null."""
    return feeds.select(*_feed_fields())


def extract_forecast_target(feeds: DataFrame) -> DataFrame:
    return feeds.select(F.col("data.city.name").alias(S.STATION),
                        F.col("data.time.s").alias("timestamp"), *_forecast_fields())


def merge_targets(feeds: DataFrame) -> DataFrame:
    """Reading and forecast fields of the same payload in one row."""
    return feeds.select(*_feed_fields(), *_forecast_fields())


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.ENVELOPE).json(path)


def read_station_feed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(payloads, rejected envelopes) of landed feed files, one envelope per line."""
    envelopes = read_envelopes(spark, path)
    return accepted(envelopes), rejected(envelopes)


# --- hourly payloads -----------------------------------------------------------------------

def _arrays(names: dict[str, str]) -> list[Column]:
    return [F.col("hourly.time"), *[F.col(f"hourly.{n}") for n in names]]


def _even(names: dict[str, str]) -> Column:
    """Whether all arrays of a payload have the same length (padding would shift no value, but the
    payload is broken all the same)."""
    arrays = _arrays(names)
    same = reduce(lambda a, b: a & b, [F.size(a) == F.size(arrays[0]) for a in arrays[1:]])
    return F.coalesce(same & arrays[0].isNotNull(), F.lit(False))


def uneven_payloads(payloads: DataFrame, names: dict[str, str]) -> DataFrame:
    return payloads.where(~_even(names)).withColumn("reason", F.lit("arrays differ in length"))


def _rows(payloads: DataFrame, names: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    rows = payloads.where(_even(names)).select(S.STATION, *keep, F.inline(F.arrays_zip(*_arrays(names))))
    return rows.select(S.STATION, *keep, parse_timestamp(F.col("time")).alias("time"),
                       *[to_number(F.col(n)).alias(c) for n, c in names.items()])


def air_rows(payloads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per hour, renamed; CO in milligrams. ``keep``: columns of the payload that stay."""
    return _rows(payloads, S.AIR_ARRAYS, keep).withColumn("co", co_to_mg(F.col("co")))


def weather_rows(payloads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return _rows(payloads, S.WEATHER_ARRAYS, keep)


def read_hourly_air(spark: SparkSession, path: str) -> DataFrame:
    return air_rows(spark.read.schema(S.hourly_schema(S.AIR_ARRAYS)).json(path))


def read_hourly_weather(spark: SparkSession, path: str) -> DataFrame:
    return weather_rows(spark.read.schema(S.hourly_schema(S.WEATHER_ARRAYS)).json(path))
