"""Series and payloads that Spark derives from the given tables.

``events`` becomes hourly readings of four stations (or one station per user), ``lineitem`` becomes
daily series per supplier. The measures are stand-ins; the gaps, nulls and temperatures below zero are
what the operators need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast import schema as S
from stationcast.functions.cleaning import placeholder_targets, time_features, zero_fill
from stationcast.functions.cleaning import conform


def _value_if(event_type: str) -> Column:
    return F.avg(F.when(F.col("event_type") == event_type, F.col("value")))


def _member(array: str, name: str) -> Column:
    return F.transform(array, lambda e: e[name])


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        """Events with their station and a zoned time."""
        return (self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
                .withColumn(S.STATION, F.concat(F.lit("site-"), (F.col("user_id") % 4).cast("string"))))

    def _hourly(self, events: DataFrame) -> DataFrame:
        # k is a column of its own, so that the JSON is parsed once per event.
        k = F.col("k")
        return (events.select(S.STATION, F.date_trunc("hour", "ts").alias(S.TIME), "event_type", "value",
                              F.get_json_object("props", "$.k").cast("double").alias("k"))
                .groupBy(S.STATION, S.TIME)
                .agg(F.avg("value").alias("aqi"), _value_if("click").alias("pm25"),
                     _value_if("view").alias("pm10"), _value_if("purchase").alias("o3"),
                     _value_if("signup").alias("no2"), _value_if("error").alias("so2"),
                     (F.sum("value") / 1000.0).alias("co"), (F.avg(k) - 20.0).alias("temperature"),
                     F.max(k).alias("humidity"), (F.min(k) + 1000.0).alias("pressure"),
                     F.stddev_pop("value").alias("wind_speed")))

    @property
    def raw(self) -> DataFrame:
        """Hourly readings of four stations, missing measures null."""
        return self._hourly(self.events)

    @property
    def raw_by_user(self) -> DataFrame:
        """The same with one station per user: many short series with gaps."""
        events = self.events.withColumn(S.STATION, F.concat(F.lit("user-"), F.col("user_id").cast("string")))
        return self._hourly(events)

    @property
    def nullable(self) -> DataFrame:
        """Raw readings with all reading columns."""
        rows = time_features(self.raw.withColumn("timestamp", F.col(S.TIME)))
        return conform(placeholder_targets(rows))

    @property
    def readings(self) -> DataFrame:
        """Readings as stored: missing measures are 0."""
        return zero_fill(self.nullable, S.MEASURES)

    @property
    def suppliers(self) -> DataFrame:
        """Daily series per supplier."""
        return (self.table("lineitem")
                .groupBy(F.col("l_suppkey").cast("string").alias(S.STATION),
                         F.col("l_shipdate").cast("timestamp").alias(S.TIME))
                .agg(F.avg("l_quantity").alias("aqi"), (F.avg("l_extendedprice") / 1000.0).alias("pm25"),
                     (F.avg("l_discount") * 100).alias("wind_speed")))

    # --- landed payloads -------------------------------------------------------------------

    def envelopes(self) -> DataFrame:
        """One station-feed envelope (column ``value``) per raw reading.

        Hour 5 fails with a message and hour 6 without one; a missing measure is sent as "-"; the
        forecast has hour % 9 days.
        """
        def text(c: str) -> Column:
            return F.coalesce(F.col(c).cast("string"), F.lit("-"))

        hour = F.hour(S.TIME)
        days = hour % 9
        ahead = F.transform(F.sequence(F.lit(0), days - 1), lambda i: F.struct(
            (F.col("aqi") + i).cast("string").alias("avg"),
            F.date_format(F.date_add(F.to_date(S.TIME), i), "yyyy-MM-dd").alias("day")))
        sensors = F.struct(*[F.struct(text(name).alias("v")).alias(key) for key, name in S.FEED_KEYS.items()])
        data = F.to_json(F.struct(
            text("aqi").alias("aqi"), F.struct(F.col(S.STATION).alias("name")).alias("city"),
            F.struct(F.date_format(S.TIME, "yyyy-MM-dd HH:mm:ss").alias("s")).alias("time"),
            sensors.alias("iaqi"),
            F.struct(F.struct(F.when(days > 0, ahead).alias("pm25")).alias("daily")).alias("forecast")))
        failed = F.to_json(F.struct(F.lit("error").alias("status"),
                                    F.concat(F.lit("over quota at "), S.STATION).alias("data")))
        line = (F.when(hour == 5, failed).when(hour == 6, F.lit('{"status":"error"}'))
                .otherwise(F.concat(F.lit('{"status":"ok","data":'), data, F.lit("}"))))
        return self.raw.select(line.alias("value"))

    def payloads(self, arrays: dict[str, str], break_days: bool = False) -> DataFrame:
        """One payload of parallel arrays (column ``value``) per station and day, so at most 24 entries.

        ``break_days`` makes the last array one too short on the 3rd, 13th and 23rd of a month.
        """
        day = F.to_date(S.TIME)
        entry = F.struct(F.date_format(S.TIME, "yyyy-MM-dd'T'HH:mm").alias("time"),
                         *[F.col(c).alias(n) for n, c in arrays.items()])
        daily = self.raw.groupBy(S.STATION, day.alias("_day")).agg(F.array_sort(F.collect_list(entry)).alias("_h"))
        names = ["time", *arrays]
        columns = {n: _member("_h", n) for n in names}
        if break_days:
            last = columns[names[-1]]
            broken = F.dayofmonth("_day") % 10 == 3
            columns[names[-1]] = F.when(broken, F.slice(last, 1, F.size(last) - 1)).otherwise(last)
        hourly = F.struct(*[c.alias(n) for n, c in columns.items()])
        return daily.select(F.to_json(F.struct(S.STATION, hourly.alias("hourly")),
                                      {"ignoreNullFields": "false"}).alias("value"))
