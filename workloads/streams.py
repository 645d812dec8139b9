"""Streams over landed files and the events table, run until everything that has landed is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcast import schema as S
from stationcast.session import materialize, scratch_path
from stationcast.sources import tables
from stationcast.streaming import ingest
from workloads import sql as Q
from workloads.registry import REGISTRY, query
from workloads.sources import _landed
from workloads.tables import Tables

CITY, TIME = S.STATION, S.TIME


def _event_stream(t: Tables) -> DataFrame:
    schema = t.table("events").schema
    events = t.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.sf_dir}/events.parquet*")
    return events.select("event_id", "user_id", "event_type", "value",
                         F.concat(F.lit("site-"), (F.col("user_id") % 4).cast("string")).alias(CITY),
                         F.col("ts").cast("timestamp").alias("ts"))


def _cores(t: Tables) -> int:
    return t.spark.sparkContext.defaultParallelism


def _run(t: Tables, stream: DataFrame, label: str) -> DataFrame:
    base = scratch_path(t.spark, label)
    ingest.run_to_files(stream, f"{base}/out", f"{base}/checkpoint", _cores(t))
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("stream_feed", REGISTRY["station_feed"].sql)
def stream_feed(t: Tables) -> DataFrame:
    landing = _landed(t, t.envelopes(), "feed")
    return _run(t, ingest.stream_feed(t.spark, landing, F.lit("2024-02-01 06:00:00").cast("timestamp")), "stream")


@query("stream_readings", REGISTRY["backfill"].sql)
def stream_readings(t: Tables) -> DataFrame:
    air = _landed(t, t.payloads(S.AIR_ARRAYS), "air")
    weather = _landed(t, t.payloads(S.WEATHER_ARRAYS), "weather")
    return _run(t, ingest.stream_readings(t.spark, air, weather), "stream")


@query("stream_dedup", f"SELECT DISTINCT {Q.SITE} AS city, date_trunc('hour', ts) AS ingestion_timestamp FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    rows = _event_stream(t).select(CITY, F.date_trunc("hour", "ts").alias(TIME), "value")
    return _run(t, ingest.stream_dedup(rows), "stream").select(CITY, TIME)


@query("stream_hourly", f"""WITH hours AS (SELECT {Q.SITE} AS city, date_trunc('hour', ts) AS ingestion_timestamp,
    avg(value) AS aqi, max(value) AS aqi_max, count(*) AS n_events FROM events GROUP BY 1, 2)
  SELECT {Q.KEY}, {Q.r('aqi', 'aqi_max')}, n_events FROM hours WHERE ingestion_timestamp + INTERVAL 1 HOUR
  <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def stream_hourly(t: Tables) -> DataFrame:
    """Hours the watermark has closed."""
    return _run(t, ingest.stream_hourly(_event_stream(t)), "stream")


@query("stream_upsert", REGISTRY["backfill"].sql)
def stream_upsert(t: Tables) -> DataFrame:
    air = _landed(t, t.payloads(S.AIR_ARRAYS), "air")
    weather = _landed(t, t.payloads(S.WEATHER_ARRAYS), "weather")
    root = scratch_path(t.spark, "store")
    query = ingest.stream_upsert(ingest.stream_readings(t.spark, air, weather), root, f"{root}/checkpoint",
                                 available_now=True, partitions=_cores(t))
    query.awaitTermination()
    return tables.read_features(t.spark, root)


def _landed_on(t: Tables, lines: DataFrame, folder: str, day: int) -> None:
    """Append payload files to a folder as if they had landed ``day`` days after the first of June 2024."""
    known = {f.getName() for f in _files(t, folder)}
    lines.coalesce(4).write.mode("append").text(folder)
    stamp = (1717200000 + day * 86400) * 1000
    for f in _files(t, folder):
        if f.getName() not in known:
            f.getFileSystem(t.spark._jsc.hadoopConfiguration()).setTimes(f, stamp, stamp)


def _files(t: Tables, folder: str) -> list:
    path = t.spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(t.spark._jsc.hadoopConfiguration())
    return [s.getPath() for s in files.listStatus(path)] if files.exists(path) else []


#: What lands on which day, by the day of the month modulo 5. The weather of the days 4 never does.
_WAVES = [(0, (0, 3, 4), (0, 1)), (10, (1,), (3,)), (20, (2,), (2,))]


@query("stream_late_pairs", f"""WITH {Q.RAW}, days AS (SELECT *, day(ingestion_timestamp) % 5 AS d FROM raw)
  SELECT {Q.KEY}, 'reading' AS state, round(coalesce(aqi, 0.0) + 1e-9, 4) AS aqi,
    round(coalesce(temperature, 0.0) + 1e-9, 4) AS temperature FROM days WHERE d <> 4
  UNION ALL SELECT {Q.KEY}, 'waits for weather', round(aqi + 1e-9, 4), NULL FROM days WHERE d = 4""")
def stream_late_pairs(t: Tables) -> DataFrame:
    """Air and weather that land ten days apart are paired through the quarantine; what never gets its partner stays
    there, so readings and quarantine together hold every hour that landed."""
    base = scratch_path(t.spark, "late")
    day = F.to_date(F.substring(F.get_json_object("value", "$.hourly.time[0]"), 1, 10))
    sides = {name: materialize(t.payloads(arrays).withColumn("d", F.dayofmonth(day) % 5))
             for name, arrays in (("air", S.AIR_ARRAYS), ("weather", S.WEATHER_ARRAYS))}
    for landing, air, weather in _WAVES:
        for name, wanted in (("air", air), ("weather", weather)):
            _landed_on(t, sides[name].where(F.col("d").isin(*wanted)).select("value"), f"{base}/{name}", landing)
        pairs = ingest.stream_pairs(t.spark, f"{base}/air", f"{base}/weather",
                                    landed=F.col("_metadata.file_modification_time"))
        ingest.stream_ingest(pairs, f"{base}/store", f"{base}/checkpoint", available_now=True,
                             partitions=_cores(t)).awaitTermination()
    readings = tables.read_features(t.spark, f"{base}/store")
    waiting = ingest.read_quarantine(t.spark, f"{base}/store")
    state = F.when(F.col("weather").isNull(), "waits for weather").otherwise("waits for air")
    return readings.select(CITY, TIME, F.lit("reading").alias("state"), "aqi", "temperature").unionByName(
        waiting.select(CITY, F.col("time").alias(TIME), state.alias("state"), F.col("air.aqi").alias("aqi"),
                       F.col("weather.temperature").alias("temperature")))


@query("stream_late_rows", f"""WITH ends AS (SELECT min(epoch_ms(ts)) + max(epoch_ms(ts)) AS twice FROM events),
  landed AS (SELECT {Q.SITE} AS city, date_trunc('hour', ts) AS ingestion_timestamp,
    CASE WHEN event_id % 10 = 7 THEN 3 WHEN 2 * epoch_ms(ts) < twice THEN 1 ELSE 2 END AS wave FROM events, ends),
  marks AS (SELECT w.wave, max(l.ingestion_timestamp) - INTERVAL 2 HOUR AS mark
    FROM (VALUES (1), (2), (3)) AS w(wave) LEFT JOIN landed l ON l.wave < w.wave GROUP BY 1),
  sorted AS (SELECT city, ingestion_timestamp, coalesce(ingestion_timestamp <= mark, false) AS late
    FROM landed JOIN marks USING (wave)),
  counted AS (SELECT {Q.KEY}, count(*) FILTER (late) AS late, count(*) FILTER (NOT late) AS on_time FROM sorted GROUP BY 1, 2)
  SELECT {Q.KEY}, 'late' AS state, late AS n FROM counted WHERE late > 0
  UNION ALL SELECT {Q.KEY}, 'kept', 1 FROM counted WHERE on_time > 0
  UNION ALL SELECT {Q.KEY}, 'duplicate', on_time - 1 FROM counted WHERE on_time > 1""")
def stream_late_rows(t: Tables) -> DataFrame:
    """Events in three landings, the last a tenth from all times: every one of them is kept or set aside with its reason."""
    base = scratch_path(t.spark, "on-time")
    millis = F.unix_millis("ts")
    ends = t.events.agg((F.min(millis) + F.max(millis)).alias("twice")).first()
    wave = F.when(F.col("event_id") % 10 == 7, 3).when(2 * millis < F.lit(ends["twice"]), 1).otherwise(2)
    rows = materialize(t.events.select(CITY, F.date_trunc("hour", "ts").alias(TIME), "event_id", "value", wave.alias("wave")))
    schema = rows.drop("wave").schema
    for k in (1, 2, 3):
        rows.where(F.col("wave") == k).drop("wave").write.mode("append").parquet(f"{base}/landing")
        stream = t.spark.readStream.schema(schema).parquet(f"{base}/landing")
        ingest.stream_on_time(stream, f"{base}/store", f"{base}/checkpoint", available_now=True,
                              partitions=_cores(t)).awaitTermination()
    state = (ingest.read_kept(t.spark, f"{base}/store", schema).withColumn("reason", F.lit("kept"))
             .unionByName(ingest.read_aside(t.spark, f"{base}/store", schema)))
    return state.groupBy(CITY, TIME, F.col("reason").alias("state")).agg(F.count("*").alias("n"))
