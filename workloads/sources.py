"""Landed files, the reading table and its sinks. Each query writes to the shared folder and reads back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcast import schema as S
from stationcast.functions import cleaning as C
from stationcast.plans import ingest
from stationcast.session import materialize, scratch_path
from stationcast.sources import payloads, tables
from workloads import sql as Q
from workloads.cleaning import FEED_TARGETS
from workloads.registry import query
from workloads.tables import Tables

CITY, TIME = S.STATION, S.TIME
_OK = "hour(ingestion_timestamp) NOT IN (5, 6)"


def _landed(t: Tables, lines: DataFrame, label: str) -> str:
    path = scratch_path(t.spark, label)
    lines.write.text(path)
    return path


@query("station_feed", f"""WITH {Q.RAW}, fed AS (SELECT *, {FEED_TARGETS} FROM raw WHERE {_OK})
  SELECT city, ingestion_timestamp AS "timestamp", TIMESTAMP '2024-02-01 06:00:00' AS ingestion_timestamp,
  {', '.join(f'round(coalesce({c}, 0.0) + 1e-9, 4) AS {c}' for c in S.MEASURES)}, {Q.CALENDAR},
  coalesce(target_aqi, 0.0) AS target_aqi, target_day FROM fed""")
def station_feed(t: Tables) -> DataFrame:
    feeds, _ = payloads.read_station_feed(t.spark, _landed(t, t.envelopes(), "feed"))
    return ingest.feed_readings(feeds, F.lit("2024-02-01 06:00:00").cast("timestamp"))


@query("station_feed_rejected", f"""WITH {Q.RAW} SELECT 'error' AS status, CASE hour(ingestion_timestamp)
  WHEN 5 THEN concat('over quota at ', city) ELSE 'Unknown API error' END AS reason, count(*) AS n FROM raw
  WHERE NOT ({_OK}) GROUP BY 1, 2""")
def station_feed_rejected(t: Tables) -> DataFrame:
    _, bad = payloads.read_station_feed(t.spark, _landed(t, t.envelopes(), "feed"))
    return bad.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


_EVEN = "day(ingestion_timestamp) % 10 <> 3"


@query("hourly_air", f"""WITH {Q.RAW} SELECT city, ingestion_timestamp AS "time",
  {Q.r(*[c for c in S.POLLUTANTS if c != 'co'])}, round(co / 1000.0 + 1e-9, 4) AS co FROM raw WHERE {_EVEN}""")
def hourly_air(t: Tables) -> DataFrame:
    return payloads.read_hourly_air(t.spark, _landed(t, t.payloads(S.AIR_ARRAYS, break_days=True), "air"))


@query("hourly_weather", f"""WITH {Q.RAW} SELECT city, ingestion_timestamp AS "time", {Q.r(*S.WEATHER)} FROM raw WHERE {_EVEN}""")
def hourly_weather(t: Tables) -> DataFrame:
    return payloads.read_hourly_weather(
        t.spark, _landed(t, t.payloads(S.WEATHER_ARRAYS, break_days=True), "weather"))


@query("hourly_rejected", f"""WITH {Q.RAW} SELECT city, 'arrays differ in length' AS reason,
  count(DISTINCT CAST(ingestion_timestamp AS DATE)) AS n FROM raw WHERE NOT ({_EVEN}) GROUP BY 1""")
def hourly_rejected(t: Tables) -> DataFrame:
    path = _landed(t, t.payloads(S.AIR_ARRAYS, break_days=True), "air")
    landed = t.spark.read.schema(S.hourly_schema(S.AIR_ARRAYS)).json(path)
    bad = payloads.uneven_payloads(landed, S.AIR_ARRAYS)
    return bad.groupBy(CITY, "reason").agg(F.count(F.lit(1)).alias("n"))


@query("backfill", f"""WITH {Q.READINGS}, filled AS (SELECT * REPLACE (co / 1000.0 AS co) FROM readings)
  SELECT {Q.READING_OUT} FROM filled""")
def backfill(t: Tables) -> DataFrame:
    air = payloads.read_hourly_air(t.spark, _landed(t, t.payloads(S.AIR_ARRAYS), "air"))
    weather = payloads.read_hourly_weather(t.spark, _landed(t, t.payloads(S.WEATHER_ARRAYS), "weather"))
    return ingest.backfill_readings(air, weather)


_READINGS_SQL = f"WITH {Q.READINGS} SELECT {Q.READING_OUT} FROM readings"


@query("features_csv", _READINGS_SQL)
def features_csv(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "cache")
    tables.overwrite_cache(t.readings, path)
    return tables.read_features_csv(t.spark, path)


@query("features_table", _READINGS_SQL)
def features_table(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "store")
    tables.upsert_features(t.readings, root)
    return tables.read_features(t.spark, root)


@query("first_available", _READINGS_SQL)
def first_available(t: Tables) -> DataFrame:
    """The table has not been written and the snapshot is missing, so the cache answers."""
    root = scratch_path(t.spark, "store")
    tables.overwrite_cache(t.readings, f"{root}/cache")
    return tables.first_available([lambda: tables.read_latest(t.spark, root),
                                   lambda: tables.read_features(t.spark, root),
                                   lambda: tables.read_features_csv(t.spark, f"{root}/cache")])


_CHANGED = """changed AS (SELECT city, ingestion_timestamp + INTERVAL 36 HOUR AS ingestion_timestamp, aqi + 1.0 AS aqi
  FROM readings)"""


def _changed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({TIME: F.col(TIME) + F.expr("INTERVAL 36 HOURS"), "aqi": F.col("aqi") + 1.0})


def _upserted(mode: str) -> str:
    old, new = ("0", "1") if mode == "keep" else ("1", "0")
    return f"""WITH {Q.READINGS}, {_CHANGED}, both_sets AS (SELECT {Q.KEY}, aqi, {old} AS src FROM readings
    UNION ALL SELECT *, {new} FROM changed),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY city, ingestion_timestamp ORDER BY src) AS rn FROM both_sets)
  SELECT {Q.KEY}, {Q.r('aqi')} FROM ranked WHERE rn = 1"""


def _twice(t: Tables, mode: str) -> DataFrame:
    """Two batches with overlapping keys; the second one runs twice."""
    root = scratch_path(t.spark, "store")
    readings = materialize(t.readings)
    tables.upsert_features(readings, root)
    for _ in range(2):
        tables.upsert_features(_changed(readings), root, mode=mode)
    return tables.read_features(t.spark, root).select(CITY, TIME, "aqi")


@query("upsert_keep", _upserted("keep"))
def upsert_keep(t: Tables) -> DataFrame:
    return _twice(t, "keep")


@query("upsert_replace", _upserted("replace"))
def upsert_replace(t: Tables) -> DataFrame:
    return _twice(t, "replace")


@query("upsert_batches", _upserted("replace"))
def upsert_batches(t: Tables) -> DataFrame:
    """Both batches of a stream come again after the second one: the table's ledger knows them."""
    root = scratch_path(t.spark, "store")
    readings = materialize(t.readings)
    for number in (0, 1, 0, 1):
        batch = readings if number == 0 else _changed(readings)
        tables.upsert_features(batch, root, mode="replace", batch=("stream", number))
    return tables.read_features(t.spark, root).select(CITY, TIME, "aqi")


@query("open_readers", f"""WITH {Q.READINGS}, {_CHANGED}, replaced AS ({_upserted("replace")})
  SELECT 'before the replace' AS reader, {Q.KEY}, {Q.r('aqi')} FROM readings
  UNION ALL SELECT 'before the recreate', {Q.KEY}, aqi FROM replaced
  UNION ALL SELECT 'after both', {Q.KEY}, {Q.r('aqi')} FROM changed""")
def open_readers(t: Tables) -> DataFrame:
    """Readers opened before a table is rewritten keep the rows they were opened on."""
    root = scratch_path(t.spark, "store")
    readings = materialize(t.readings)
    tables.upsert_features(readings, root)
    opened = {"before the replace": tables.read_features(t.spark, root)}
    tables.upsert_features(_changed(readings), root, mode="replace")
    opened["before the recreate"] = tables.read_features(t.spark, root)
    tables.recreate_version(_changed(readings), root, tables.VERSION)
    opened["after both"] = tables.read_features(t.spark, root)
    rows = [df.select(F.lit(name).alias("reader"), CITY, TIME, "aqi") for name, df in opened.items()]
    return reduce(DataFrame.unionByName, rows)


@query("recreate_version", f"""WITH {Q.READINGS}, {_CHANGED} SELECT 4::BIGINT AS version, {Q.KEY}, {Q.r('aqi')} FROM changed
  UNION ALL SELECT 6, {Q.KEY}, {Q.r('aqi')} FROM readings""")
def recreate_version(t: Tables) -> DataFrame:
    """Version 4 is written twice, the second time with other rows; version 6 stays."""
    root = scratch_path(t.spark, "store")
    readings = materialize(t.readings)
    tables.upsert_features(readings, root, version=6)
    tables.recreate_version(readings, root, 4)
    tables.recreate_version(_changed(readings), root, 4)
    return tables.read_features(t.spark, root, 4).select(F.lit(4).alias("version"), CITY, TIME, "aqi").unionByName(
        tables.read_features(t.spark, root, 6).select(F.lit(6).alias("version"), CITY, TIME, "aqi"))


@query("latest_snapshot", f"""WITH {Q.READINGS}, {_CHANGED}, ranked AS (SELECT *, row_number() OVER (
    PARTITION BY city ORDER BY ingestion_timestamp DESC) AS rn FROM changed)
  SELECT {Q.KEY}, {Q.r('aqi')} FROM ranked WHERE rn = 1""")
def latest_snapshot(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "store")
    readings = materialize(t.readings)
    for batch in (readings, _changed(readings)):
        tables.refresh_latest(batch, root)
    return tables.read_latest(t.spark, root).select(CITY, TIME, "aqi")


@query("chunked_files", f"WITH {Q.RAW} SELECT count(*) AS n_rows, true AS chunks_hold FROM raw")
def chunked_files(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "chunks")
    tables.write_chunked(C.conform(t.readings), path)
    per_file = t.spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.sum("n").alias("n_rows"), (F.max("n") <= tables.CHUNK_ROWS).alias("chunks_hold"))
