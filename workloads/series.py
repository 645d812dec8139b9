"""Lags, rolling windows, targets, cadence and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcast import schema as S
from stationcast.operators import joins, series
from stationcast.plans import training
from stationcast.plans.forecast import inference_row as newest_features
from stationcast.plans.forecast import stored_inference_row as newest_stored_features
from stationcast.session import materialize, scratch_path
from stationcast.sources import tables
from workloads import sql as Q
from workloads.registry import REGISTRY, query
from workloads.tables import Tables

CITY, TIME = S.STATION, S.TIME


@query("lag_features", f"WITH {Q.READINGS} SELECT {Q.KEY}, round(aqi + 1e-9, 4) AS aqi, "
       f"{', '.join(f'round(lag(aqi, {n}) OVER p + 1e-9, 4) AS aqi_lag_{n}h' for n in (24, 48, 72))} "
       f"FROM readings {Q.WINDOWS}")
def lag_features(t: Tables) -> DataFrame:
    return series.lag_features(t.readings.select(CITY, TIME, "aqi"))


def _windowed(columns: str, names: list[str], source: str = "readings", ctes: str = Q.READINGS) -> str:
    return (f"WITH {ctes}, windowed AS (SELECT {Q.KEY}, {columns} FROM {source} {Q.WINDOWS}) "
            f"SELECT {Q.KEY}, {Q.r(*names)} FROM windowed")


@query("rolling_features", _windowed(Q.ROLLING, Q.ROLLING_NAMES))
def rolling_features(t: Tables) -> DataFrame:
    rows = series.over_series(t.readings.select(CITY, TIME, "aqi"), series.rolling_columns, 71, 0)
    return rows.drop("aqi")


@query("trend_feature", _windowed(Q.TREND, ["aqi_diff_24h"]))
def trend_feature(t: Tables) -> DataFrame:
    rows = series.over_series(t.readings.select(CITY, TIME, "aqi"), series.trend_columns, 24, 0)
    return rows.drop("aqi")


@query("sensor_rolling_features", _windowed(Q.SENSOR_ROLLING, Q.SENSOR_NAMES))
def sensor_rolling_features(t: Tables) -> DataFrame:
    rows = t.readings.select(CITY, TIME, "pm25", "wind_speed")
    return series.over_series(rows, series.sensor_rolling_columns, 23, 0).drop("pm25", "wind_speed")


@query("series_features", _windowed(Q.FEATURES, Q.WINDOW_NAMES))
def series_features(t: Tables) -> DataFrame:
    return series.series_features(t.readings.select(CITY, TIME, "aqi", "pm25", "wind_speed")).select(
        CITY, TIME, *Q.WINDOW_NAMES)


@query("series_features_nullable", _windowed(Q.FEATURES, Q.WINDOW_NAMES, "raw", Q.RAW))
def series_features_nullable(t: Tables) -> DataFrame:
    return series.series_features(t.raw.select(CITY, TIME, "aqi", "pm25", "wind_speed")).select(
        CITY, TIME, *Q.WINDOW_NAMES)


@query("series_features_per_user", _windowed(Q.FEATURES, Q.WINDOW_NAMES, "by_user", Q.BY_USER))
def series_features_per_user(t: Tables) -> DataFrame:
    """Many stations; with one-week blocks most series cross block borders."""
    rows = t.raw_by_user.select(CITY, TIME, "aqi", "pm25", "wind_speed")
    return series.series_features(rows, block_days=7).select(CITY, TIME, *Q.WINDOW_NAMES)


# Daily rows need wide blocks, so that few of them are near a border.
_DAILY_BLOCK = 1000


@query("series_features_per_supplier", _windowed(Q.FEATURES, Q.WINDOW_NAMES, "suppliers", Q.SUPPLIERS))
def series_features_per_supplier(t: Tables) -> DataFrame:
    return series.series_features(t.suppliers, block_days=_DAILY_BLOCK).select(CITY, TIME, *Q.WINDOW_NAMES)


@query("row_gap", f"""WITH {Q.BY_USER} SELECT {Q.KEY}, CAST(epoch(ingestion_timestamp)
  - epoch(lag(ingestion_timestamp) OVER p) AS BIGINT) AS gap_seconds FROM by_user {Q.WINDOWS}""")
def row_gap(t: Tables) -> DataFrame:
    return series.row_gap(t.raw_by_user.select(CITY, TIME))


def _cadence(source: str) -> str:
    return f"""gaps AS (SELECT city, epoch(ingestion_timestamp) - epoch(lag(ingestion_timestamp) OVER (
    PARTITION BY city ORDER BY ingestion_timestamp)) AS gap FROM {source}),
  medians AS (SELECT city, median(gap) / 3600.0 AS median_gap_hours FROM gaps GROUP BY city),
  cadence AS (SELECT city, median_gap_hours, CASE WHEN median_gap_hours IS NULL THEN 24 ELSE
    CAST(greatest(1, round_even(24.0 / greatest(median_gap_hours, 0.1), 0)) AS BIGINT) END AS rows_per_day
    FROM medians)"""


@query("median_cadence", f"""WITH {Q.RAW}, {_cadence('raw')}
  SELECT city, {Q.r('median_gap_hours')}, rows_per_day FROM cadence""")
def median_cadence(t: Tables) -> DataFrame:
    return series.median_cadence(t.raw)


@query("median_cadence_per_user", f"""WITH {Q.BY_USER}, {_cadence('by_user')}
  SELECT city, {Q.r('median_gap_hours')}, rows_per_day FROM cadence""")
def median_cadence_per_user(t: Tables) -> DataFrame:
    return series.median_cadence(t.raw_by_user, block_days=7)


@query("targets_fixed", f"WITH {Q.READINGS}, windowed AS (SELECT {Q.KEY}, aqi, {Q.FIXED_TARGETS} FROM readings "
       f"{Q.WINDOWS}) SELECT {Q.KEY}, {Q.r('aqi', *S.TARGETS)} FROM windowed")
def targets_fixed(t: Tables) -> DataFrame:
    return series.targets_fixed(t.readings.select(CITY, TIME, "aqi"))


def _by_cadence(source: str) -> str:
    return f"""paced AS (SELECT s.*, rows_per_day FROM {source} s JOIN cadence USING (city)),
  ahead AS (SELECT *, {', '.join(f'lead(aqi, {h} * rows_per_day) OVER (PARTITION BY city ORDER BY ingestion_timestamp) AS {t}'
                                 for h, t in zip(S.HORIZONS, S.TARGETS))} FROM paced)"""


@query("targets_by_cadence", f"""WITH {Q.RAW}, {_cadence('raw')}, {_by_cadence('raw')}
  SELECT {Q.KEY}, {Q.r('aqi')}, rows_per_day, {Q.r(*S.TARGETS)} FROM ahead""")
def targets_by_cadence(t: Tables) -> DataFrame:
    return series.targets_by_cadence(t.raw.select(CITY, TIME, "aqi"))


@query("targets_by_cadence_per_user", f"""WITH {Q.BY_USER}, {_cadence('by_user')}, {_by_cadence('by_user')}
  SELECT {Q.KEY}, {Q.r('aqi')}, rows_per_day, {Q.r(*S.TARGETS)} FROM ahead""")
def targets_by_cadence_per_user(t: Tables) -> DataFrame:
    return series.targets_by_cadence(t.raw_by_user.select(CITY, TIME, "aqi"), block_days=7)


@query("targets_by_cadence_per_supplier", f"""WITH {Q.SUPPLIERS}, {_cadence('suppliers')}, {_by_cadence('suppliers')}
  SELECT {Q.KEY}, {Q.r('aqi')}, rows_per_day, {Q.r(*S.TARGETS)} FROM ahead""")
def targets_by_cadence_per_supplier(t: Tables) -> DataFrame:
    return series.targets_by_cadence(t.suppliers.select(CITY, TIME, "aqi"), block_days=_DAILY_BLOCK)


# --- frames --------------------------------------------------------------------------------

@query("training_frame_fixed", f"WITH {Q.COMPLETE} SELECT {Q.FRAME_OUT} FROM complete")
def training_frame_fixed(t: Tables) -> DataFrame:
    return training.training_frame(t.readings, targets="fixed")


@query("training_frame_cadence", f"""WITH {Q.CLEAN}, {_cadence('clean')}, {_by_cadence('clean')},
  featured AS (SELECT *, {Q.FEATURES} FROM ahead {Q.WINDOWS})
  SELECT {Q.FRAME_OUT} FROM featured WHERE {Q.present(*S.TARGETS)} AND {Q.present(*Q.FEATURE_NAMES)}""")
def training_frame_cadence(t: Tables) -> DataFrame:
    return training.training_frame(t.readings)


@query("training_frame_unfiltered", f"""WITH {Q.READINGS}, framed AS (
    SELECT *, {Q.FEATURES}, {Q.FIXED_TARGETS} FROM readings {Q.WINDOWS})
  SELECT {Q.FRAME_OUT} FROM framed WHERE {Q.present(*S.TARGETS)} AND {Q.present(*Q.FEATURE_NAMES)}""")
def training_frame_unfiltered(t: Tables) -> DataFrame:
    return training.training_frame(t.readings, targets="fixed", clean_weather=False)


@query("train_test_split", f"""WITH {Q.COMPLETE}, dealt AS (SELECT *, row_number() OVER (ORDER BY substr(md5(concat_ws('|', city,
    strftime(ingestion_timestamp, '%Y-%m-%d %H:%M:%S'), '42')), 1, 13)) AS k, count(*) OVER () AS n FROM complete)
  SELECT {Q.KEY}, CASE WHEN k <= (n * 20 + 99) // 100 THEN 'test' ELSE 'train' END AS part FROM dealt""")
def train_test_split(t: Tables) -> DataFrame:
    keys = materialize(training.training_frame(t.readings, targets="fixed").select(*S.KEY))
    train, test = training.split(keys)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("inference_row", f"""WITH {Q.READINGS}, featured AS (SELECT *, {Q.FEATURES}, row_number() OVER (
    PARTITION BY city ORDER BY ingestion_timestamp DESC) AS rn FROM readings {Q.WINDOWS})
  SELECT {Q.KEY}, {Q.r(*[c for c in S.MEASURES if c != 'aqi'])}, {', '.join(S.CALENDAR)},
  {Q.r(*Q.WINDOW_NAMES)} FROM featured WHERE rn = 1""")
def inference_row(t: Tables) -> DataFrame:
    return newest_features(t.readings)


@query("stored_inference_row", REGISTRY["inference_row"].sql)
def stored_inference_row(t: Tables) -> DataFrame:
    """The same rows from a stored table that came in three commits, of which only the days the lags reach are read."""
    root = scratch_path(t.spark, "store")
    readings = materialize(t.readings)
    for part in range(3):
        tables.upsert_features(readings.where(F.hour(TIME) % 3 == part), root)
    return newest_stored_features(t.spark, root)


@query("inference_row_per_user", f"""WITH {Q.BY_USER}, featured AS (SELECT *, {Q.FEATURES}, row_number() OVER (
    PARTITION BY city ORDER BY ingestion_timestamp DESC) AS rn FROM by_user {Q.WINDOWS})
  SELECT {Q.KEY}, {Q.r('pm25')}, 0.0::DOUBLE AS snow_depth, {Q.r(*Q.WINDOW_NAMES)} FROM featured WHERE rn = 1""")
def inference_row_per_user(t: Tables) -> DataFrame:
    rows = t.raw_by_user.select(CITY, TIME, "aqi", "pm25", "wind_speed")
    return newest_features(rows, ["pm25", "snow_depth", *Q.WINDOW_NAMES])


@query("funnel_counts", f"""WITH {Q.FRAMED}, fetched AS (SELECT city, count(*) AS fetched FROM readings GROUP BY 1),
  kept AS (SELECT city, count(*) AS deduped, count(CASE WHEN {Q.present(*S.TARGETS)} THEN 1 END) AS labelled,
    count(CASE WHEN {Q.present(*S.TARGETS)} AND {Q.present(*Q.FEATURE_NAMES)} THEN 1 END) AS complete
    FROM framed GROUP BY 1)
  SELECT city, fetched, coalesce(deduped, 0) AS deduped, coalesce(labelled, 0) AS labelled,
  coalesce(complete, 0) AS complete, CASE WHEN coalesce(complete, 0) = 0 THEN 'stop' WHEN labelled < 50 THEN 'warn'
  ELSE 'ok' END AS state FROM fetched LEFT JOIN kept USING (city)""")
def funnel_counts(t: Tables) -> DataFrame:
    from stationcast.operators.evaluate import funnel_counts as funnel
    readings = t.readings
    framed = training.labelled_frame(readings, targets="fixed")
    return funnel(readings, framed, Q.FEATURE_NAMES)


# --- joins ---------------------------------------------------------------------------------

def _feeds(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Air at every hour; weather missing wherever the user-agent mix had no signup, and doubled where
    it had a purchase."""
    raw = t.raw_by_user.withColumnRenamed(TIME, "time")
    weather = raw.select(CITY, "time", *S.WEATHER, "o3", "no2")
    once = weather.where(F.col("no2").isNull())
    doubled = once.where(F.col("o3").isNotNull())
    both = once.unionByName(doubled).drop("o3", "no2")
    return raw.select(CITY, "time", *S.POLLUTANTS), both


_FEEDS = f"""{Q.BY_USER}, air AS (SELECT city, ingestion_timestamp AS "time", {', '.join(S.POLLUTANTS)} FROM by_user),
  weather AS (SELECT city, ingestion_timestamp AS "time", {', '.join(S.WEATHER)} FROM by_user WHERE no2 IS NULL
    UNION ALL SELECT city, ingestion_timestamp, {', '.join(S.WEATHER)} FROM by_user
    WHERE no2 IS NULL AND o3 IS NOT NULL),
  merged AS (SELECT * FROM air JOIN weather USING (city, "time"))"""


@query("merge_hourly", f'WITH {_FEEDS} SELECT city, "time", {Q.r(*S.MEASURES)} FROM merged')
def merge_hourly(t: Tables) -> DataFrame:
    return joins.merge_hourly(*_feeds(t))


@query("nearest_reading", f"""WITH {_FEEDS}, requests AS (SELECT event_id, {Q.USER} AS city, ts AS requested_at FROM events),
  pairs AS (SELECT r.*, m.* EXCLUDE (city), row_number() OVER (PARTITION BY event_id ORDER BY
    abs(epoch(m."time") - epoch(date_trunc('hour', requested_at))), m."time") AS rn FROM requests r JOIN merged m
    ON m.city = r.city AND CAST(m."time" AS DATE) = CAST(requested_at AS DATE))
  SELECT event_id, city, requested_at, "time", {Q.r('aqi', 'temperature')} FROM pairs WHERE rn = 1""")
def nearest_reading(t: Tables) -> DataFrame:
    requests = t.events.select("event_id", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias(CITY),
                               F.col("ts").alias("requested_at"))
    found = joins.nearest_reading(joins.merge_hourly(*_feeds(t)), requests)
    return found.select("event_id", CITY, "requested_at", "time", "aqi", "temperature")


@query("hourly_readings", f"""WITH {_FEEDS}, requests AS (SELECT DISTINCT {Q.USER} AS city,
    date_trunc('second', ts) AS requested_at FROM events),
  pairs AS (SELECT r.*, m.* EXCLUDE (city), row_number() OVER (PARTITION BY r.city, requested_at ORDER BY
    abs(epoch(m."time") - epoch(date_trunc('hour', requested_at))), m."time") AS rn FROM requests r JOIN merged m
    ON m.city = r.city AND CAST(m."time" AS DATE) = CAST(requested_at AS DATE))
  SELECT city, "time" AS "timestamp", requested_at AS ingestion_timestamp,
  {', '.join(f'round(coalesce({c}, 0.0) + 1e-9, 4) AS {c}' for c in S.MEASURES)},
  CAST(hour("time") AS BIGINT) AS hour, CAST(day("time") AS BIGINT) AS day,
  CAST(month("time") AS BIGINT) AS month, CAST(isodow("time") - 1 AS BIGINT) AS day_of_week, 0.0::DOUBLE AS target_aqi,
  strftime(requested_at + INTERVAL 3 DAY, '%Y-%m-%d') AS target_day FROM pairs WHERE rn = 1""")
def hourly_readings(t: Tables) -> DataFrame:
    from stationcast.plans.ingest import hourly_readings as run
    requests = t.events.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias(CITY),
                               F.date_trunc("second", "ts").alias("requested_at")).distinct()
    air, weather = _feeds(t)
    return run(air, weather, requests)
