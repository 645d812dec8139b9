"""Casting, calendar, filters, column lists, display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcast import schema as S
from stationcast.functions import cleaning as C
from stationcast.functions import display as D
from stationcast.operators import dedup
from stationcast.sources import payloads
from workloads import sql as Q
from workloads.registry import query
from workloads.tables import Tables

CITY, TIME = S.STATION, S.TIME


@query("readings", f"WITH {Q.READINGS} SELECT {Q.READING_OUT} FROM readings")
def readings(t: Tables) -> DataFrame:
    return t.readings


@query("coerce_types", """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS aqi,
  TRY_CAST(event_type AS DOUBLE) AS pm25, round(value + 1e-9, 4) AS pm10,
  CASE WHEN event_type = 'view' THEN NULL ELSE value END IS NULL AS nan_is_null,
  CAST(hour(ts) AS BIGINT) AS hour FROM events""")
def coerce_types(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id", F.get_json_object("props", "$.k").alias("aqi"), F.col("event_type").alias("pm25"),
        F.col("value").cast("string").alias("pm10"),
        F.when(F.col("event_type") == "view", "NaN").otherwise(F.col("value").cast("string")).alias("o3"),
        F.hour("ts").cast("int").alias("hour"))
    typed = C.coerce_int(C.coerce_numeric(rows))
    return typed.withColumn("nan_is_null", F.col("o3").isNull()).drop("o3")


@query("parse_timestamp", """SELECT event_id, CASE WHEN event_type <> 'error'
  THEN CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) END AS parsed FROM events""")
def parse_timestamp(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t.events.select("event_id", C.parse_timestamp(text).alias("parsed"))


@query("time_features", f"WITH {Q.RAW} SELECT {Q.KEY}, {Q.CALENDAR} FROM raw")
def time_features(t: Tables) -> DataFrame:
    return C.time_features(t.raw.select(CITY, TIME), TIME)


@query("zero_fill", f"WITH {Q.READINGS} SELECT {Q.KEY}, {Q.r(*S.MEASURES)} FROM readings")
def zero_fill(t: Tables) -> DataFrame:
    return C.zero_fill(t.raw)


@query("co_to_mg", f"WITH {Q.RAW} SELECT {Q.KEY}, round(so2 / 1000.0 + 1e-9, 4) AS co FROM raw")
def co_to_mg(t: Tables) -> DataFrame:
    return t.raw.select(CITY, TIME, C.co_to_mg(F.col("so2")).alias("co"))


@query("placeholder_targets", f"""WITH {Q.RAW} SELECT {Q.KEY}, 0.0::DOUBLE AS target_aqi,
  strftime(ingestion_timestamp + INTERVAL 3 DAY, '%Y-%m-%d') AS target_day FROM raw""")
def placeholder_targets(t: Tables) -> DataFrame:
    return C.placeholder_targets(t.raw.select(CITY, TIME), TIME)


@query("format_key_ts", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS key_ts FROM events""")
def format_key_ts(t: Tables) -> DataFrame:
    return t.events.select("event_id", C.format_key_ts(F.col("ts")).alias("key_ts"))


@query("stamp_ingestion", """SELECT event_id, date_trunc('second', ts) AS ingestion_timestamp FROM events""")
def stamp_ingestion(t: Tables) -> DataFrame:
    return C.stamp_ingestion(t.events, F.col("ts")).select("event_id", TIME)


@query("numeric_columns", f"WITH {Q.READINGS} SELECT {Q.KEY}, {Q.r(*S.MEASURES)} FROM readings")
def numeric_columns(t: Tables) -> DataFrame:
    rows = t.readings
    return rows.select(CITY, TIME, *C.numeric_columns(rows))


_ALIGNED = ["wind_speed", "pm25", "snow_depth", "aqi_lag_24h", "hour"]


@query("align_features", f"""WITH {Q.READINGS}, lagged AS (SELECT *, {Q.LAGS} FROM readings {Q.WINDOWS})
  SELECT {Q.KEY}, {Q.r('wind_speed', 'pm25')}, 0.0::DOUBLE AS snow_depth, {Q.r('aqi_lag_24h')}, hour
  FROM lagged""")
def align_features(t: Tables) -> DataFrame:
    from stationcast.operators.series import lag_features
    return C.align_features(lag_features(t.readings), _ALIGNED, keep=S.KEY)


# --- filters -------------------------------------------------------------------------------

@query("only_city", f"WITH {Q.READINGS} SELECT {Q.READING_OUT} FROM readings WHERE city IN ('site-1', 'site-3')")
def only_city(t: Tables) -> DataFrame:
    return C.only_city(t.readings, "site-1", "site-3")


@query("drop_zero_weather", f"WITH {Q.CLEAN} SELECT {Q.READING_OUT} FROM clean")
def drop_zero_weather(t: Tables) -> DataFrame:
    return C.drop_zero_weather(t.readings)


@query("require_aqi", f"""WITH {Q.RAW} SELECT {Q.KEY}, round(pm25 + 1e-9, 4) AS aqi,
  round(coalesce(pm10, 0.0) + 1e-9, 4) AS pm10 FROM raw WHERE pm25 IS NOT NULL""")
def require_aqi(t: Tables) -> DataFrame:
    rows = t.raw.select(CITY, TIME, F.col("pm25").alias("aqi"), "pm10")
    return C.zero_fill(C.require_aqi(rows))


@query("require_targets", f"""WITH {Q.READINGS}, labelled AS (SELECT *, {Q.FIXED_TARGETS} FROM readings {Q.WINDOWS})
  SELECT {Q.KEY}, {Q.r('aqi', *S.TARGETS)} FROM labelled WHERE {Q.present(*S.TARGETS)}""")
def require_targets(t: Tables) -> DataFrame:
    from stationcast.operators.series import targets_fixed
    return C.require_targets(targets_fixed(t.readings.select(CITY, TIME, "aqi")))


@query("require_features", f"""WITH {Q.NULLABLE}, featured AS (SELECT *, {Q.FEATURES} FROM nullable {Q.WINDOWS})
  SELECT {Q.KEY}, {Q.r('aqi', *Q.WINDOW_NAMES)} FROM featured
  WHERE {Q.present(*Q.FEATURE_NAMES)}""")
def require_features(t: Tables) -> DataFrame:
    from stationcast.operators.series import series_features
    return C.require_features(series_features(t.nullable)).select(CITY, TIME, "aqi", *Q.WINDOW_NAMES)


# --- dedup, append, union, order -----------------------------------------------------------

# The second copy of every reading is 12 hours later with a changed index, so about half of its keys
# exist already.
_LATER = """later AS (SELECT city, ingestion_timestamp + INTERVAL 12 HOUR AS ingestion_timestamp,
  aqi + 1.0 AS aqi, pm25 FROM raw)"""


def _later(rows: DataFrame) -> DataFrame:
    return rows.select(CITY, (F.col(TIME) + F.expr("INTERVAL 12 HOURS")).alias(TIME),
                       (F.col("aqi") + 1.0).alias("aqi"), "pm25")


@query("dedup_readings", f"""WITH {Q.RAW}, {_LATER}, both_sets AS (
    SELECT city, ingestion_timestamp, aqi, pm25 FROM raw UNION ALL SELECT * FROM later),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY city, ingestion_timestamp
    ORDER BY aqi NULLS LAST, pm25 NULLS LAST) AS rn FROM both_sets)
  SELECT {Q.KEY}, {Q.r('aqi', 'pm25')} FROM ranked WHERE rn = 1""")
def dedup_readings(t: Tables) -> DataFrame:
    rows = t.raw.select(CITY, TIME, "aqi", "pm25")
    return dedup.dedup_readings(dedup.concat_features(rows, _later(rows)))


@query("append_dedup", f"""WITH {Q.RAW}, {_LATER}, both_sets AS (
    SELECT city, ingestion_timestamp, aqi, pm25, 0 AS src FROM raw UNION ALL SELECT *, 1 FROM later),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY city, ingestion_timestamp ORDER BY src) AS rn FROM both_sets)
  SELECT {Q.KEY}, {Q.r('aqi', 'pm25')} FROM ranked WHERE rn = 1""")
def append_dedup(t: Tables) -> DataFrame:
    rows = t.raw.select(CITY, TIME, "aqi", "pm25")
    return dedup.append_dedup(rows, _later(rows))


@query("concat_features", f"""WITH {Q.RAW}, {_LATER} SELECT {Q.KEY}, {Q.r('aqi', 'pm25', 'pm10')} FROM raw
  UNION ALL SELECT {Q.KEY}, {Q.r('aqi', 'pm25')}, NULL FROM later""")
def concat_features(t: Tables) -> DataFrame:
    rows = t.raw.select(CITY, TIME, "aqi", "pm25", "pm10")
    return dedup.concat_features(rows, _later(rows))


@query("latest_row", f"""WITH {Q.BY_USER}, ranked AS (SELECT *, row_number() OVER (
    PARTITION BY city ORDER BY ingestion_timestamp DESC) AS rn FROM by_user)
  SELECT {Q.KEY}, {Q.r(*S.MEASURES)} FROM ranked WHERE rn = 1""")
def latest_row(t: Tables) -> DataFrame:
    return dedup.latest_row(t.raw_by_user)


@query("recent_rows", f"""WITH {Q.BY_USER}, ranked AS (SELECT *, row_number() OVER (
    PARTITION BY city ORDER BY ingestion_timestamp DESC) AS rn FROM by_user)
  SELECT {Q.KEY}, {Q.r('aqi')} FROM ranked WHERE rn <= 24""")
def recent_rows(t: Tables) -> DataFrame:
    return dedup.recent_rows(t.raw_by_user.select(CITY, TIME, "aqi"), 24)


@query("chronological", f"WITH {Q.RAW} SELECT {Q.KEY}, {Q.r('aqi')} FROM raw ORDER BY 2, 1")
def chronological(t: Tables) -> DataFrame:
    return dedup.chronological(t.raw.select(CITY, TIME, "aqi"))


@query("newest_first", f"WITH {Q.RAW} SELECT {Q.KEY}, {Q.r('aqi')} FROM raw ORDER BY 2 DESC, 1")
def newest_first(t: Tables) -> DataFrame:
    return dedup.newest_first(t.raw.select(CITY, TIME, "aqi"))


@query("head_rows", f"WITH {Q.RAW} SELECT {Q.KEY}, {Q.r('aqi')} FROM raw ORDER BY 1, 2 LIMIT 50")
def head_rows(t: Tables) -> DataFrame:
    return dedup.head(t.raw.select(CITY, TIME, "aqi"), 50)


# --- display -------------------------------------------------------------------------------

def _case(column: str, field: int) -> str:
    whens = " ".join(f"WHEN {column} <= {c[0]} THEN '{c[field]}'" for c in S.CATEGORIES[:-1])
    return f"CASE {whens} ELSE '{S.CATEGORIES[-1][field]}' END"


@query("aqi_category", f"""WITH {Q.RAW}, scaled AS (SELECT {Q.KEY}, CAST(round(aqi * 10) AS BIGINT) AS index_value FROM raw)
  SELECT {Q.KEY}, index_value, {_case('index_value', 1)} AS label, {_case('index_value', 2)} AS css_class,
  {_case('index_value', 3)} AS pill_class, {_case('index_value', 4)} AS advice FROM scaled""")
def aqi_category(t: Tables) -> DataFrame:
    rows = t.raw.select(CITY, TIME, F.round(F.col("aqi") * 10).cast("bigint").alias("index_value"))
    return rows.withColumns(D.aqi_category(F.col("index_value")))


@query("finalize_prediction", """SELECT event_id, CAST(greatest(0, round_even(value - 20.0, 0)) AS BIGINT) AS pred_aqi,
  CAST(greatest(0, round_even((event_id % 9 - 2) / 2.0, 0)) AS BIGINT) AS halves FROM events""")
def finalize_prediction(t: Tables) -> DataFrame:
    return t.events.select("event_id", D.finalize_prediction(F.col("value") - 20.0).alias("pred_aqi"),
                           D.finalize_prediction((F.col("event_id") % 9 - 2) / 2.0).alias("halves"))


@query("horizon_label", f"""WITH {Q.RAW} SELECT {Q.KEY}, h AS horizon,
  CASE h WHEN 1 THEN 'Tomorrow' WHEN 2 THEN 'Day 2' ELSE 'Day 3' END AS day_label,
  strftime(CAST(ingestion_timestamp AS DATE) + CAST(h AS INTEGER), '%a, %b %d') AS target_date
  FROM raw, (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS h)""")
def horizon_label(t: Tables) -> DataFrame:
    rows = t.raw.select(CITY, TIME, F.explode(F.array(*[F.lit(h) for h in S.HORIZONS])).alias("horizon"))
    return rows.select("*", D.horizon_label(F.col("horizon")).alias("day_label"),
                       D.horizon_date(F.to_date(TIME), F.col("horizon")).alias("target_date"))


_LABELS = ", ".join(f"('{k}', '{v}')" for k, v in S.FEATURE_LABELS.items())


@query("display_labels", f"""WITH {Q.NULLABLE}, names(feature, label) AS (VALUES {_LABELS}),
  counts AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, count({c}) AS non_null FROM nullable"
                                 for c in [*S.MEASURES, *S.CALENDAR])})
  SELECT feature, non_null, coalesce(label, feature) AS label FROM counts LEFT JOIN names USING (feature)""")
def display_labels(t: Tables) -> DataFrame:
    from stationcast.operators.stats import column_info
    info = column_info(t.nullable.select(*S.MEASURES, *S.CALENDAR))
    return info.select(F.col("column_name").alias("feature"), "non_null",
                       D.display_label(F.col("column_name")).alias("label"))


_CARD_ROWS = " UNION ALL ".join([
    "SELECT city, 1::BIGINT AS position, 'AQI Now' AS card, printf('%.0f', round_even(aqi, 0)) AS value FROM newest",
    "SELECT city, 2, 'PM 2.5', printf('%.1f', round_even(pm25, 1)) FROM newest",
    "SELECT city, 3, 'Temperature', printf('%.1f°C', round_even(temperature, 1)) FROM newest",
    "SELECT city, 4, 'Humidity', printf('%.0f%%', round_even(humidity, 0)) FROM newest",
    "SELECT city, 5, 'Wind Speed', printf('%.1f m/s', round_even(wind_speed, 1)) FROM newest"])


@query("condition_cards", f"""WITH {Q.RAW}, ranked AS (SELECT *, row_number() OVER (
    PARTITION BY city ORDER BY ingestion_timestamp DESC) AS rn FROM raw),
  newest AS (SELECT * FROM ranked WHERE rn = 1), cards AS ({_CARD_ROWS})
  SELECT city, position, card, coalesce(value, 'N/A') AS value FROM cards""")
def condition_cards(t: Tables) -> DataFrame:
    return D.condition_cards(dedup.latest_row(t.raw))


_CLASSES = ["XGBRegressor", "RandomForestRegressor", "GradientBoostingRegressor", "LinearRegression",
            "MultiOutputRegressor", "SVR"]


@query("model_display_name", f"""WITH classes AS (SELECT event_id,
    list_value({', '.join(f"'{c}'" for c in _CLASSES)})[event_id % 6 + 1] AS model_class,
    CASE WHEN event_id % 5 > 0 THEN list_value({', '.join(f"'{c}'" for c in _CLASSES)})[event_id % 5] END
      AS inner_class FROM events)
  SELECT event_id, CASE model_class {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in S.MODEL_LABELS.items())}
    WHEN 'MultiOutputRegressor' THEN concat('Multi-Output ', coalesce(inner_class, 'Ensemble'))
    ELSE model_class END AS name FROM classes""")
def model_display_name(t: Tables) -> DataFrame:
    classes = F.array(*[F.lit(c) for c in _CLASSES])
    e = F.col("event_id")
    inner = F.when(e % 5 > 0, F.get(classes, (e % 5 - 1).cast("int")))
    return t.events.select(
        "event_id", D.model_display_name(F.get(classes, (e % 6).cast("int")), inner).alias("name"))


# --- station feed fields -------------------------------------------------------------------

_OK = "hour(ingestion_timestamp) NOT IN (5, 6)"
_FORECAST = """CASE WHEN hour(ingestion_timestamp) % 9 >= 4 THEN 3
  WHEN hour(ingestion_timestamp) % 9 > 0 THEN hour(ingestion_timestamp) % 9 - 1 END"""
FEED_TARGETS = f"""round(aqi + {_FORECAST} + 1e-9, 4) AS target_aqi,
  strftime(CAST(ingestion_timestamp AS DATE) + CAST({_FORECAST} AS INTEGER), '%Y-%m-%d') AS target_day"""


def _feeds(t: Tables) -> DataFrame:
    lines = t.envelopes().select(F.from_json("value", S.ENVELOPE).alias("e")).select("e.*")
    return payloads.accepted(lines)


@query("flatten_reading", f"""WITH {Q.RAW} SELECT city, ingestion_timestamp AS "timestamp", {Q.r(*S.MEASURES)}
  FROM raw WHERE {_OK}""")
def flatten_reading(t: Tables) -> DataFrame:
    flat = C.coerce_numeric(payloads.flatten_reading(_feeds(t)))
    return flat.withColumn("timestamp", C.parse_timestamp(F.col("timestamp")))


@query("forecast_target", f"""WITH {Q.RAW} SELECT city, ingestion_timestamp AS "timestamp", {FEED_TARGETS}
  FROM raw WHERE {_OK}""")
def forecast_target(t: Tables) -> DataFrame:
    targets = C.coerce_numeric(payloads.extract_forecast_target(_feeds(t)))
    return targets.withColumn("timestamp", C.parse_timestamp(F.col("timestamp")))
