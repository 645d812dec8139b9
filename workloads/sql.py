"""SQL building blocks (DuckDB dialect) for the expected results."""

from __future__ import annotations

from stationcast import schema as S

_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


def hourly(station: str) -> str:
    return f"""SELECT {station} AS city, date_trunc('hour', ts) AS ingestion_timestamp,
  avg(value) AS aqi,
  avg(CASE WHEN event_type = 'click' THEN value END) AS pm25,
  avg(CASE WHEN event_type = 'view' THEN value END) AS pm10,
  avg(CASE WHEN event_type = 'purchase' THEN value END) AS o3,
  avg(CASE WHEN event_type = 'signup' THEN value END) AS no2,
  avg(CASE WHEN event_type = 'error' THEN value END) AS so2,
  sum(value) / 1000.0 AS co, avg({_K}) - 20.0 AS temperature, max({_K}) AS humidity,
  min({_K}) + 1000.0 AS pressure, stddev_pop(value) AS wind_speed
  FROM events GROUP BY 1, 2"""


SITE = "concat('site-', CAST(user_id % 4 AS VARCHAR))"
USER = "concat('user-', CAST(user_id AS VARCHAR))"
CALENDAR = """CAST(hour(ingestion_timestamp) AS BIGINT) AS hour, CAST(day(ingestion_timestamp) AS BIGINT) AS day,
  CAST(month(ingestion_timestamp) AS BIGINT) AS month,
  CAST(isodow(ingestion_timestamp) - 1 AS BIGINT) AS day_of_week"""
_TAIL = """0.0::DOUBLE AS target_aqi,
  strftime(ingestion_timestamp + INTERVAL 3 DAY, '%Y-%m-%d') AS target_day"""

RAW = f"raw AS ({hourly(SITE)})"
NULLABLE = RAW + f""", nullable AS (SELECT city, ingestion_timestamp AS "timestamp", ingestion_timestamp,
  {', '.join(S.MEASURES)}, {CALENDAR}, {_TAIL} FROM raw)"""
READINGS = RAW + f""", readings AS (SELECT city, ingestion_timestamp AS "timestamp", ingestion_timestamp,
  {', '.join(f'coalesce({c}, 0.0) AS {c}' for c in S.MEASURES)}, {CALENDAR}, {_TAIL} FROM raw)"""
CLEAN = READINGS + ", clean AS (SELECT * FROM readings WHERE temperature > 0)"
BY_USER = f"by_user AS ({hourly(USER)})"
SUPPLIERS = """suppliers AS (SELECT CAST(l_suppkey AS VARCHAR) AS city, l_shipdate AS ingestion_timestamp,
  avg(l_quantity) AS aqi, avg(l_extendedprice) / 1000.0 AS pm25, avg(l_discount) * 100 AS wind_speed
  FROM lineitem GROUP BY 1, 2)"""

WINDOWS = """WINDOW p AS (PARTITION BY city ORDER BY ingestion_timestamp),
  f24 AS (PARTITION BY city ORDER BY ingestion_timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW),
  f72 AS (PARTITION BY city ORDER BY ingestion_timestamp ROWS BETWEEN 71 PRECEDING AND CURRENT ROW)"""
LAGS = ("lag(aqi, 24) OVER p AS aqi_lag_24h, lag(aqi, 48) OVER p AS aqi_lag_48h, "
        "lag(aqi, 72) OVER p AS aqi_lag_72h")


def rolled(function: str, column: str, rows: int, least: int, name: str) -> str:
    return f"CASE WHEN count({column}) OVER f{rows} >= {least} THEN {function}({column}) OVER f{rows} END AS {name}"


ROLLING = ", ".join([rolled("avg", "aqi", 24, 12, "aqi_rolling_mean_24h"),
                     rolled("stddev_samp", "aqi", 24, 12, "aqi_rolling_std_24h"),
                     rolled("avg", "aqi", 72, 36, "aqi_rolling_mean_72h")])
TREND = "aqi - lag(aqi, 24) OVER p AS aqi_diff_24h"
SENSOR_ROLLING = ", ".join([rolled("avg", "pm25", 24, 12, "pm25_rolling_mean_24h"),
                            rolled("avg", "wind_speed", 24, 12, "wind_speed_rolling_mean_24h")])
FEATURES = f"{LAGS}, {ROLLING}, {TREND}, {SENSOR_ROLLING}"
FIXED_TARGETS = ", ".join(f"lead(aqi, {24 * h}) OVER p AS target_day{h}" for h in S.HORIZONS)

LAG_NAMES = ["aqi_lag_24h", "aqi_lag_48h", "aqi_lag_72h"]
ROLLING_NAMES = ["aqi_rolling_mean_24h", "aqi_rolling_std_24h", "aqi_rolling_mean_72h"]
SENSOR_NAMES = ["pm25_rolling_mean_24h", "wind_speed_rolling_mean_24h"]
WINDOW_NAMES = [*LAG_NAMES, *ROLLING_NAMES, "aqi_diff_24h", *SENSOR_NAMES]
FEATURE_NAMES = [c for c in S.MEASURES if c != "aqi"] + S.CALENDAR + WINDOW_NAMES
KEY = "city, ingestion_timestamp"


def r(*columns: str) -> str:
    """Doubles as the Spark side publishes them."""
    return ", ".join(f"round({c} + 1e-9, 4) AS {c}" for c in columns)


def present(*columns: str) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


FRAMED = CLEAN + f", framed AS (SELECT *, {FEATURES}, {FIXED_TARGETS} FROM clean {WINDOWS})"
COMPLETE = FRAMED + (f", complete AS (SELECT * FROM framed WHERE {present(*S.TARGETS)} "
                     f"AND {present(*FEATURE_NAMES)})")
READING_OUT = (f'city, "timestamp", ingestion_timestamp, {r(*S.MEASURES)}, '
               f"{', '.join(S.CALENDAR)}, target_aqi, target_day")
FRAME_OUT = f'{READING_OUT}, {r(*WINDOW_NAMES)}, {r(*S.TARGETS)}'
