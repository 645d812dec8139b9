"""Column names, schemas and fixed values of the reading table and the landed payloads."""

from __future__ import annotations

from pyspark.sql import types as T

STATION = "city"
TIME = "ingestion_timestamp"
KEY = [STATION, TIME]

POLLUTANTS = ["aqi", "pm25", "pm10", "o3", "no2", "so2", "co"]
WEATHER = ["temperature", "humidity", "pressure", "wind_speed"]
MEASURES = POLLUTANTS + WEATHER
CALENDAR = ["hour", "day", "month", "day_of_week"]
NUMERIC = MEASURES + ["target_aqi"]
HORIZONS = [1, 2, 3]
TARGETS = ["target_day1", "target_day2", "target_day3"]
PREDICTIONS = ["pred_day1", "pred_day2", "pred_day3"]

READING = T.StructType(
    [T.StructField(STATION, T.StringType()), T.StructField("timestamp", T.TimestampType()),
     T.StructField(TIME, T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in MEASURES]
    + [T.StructField(c, T.LongType()) for c in CALENDAR]
    + [T.StructField("target_aqi", T.DoubleType()), T.StructField("target_day", T.StringType())]
)

# --- column lists (fixed values) ----------------------------------------------------------

# Never model inputs: identity, time, the current reading of the target and the targets.
NOT_FEATURES = {STATION, "timestamp", TIME, "aqi", "target_aqi", "target_day", "target", *TARGETS}
# Left out of the correlation matrix.
NOT_CORRELATED = ["target_aqi", "hour", "day", "month", "day_of_week"]

# --- payload formats (fixed values) -------------------------------------------------------

# Station feed: status decides whether data is a reading object or an error text.
ENVELOPE = T.StructType([T.StructField("status", T.StringType()), T.StructField("data", T.StringType())])

# Short sensor keys inside the feed's iaqi object -> reading columns.
FEED_KEYS = {
    "pm25": "pm25", "pm10": "pm10", "o3": "o3", "no2": "no2", "so2": "so2", "co": "co",
    "t": "temperature", "h": "humidity", "p": "pressure", "w": "wind_speed",
}

_SENSOR = T.StructType([T.StructField("v", T.StringType())])
_DAY_FORECAST = T.StructType([T.StructField("avg", T.StringType()), T.StructField("day", T.StringType())])
# aqi and v stay text: a station that does not measure something sends a placeholder such as "-".
FEED = T.StructType([
    T.StructField("aqi", T.StringType()),
    T.StructField("city", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("time", T.StructType([T.StructField("s", T.StringType())])),
    T.StructField("iaqi", T.StructType([T.StructField(k, _SENSOR) for k in FEED_KEYS])),
    T.StructField("forecast", T.StructType([T.StructField(
        "daily", T.StructType([T.StructField("pm25", T.ArrayType(_DAY_FORECAST))]))])),
])

# Hourly payload arrays -> reading columns.
AIR_ARRAYS = {
    "us_aqi": "aqi", "pm2_5": "pm25", "pm10": "pm10", "ozone": "o3", "nitrogen_dioxide": "no2",
    "sulphur_dioxide": "so2", "carbon_monoxide": "co",
}
WEATHER_ARRAYS = {
    "temperature_2m": "temperature", "relative_humidity_2m": "humidity",
    "surface_pressure": "pressure", "wind_speed_10m": "wind_speed",
}


def hourly_schema(arrays: dict[str, str]) -> T.StructType:
    """A payload of parallel arrays under ``hourly``, one payload per station and fetch."""
    fields = [T.StructField("time", T.ArrayType(T.StringType()))]
    # Text, so that a placeholder among the values costs this one value and not the payload.
    fields += [T.StructField(a, T.ArrayType(T.StringType())) for a in arrays]
    return T.StructType([T.StructField(STATION, T.StringType()),
                         T.StructField("hourly", T.StructType(fields))])


PAST_PREDICTION = T.StructType([
    T.StructField("date", T.StringType()), T.StructField("predicted_aqi", T.LongType()),
    T.StructField("label", T.StringType()), T.StructField("css_class", T.StringType()),
    T.StructField("pill_class", T.StringType()),
])
CONDITIONS = ["aqi", "pm25", "temperature", "humidity", "wind_speed"]
LAST_PREDICTION = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("current_conditions", T.StructType([T.StructField(c, T.DoubleType()) for c in CONDITIONS])),
    T.StructField("predictions", T.ArrayType(T.StructType([
        T.StructField("day_label", T.StringType()), T.StructField("target_date", T.StringType()),
        T.StructField("pred_aqi", T.LongType()), T.StructField("label", T.StringType()),
        T.StructField("css_class", T.StringType()), T.StructField("pill_class", T.StringType()),
        T.StructField("advice", T.StringType()),
    ]))),
    T.StructField("model_name", T.StringType()),
])

MODEL_RUN = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("version", T.LongType()),
    T.StructField("description", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("model_path", T.StringType()),
])

# --- index categories (fixed values): inclusive upper bound, label, style keys, advice -----

CATEGORIES = [
    (50, "Good", "aqi-good", "pill-good", "Air quality is satisfactory."),
    (100, "Moderate", "aqi-moderate", "pill-moderate", "Acceptable for most people."),
    (150, "Unhealthy for Sensitive Groups", "aqi-sensitive", "pill-sensitive",
     "Sensitive groups should limit outdoor exposure."),
    (200, "Unhealthy", "aqi-unhealthy", "pill-unhealthy", "Everyone may experience health effects."),
    (300, "Very Unhealthy", "aqi-very-unhealthy", "pill-very-unhealthy",
     "Health alert – avoid prolonged outdoor activity."),
    (None, "Hazardous", "aqi-hazardous", "pill-hazardous", "Emergency conditions – stay indoors."),
]

# --- display names (fixed values) ----------------------------------------------------------

FEATURE_LABELS = {
    "pm25": "PM2.5", "pm10": "PM10", "o3": "O3", "no2": "NO2", "so2": "SO2", "co": "CO",
    "temperature": "Temperature", "humidity": "Humidity", "pressure": "Pressure",
    "wind_speed": "Wind Speed", "hour": "Hour of Day", "day": "Day of Month", "month": "Month",
    "day_of_week": "Day of Week", "aqi_lag_24h": "AQI Lag (24h)", "aqi_lag_48h": "AQI Lag (48h)",
    "aqi_lag_72h": "AQI Lag (72h)", "aqi_rolling_mean_24h": "AQI Roll Mean (24h)",
    "aqi_rolling_std_24h": "AQI Roll Std (24h)", "aqi_rolling_mean_72h": "AQI Roll Mean (72h)",
    "aqi_diff_24h": "AQI Change (24h)", "pm25_rolling_mean_24h": "PM2.5 Roll Mean (24h)",
    "wind_speed_rolling_mean_24h": "Wind Speed Roll Mean (24h)",
}
MATRIX_LABELS = {
    "pm25": "PM2.5", "pm10": "PM10", "o3": "O3", "no2": "NO2", "so2": "SO2", "co": "CO",
    "aqi": "AQI (Base)", "temperature": "Temperature", "humidity": "Humidity",
    "pressure": "Pressure", "wind_speed": "Wind Speed",
}
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
HORIZON_LABELS = ["Tomorrow", "Day 2", "Day 3"]
NOT_AVAILABLE = "Not available (retrain with multi-output model)"
# Estimator class -> name shown; anything else keeps its class name.
MODEL_LABELS = {
    "XGBRegressor": "XGBoost", "RandomForestRegressor": "Random Forest",
    "GradientBoostingRegressor": "Gradient Boosting", "LinearRegression": "Linear Regression",
}
MULTI_OUTPUT_CLASS = "MultiOutputRegressor"
