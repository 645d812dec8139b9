import datetime as dt

import pytest
from pyspark.sql import functions as F

from stationcast import schema as S
from stationcast.functions import cleaning as C
from stationcast.functions import display as D


def column(spark, values, type_, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v")).alias("out")).collect()]


def test_to_number(spark):
    got = column(spark, ["1.5", "-", "", None, "NaN", " 7 ", "1e3", "12abc"], "string", C.to_number)
    assert got == [1.5, None, None, None, None, 7.0, 1000.0, None]


def test_parse_timestamp(spark):
    got = column(spark, ["2024-01-01T05:00", "2024-01-01 05:00:01", "nope", None], "string", C.parse_timestamp)
    assert got == [dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 1, 5, 0, 1), None, None]


def test_time_features_start_the_week_on_monday(spark):
    rows = [(dt.datetime(2024, 1, d, 23, 59),) for d in range(1, 8)]  # Monday to Sunday
    got = C.time_features(spark.createDataFrame(rows, "timestamp timestamp")).orderBy("timestamp").collect()
    assert [r["day_of_week"] for r in got] == list(range(7))
    assert (got[0]["hour"], got[0]["day"], got[0]["month"]) == (23, 1, 1)


def test_rows_without_time_are_set_aside(spark):
    df = spark.createDataFrame([(None,), (dt.datetime(2024, 1, 1),)], "timestamp timestamp")
    assert C.with_time(df).count() == 1
    assert C.without_time(df).first()["reason"] == "no timestamp"


def test_zero_fill_leaves_text(spark):
    df = spark.createDataFrame([(None, None)], "aqi double, target_day string")
    assert tuple(C.zero_fill(df).first()) == (0.0, None)


def test_filters(spark):
    df = spark.createDataFrame([("a", 1.0), ("a b", 0.0), ("a", None)], "city string, temperature double")
    assert C.only_city(df, "a").count() == 2
    assert C.only_city(df.drop("city"), "a").count() == 3
    assert C.drop_zero_weather(df).count() == 1


def test_placeholder_targets_cross_a_month(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 2, 28, 12),)], "timestamp timestamp")
    assert tuple(C.placeholder_targets(df).first())[1:] == (0.0, "2024-03-02")


def test_stamp_ingestion_cuts_to_the_second(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 1, 2, 3, 999999),)], "t timestamp")
    assert C.stamp_ingestion(df, F.col("t")).first()[S.TIME] == dt.datetime(2024, 1, 1, 1, 2, 3)
    assert C.stamp_ingestion(df).first()[S.TIME].microsecond == 0


def test_feature_columns_are_the_23(spark):
    from stationcast.operators.series import features_and_fixed_targets
    frame = features_and_fixed_targets(spark.createDataFrame([], S.READING))
    assert C.feature_columns(frame) == list(S.FEATURE_LABELS)
    assert len(C.feature_columns(frame)) == 23
    assert C.numeric_columns(spark.createDataFrame([], S.READING)) == S.MEASURES


def test_align_features(spark):
    df = spark.createDataFrame([("a", 1.0, None, 3)], "city string, x double, y double, aqi int")
    assert C.align_features(df, ["y", "gone", "x"]).columns == ["y", "gone", "x"]
    assert tuple(C.align_features(df, ["y", "gone", "x"]).first()) == (None, 0.0, 1.0)
    assert C.align_features(df, None).columns == ["x", "y"]


def test_categories_include_their_upper_bound(spark):
    got = column(spark, [0, 50, 51, 100, 101, 150, 151, 200, 201, 300, 301, None], "int",
                 lambda v: D.aqi_category(v)["label"])
    names = [c[1] for c in S.CATEGORIES]
    assert got == [names[0]] * 2 + [n for n in names[1:5] for _ in range(2)] + [names[5], None]
    assert names == ["Good", "Moderate", "Unhealthy for Sensitive Groups", "Unhealthy", "Very Unhealthy", "Hazardous"]


def test_finalize_rounds_halves_to_even(spark):
    got = column(spark, [0.5, 1.5, 2.5, -3.0, 80.49, 80.51, None], "double", D.finalize_prediction)
    assert got == [0, 2, 2, 0, 80, 81, None]


def test_horizon_labels(spark):
    dates = column(spark, [1, 2, 3], "int", lambda h: D.horizon_date(F.lit("2026-06-06").cast("date"), h))
    assert dates == ["Sun, Jun 07", "Mon, Jun 08", "Tue, Jun 09"]
    assert column(spark, [1, 2, 3], "int", D.horizon_label) == ["Tomorrow", "Day 2", "Day 3"]


def test_condition_cards(spark):
    df = spark.createDataFrame([("a", 2.5, 21.25, None, 81.5)], "city string, aqi double, pm25 double, temperature double, humidity double")
    got = {r["card"]: r["value"] for r in D.condition_cards(df).collect()}
    assert got == {"AQI Now": "2", "PM 2.5": "21.2", "Temperature": "N/A", "Humidity": "82%", "Wind Speed": "0.0 m/s"}


@pytest.mark.parametrize("model,inner,want", [
    ("XGBRegressor", None, "XGBoost"), ("RandomForestRegressor", None, "Random Forest"),
    ("MultiOutputRegressor", "XGBRegressor", "Multi-Output XGBRegressor"),
    ("MultiOutputRegressor", None, "Multi-Output Ensemble"), ("SVR", None, "SVR")])
def test_model_display_name(spark, model, inner, want):
    df = spark.createDataFrame([(model, inner)], "m string, i string")
    assert df.select(D.model_display_name(F.col("m"), F.col("i"))).first()[0] == want


def test_display_label_keeps_unknown_names(spark):
    assert column(spark, ["pm25", "hour", "snow"], "string", D.display_label) == ["PM2.5", "Hour of Day", "snow"]
    assert column(spark, ["aqi"], "string", lambda v: D.display_label(v, S.MATRIX_LABELS)) == ["AQI (Base)"]
