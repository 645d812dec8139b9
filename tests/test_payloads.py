import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from stationcast import schema as S
from stationcast.plans import ingest
from stationcast.sources import payloads

NOW = dt.datetime(2024, 5, 1, 6, 30, 9)


def feed(days=4, **changes):
    data = {"aqi": 93, "city": {"name": "Harbour"}, "time": {"s": "2024-05-01 06:00:00"},
            "iaqi": {"pm25": {"v": 30.5}, "t": {"v": 21}, "h": {"v": "-"}},
            "forecast": {"daily": {"pm25": [{"avg": 10 + i, "day": f"2024-05-0{i + 1}", "max": 99} for i in range(days)]}}}
    data.update(changes)
    return {"status": "ok", "data": {k: v for k, v in data.items() if v is not None}}


def land(tmp_path, name, records, file="part.json"):
    folder = tmp_path / name
    folder.mkdir(exist_ok=True)
    (folder / file).write_text("\n".join(json.dumps(r) for r in records))
    return str(folder)


def test_feed_reading(spark, tmp_path):
    good, bad = payloads.read_station_feed(spark, land(tmp_path, "feed", [feed()]))
    row = ingest.feed_readings(good, F.lit(NOW)).first()
    assert bad.count() == 0
    assert (row["city"], row["timestamp"], row[S.TIME]) == ("Harbour", dt.datetime(2024, 5, 1, 6), NOW)
    assert (row["aqi"], row["pm25"], row["temperature"]) == (93.0, 30.5, 21.0)
    # Absent and placeholder values are missing, and missing values become 0.
    assert (row["humidity"], row["wind_speed"]) == (0.0, 0.0)
    raw = ingest.feed_readings(good, F.lit(NOW), fill=False).first()
    assert raw["humidity"] is None and raw["wind_speed"] is None
    assert (row["target_aqi"], row["target_day"], row["day_of_week"]) == (13.0, "2024-05-04", 2)


@pytest.mark.parametrize("days,want", [(0, (None, None)), (1, ("10", "2024-05-01")), (3, ("12", "2024-05-03")),
                                       (4, ("13", "2024-05-04")), (8, ("13", "2024-05-04"))])
def test_forecast_target_by_length(spark, tmp_path, days, want):
    good, _ = payloads.read_station_feed(spark, land(tmp_path, "feed", [feed(days)]))
    row = payloads.extract_forecast_target(good).first()
    assert (row["target_aqi"], row["target_day"]) == want


def test_feed_without_parts(spark, tmp_path):
    records = [feed(forecast=None, iaqi=None, aqi="-"), feed(time=None), feed(city=None)]
    good, _ = payloads.read_station_feed(spark, land(tmp_path, "feed", records))
    rows = ingest.feed_readings(good, F.lit(NOW), fill=False).collect()
    assert len(rows) == 2  # without a time there is no key
    assert {r["city"] for r in rows} == {"Harbour", None}
    assert [r["aqi"] for r in rows if r["city"]] == [None]


def test_rejected_envelopes_keep_their_reason(spark, tmp_path):
    records = [{"status": "error", "data": "Invalid key"}, {"status": "error"}, {"data": "x"}, feed()]
    good, bad = payloads.read_station_feed(spark, land(tmp_path, "feed", records))
    assert good.count() == 1
    assert sorted(r["reason"] for r in bad.collect()) == ["Invalid key", "Unknown API error", "x"]


def air(city="a", times=("2024-05-01T00:00", "2024-05-01T01:00"), **arrays):
    n = len(times)
    hourly = {"time": list(times), **{k: [float(i) for i in range(n)] for k in S.AIR_ARRAYS}}
    hourly.update(arrays)
    return {"city": city, "hourly": hourly, "latitude": 1.0}


def weather(city="a", times=("2024-05-01T00:00", "2024-05-01T01:00"), **arrays):
    n = len(times)
    hourly = {"time": list(times), **{k: [5.0] * n for k in S.WEATHER_ARRAYS}}
    hourly.update(arrays)
    return {"city": city, "hourly": hourly}


def test_hourly_air(spark, tmp_path):
    path = land(tmp_path, "air", [air(carbon_monoxide=[250.0, None], us_aqi=[40, None])])
    rows = payloads.read_hourly_air(spark, path).orderBy("time").collect()
    assert [r["co"] for r in rows] == [0.25, None]
    assert [r["aqi"] for r in rows] == [40.0, None]
    assert rows[1]["time"] == dt.datetime(2024, 5, 1, 1)


def test_uneven_arrays_reject_the_payload(spark, tmp_path):
    path = land(tmp_path, "air", [air("a"), air("b", ozone=[1.0]), {"city": "c"}])
    landed = spark.read.schema(S.hourly_schema(S.AIR_ARRAYS)).json(path)
    assert {r["city"] for r in payloads.air_rows(landed).collect()} == {"a"}
    assert {r["city"] for r in payloads.uneven_payloads(landed, S.AIR_ARRAYS).collect()} == {"b", "c"}


def test_backfill(spark, tmp_path):
    times = ("2024-05-01T00:00", "2024-05-01T01:00", "2024-05-01T02:00")
    a = payloads.read_hourly_air(spark, land(tmp_path, "air", [air(times=times, us_aqi=[10.0, None, 30.0])]))
    w = payloads.read_hourly_weather(spark, land(tmp_path, "weather", [weather(times=times[:2])]))
    rows = ingest.backfill_readings(a, w).orderBy(S.TIME).collect()
    assert [r["aqi"] for r in rows] == [10.0, 0.0]  # the third hour has no weather
    assert rows[0][S.TIME] == rows[0]["timestamp"] and rows[0]["target_day"] == "2024-05-04"
    assert ingest.backfill_readings(a, w, need_aqi=True).count() == 1
    assert ingest.backfill_readings(a, w).schema.names == S.READING.names


def test_hourly_run(spark, tmp_path):
    a = payloads.read_hourly_air(spark, land(tmp_path, "air", [air()]))
    w = payloads.read_hourly_weather(spark, land(tmp_path, "weather", [weather()]))
    requests = spark.createDataFrame([("a", dt.datetime(2024, 5, 1, 0, 45, 3)), ("zz", NOW)],
                                     "city string, requested_at timestamp")
    rows = ingest.hourly_readings(a, w, requests).collect()
    assert len(rows) == 1
    assert rows[0]["timestamp"] == dt.datetime(2024, 5, 1)
    assert rows[0][S.TIME] == dt.datetime(2024, 5, 1, 0, 45, 3)


def test_a_placeholder_costs_one_value(spark, tmp_path):
    path = land(tmp_path, "air", [air("a", ozone=["-", 2.0])])
    rows = sorted(payloads.read_hourly_air(spark, path).collect(), key=lambda r: r["time"])
    assert [(r["o3"], r["pm25"]) for r in rows] == [(None, 0.0), (2.0, 1.0)]


def test_an_accepted_status_without_an_object_is_rejected(spark, tmp_path):
    good, bad = payloads.read_station_feed(spark, land(tmp_path, "feed", [feed(), {"status": "ok", "data": "soon"}]))
    assert good.count() == 1
    assert [r["reason"] for r in bad.collect()] == ["data is no object"]
