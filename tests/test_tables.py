import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from stationcast import schema as S
from stationcast.functions.cleaning import conform, without_key
from stationcast.sources import tables


def readings(spark, *rows):
    """Rows of (city, day of January, hour, aqi)."""
    df = spark.createDataFrame([(c, dt.datetime(2024, 1, d, h), float(v)) for c, d, h, v in rows],
                               "city string, ingestion_timestamp timestamp, aqi double")
    return conform(df)


def stored(spark, root, version=tables.VERSION):
    return sorted((r["city"], r[S.TIME].day, r[S.TIME].hour, r["aqi"])
                  for r in tables.read_features(spark, root, version).collect())


def test_upsert_keeps_existing_rows(spark, tmp_path):
    root = str(tmp_path)
    tables.upsert_features(readings(spark, ("a", 1, 0, 1), ("a", 2, 0, 2)), root)
    tables.upsert_features(readings(spark, ("a", 2, 0, 99), ("a", 2, 1, 3), ("b", 3, 0, 4)), root)
    want = [("a", 1, 0, 1.0), ("a", 2, 0, 2.0), ("a", 2, 1, 3.0), ("b", 3, 0, 4.0)]
    assert stored(spark, root) == want
    tables.upsert_features(readings(spark, ("a", 2, 1, 77)), root)
    assert stored(spark, root) == want


def test_upsert_replace(spark, tmp_path):
    root = str(tmp_path)
    tables.upsert_features(readings(spark, ("a", 1, 0, 1), ("a", 2, 0, 2), ("a", 2, 5, 6), ("a", 3, 0, 3)), root)
    before = {p.name: p.stat().st_mtime_ns for p in tmp_path.rglob("event_date=2024-01-02/../event_date=2024-01-01/*")}
    tables.upsert_features(readings(spark, ("a", 2, 0, 20), ("b", 3, 0, 30)), root, mode="replace")
    assert stored(spark, root) == [("a", 1, 0, 1.0), ("a", 2, 0, 20.0), ("a", 2, 5, 6.0), ("a", 3, 0, 3.0), ("b", 3, 0, 30.0)]
    after = {p.name: p.stat().st_mtime_ns for p in tmp_path.rglob("event_date=2024-01-02/../event_date=2024-01-01/*")}
    assert before == after  # dates without new rows are not rewritten
    with pytest.raises(ValueError):
        tables.upsert_features(readings(spark, ("a", 1, 0, 1)), root, mode="other")


def test_upsert_of_nothing(spark, tmp_path):
    tables.upsert_features(readings(spark), str(tmp_path))
    assert not list(tmp_path.iterdir())


def test_copies_within_a_batch(spark, tmp_path):
    tables.upsert_features(readings(spark, ("a", 1, 0, 5), ("a", 1, 0, 4)), str(tmp_path))
    assert stored(spark, str(tmp_path)) == [("a", 1, 0, 4.0)]


def test_rows_without_a_key_are_set_aside(spark, tmp_path):
    batch = readings(spark, ("a", 1, 0, 1), (None, 1, 0, 2))
    for _ in range(2):
        tables.upsert_features(batch, str(tmp_path))
    assert stored(spark, str(tmp_path)) == [("a", 1, 0, 1.0)]
    assert [r["aqi"] for r in without_key(batch).collect()] == [2.0]


def test_versions_are_independent(spark, tmp_path):
    root = str(tmp_path)
    tables.upsert_features(readings(spark, ("a", 1, 0, 1)), root, version=6)
    tables.recreate_version(readings(spark, ("a", 1, 0, 2), ("a", 9, 0, 2)), root, 4)
    tables.recreate_version(readings(spark, ("b", 1, 0, 3)), root, 4)
    assert stored(spark, root, 4) == [("b", 1, 0, 3.0)]
    assert stored(spark, root, 6) == [("a", 1, 0, 1.0)]


def test_reads_prune_dates_and_push_the_station(spark, tmp_path):
    tables.upsert_features(readings(spark, ("a", 1, 0, 1), ("b", 2, 0, 2)), str(tmp_path))
    df = tables.read_features(spark, str(tmp_path)).where(F.col("city") == "a").select("city", "aqi")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(city,a)" in plan and "ReadSchema: struct<city:string,aqi:double>" in plan


def test_latest_snapshot_moves_forward_only(spark, tmp_path):
    root = str(tmp_path)
    for batch in ([("a", 2, 0, 2), ("b", 1, 0, 1)], [("a", 1, 0, 9), ("b", 3, 0, 3), ("c", 1, 0, 7)]):
        tables.refresh_latest(readings(spark, *batch), root)
    got = {(r["city"], r["aqi"]) for r in tables.read_latest(spark, root).collect()}
    assert got == {("a", 2.0), ("b", 3.0), ("c", 7.0)}
    (tmp_path / "aqi_features_latest" / "seq=9").mkdir()  # not finished
    for _ in range(3):
        tables.refresh_latest(readings(spark, ("d", 1, 0, 5)), root)
    assert tables.read_latest(spark, root).count() == 4
    assert len(list((tmp_path / "aqi_features_latest").glob("seq=*/_SUCCESS"))) == 3


def test_first_available_skips_missing_and_empty(spark, tmp_path):
    root = str(tmp_path)
    tables.overwrite_cache(readings(spark), f"{root}/empty")
    tables.overwrite_cache(readings(spark, ("a", 1, 0, 1)), f"{root}/cache")
    readers = [lambda: tables.read_features(spark, root), lambda: tables.read_latest(spark, root),
               lambda: tables.read_features_csv(spark, f"{root}/empty"),
               lambda: tables.read_features_csv(spark, f"{root}/cache")]
    assert tables.first_available(readers).first()["aqi"] == 1.0
    assert tables.first_available(readers[:3]) is None


def test_cache_format(spark, tmp_path):
    path = str(tmp_path / "cache")
    for value in (1, 2):
        tables.overwrite_cache(readings(spark, ("a", 1, 5, value)), path)
    text = "".join(p.read_text() for p in (tmp_path / "cache").glob("*.csv"))
    assert "2024-01-01 05:00:00" in text and text.startswith("city,timestamp,ingestion_timestamp,aqi")
    assert [r["aqi"] for r in tables.read_features_csv(spark, path).collect()] == [2.0]


def test_chunks(spark, tmp_path):
    df = spark.range(1300).coalesce(1)
    tables.write_chunked(df, str(tmp_path / "c"))
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "c")).groupBy(F.input_file_name()).count().collect()]
    assert sorted(sizes) == [300, 500, 500]


def test_feature_list_keeps_its_order(spark, tmp_path):
    path = str(tmp_path / "names")
    assert tables.read_feature_list(spark, path) is None
    tables.write_feature_list(spark, ["b", "a", "c"], path)
    assert tables.read_feature_list(spark, path) == ["b", "a", "c"]


def test_prediction_archives(spark, tmp_path):
    past = [{"date": "Mon, Jan 01", "predicted_aqi": 70 + i, "label": "Moderate", "css_class": "aqi-moderate",
             "pill_class": "pill-moderate"} for i in range(3)]
    (tmp_path / "past.json").write_text(json.dumps(past, indent=2))
    rows = tables.read_past_predictions(spark, str(tmp_path / "past.json")).collect()
    assert [r["predicted_aqi"] for r in rows] == [70, 71, 72]
    last = {"timestamp": "2024-01-01 00:00:00", "model_name": "m",
            "current_conditions": {"aqi": 89.0, "pm25": 1.0, "temperature": 2.0, "humidity": 3.0, "wind_speed": 4.0},
            "predictions": [{"day_label": d, "target_date": "x", "pred_aqi": 1, "label": "Good", "css_class": "c",
                             "pill_class": "p", "advice": "a"} for d in S.HORIZON_LABELS]}
    (tmp_path / "last.json").write_text(json.dumps(last, indent=2))
    rows = tables.read_last_prediction(spark, str(tmp_path / "last.json")).collect()
    assert [(r["day_label"], r["aqi"]) for r in rows] == [("Tomorrow", 89.0), ("Day 2", 89.0), ("Day 3", 89.0)]


def test_archive_replaces_a_run_date(spark, tmp_path):
    path = str(tmp_path / "archive")
    for date, value in (("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-02", 3)):
        tables.archive_predictions(spark.createDataFrame([(date, value)], "run_date string, pred_aqi int"), path)
    got = {(str(r["run_date"]), r["pred_aqi"]) for r in spark.read.parquet(path).collect()}
    assert got == {("2024-01-01", 1), ("2024-01-02", 3)}


def test_first_available_skips_a_broken_file(spark, tmp_path):
    (tmp_path / "bad.parquet").write_text("no parquet")
    good = readings(spark, ("a", 1, 0, 1))
    readers = [lambda: spark.read.schema(S.READING).parquet(str(tmp_path / "bad.parquet")), lambda: good]
    assert tables.first_available(readers).first()["aqi"] == 1.0


@pytest.mark.parametrize("mode, aqi", [("keep", 1.0), ("replace", 9.0)])
def test_the_snapshot_says_what_the_table_says(spark, tmp_path, mode, aqi):
    root = str(tmp_path)
    for value in (1, 9):
        tables.upsert_features(readings(spark, ("a", 1, 0, value)), root, mode=mode, refresh=True)
    assert [r["aqi"] for r in tables.read_features(spark, root).collect()] == [aqi]
    assert [r["aqi"] for r in tables.read_latest(spark, root).collect()] == [aqi]


def test_a_value_wins_over_a_missing_one(spark):
    from stationcast.operators.dedup import dedup_readings
    both = readings(spark, ("a", 1, 0, 5)).unionByName(readings(spark, ("a", 1, 0, 7)).withColumn("aqi", F.lit(None).cast("double")))
    assert [r["aqi"] for r in dedup_readings(both).collect()] == [5.0]
