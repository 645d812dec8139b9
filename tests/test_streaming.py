import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from stationcast import schema as S
from stationcast.sources import tables
from stationcast.streaming import ingest
from tests.test_payloads import NOW, air, feed, land, weather


def land_events(spark, folder, rows):
    spark.createDataFrame(rows, "city string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(folder)


def event_stream(spark, folder):
    return spark.readStream.schema("city string, ts timestamp, value double").parquet(folder)


def at(hour, minute=0, day=1):
    return dt.datetime(2024, 1, day, hour, minute)


def test_feed_stream(spark, tmp_path):
    landing = land(tmp_path, "feed", [feed(), {"status": "error", "data": "x"}])
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ckpt")
    stream = ingest.stream_feed(spark, landing, F.lit(NOW))
    ingest.run_to_files(stream, out, checkpoint)
    ingest.run_to_files(ingest.stream_feed(spark, landing, F.lit(NOW)), out, checkpoint)  # nothing new has landed
    rows = spark.read.schema(stream.schema).parquet(out).collect()
    assert [(r["city"], r["aqi"]) for r in rows] == [("Harbour", 93.0)]


def test_hourly_aggregate_closes_hours_and_drops_late_rows(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ckpt"))

    def run():
        ingest.run_to_files(ingest.stream_hourly(event_stream(spark, folder)), out, checkpoint)

    land_events(spark, folder, [("a", at(1), 1.0), ("a", at(1, 30), 3.0), ("a", at(6), 5.0)])
    run()
    land_events(spark, folder, [("a", at(1, 45), 100.0), ("a", at(12), 7.0)])  # 01:45 is late by then
    run()
    rows = spark.read.parquet(out).orderBy(S.TIME).collect()
    assert [(r[S.TIME], r["aqi"], r["n_events"]) for r in rows] == [(at(1), 2.0, 2), (at(6), 5.0, 1)]


def test_dedup_across_batches(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for batch in ([("a", at(1), 1.0), ("a", at(1), 1.0), ("b", at(1), 2.0)], [("a", at(1), 9.0), ("a", at(2), 3.0)]):
        land_events(spark, folder, batch)
        rows = event_stream(spark, folder).withColumnRenamed("ts", S.TIME)
        ingest.run_to_files(ingest.stream_dedup(rows), out, checkpoint)
    got = sorted((r["city"], r[S.TIME].hour, r["value"]) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1, 1.0), ("a", 2, 3.0), ("b", 1, 2.0)]


def test_upsert_stream_can_run_again(spark, tmp_path):
    root = str(tmp_path / "store")
    a, w = land(tmp_path, "air", [air("x"), air("y")]), land(tmp_path, "weather", [weather("x")])
    # A new checkpoint makes the second run process every payload again.
    for run in (1, 2):
        stream = ingest.stream_readings(spark, a, w)
        query = ingest.stream_upsert(stream, root, str(tmp_path / f"ckpt{run}"), available_now=True)
        query.awaitTermination()
        assert query.exception() is None
        assert tables.read_features(spark, root).count() == 2
    latest = tables.read_latest(spark, root).collect()
    assert [(r["city"], r[S.TIME]) for r in latest] == [("x", dt.datetime(2024, 5, 1, 1))]


def test_stations_that_land_later_lose_no_hours(spark, tmp_path):
    root, checkpoint = str(tmp_path / "store"), str(tmp_path / "ckpt")
    for station in ("x", "y", "z"):
        a = land(tmp_path, "air", [air(station)], f"{station}.json")
        w = land(tmp_path, "weather", [weather(station)], f"{station}.json")
        ingest.stream_upsert(ingest.stream_readings(spark, a, w), root, checkpoint, available_now=True).awaitTermination()
    counts = {r["city"]: r["count"] for r in tables.read_features(spark, root).groupBy("city").count().collect()}
    assert counts == {"x": counts["x"], "y": counts["x"], "z": counts["x"]} and counts["x"] > 0


def land_at(tmp_path, side, records, file, day):
    """A landed file with a modification time some days after the first of May 2024."""
    folder = land(tmp_path, side, records, file)
    stamp = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc).timestamp() + day * 86400
    os.utime(os.path.join(folder, file), (stamp, stamp))
    return folder


MODIFIED = "_metadata.file_modification_time"


def ingest_landed(spark, tmp_path, root, mode="keep"):
    pairs = ingest.stream_pairs(spark, str(tmp_path / "air"), str(tmp_path / "weather"), landed=F.col(MODIFIED))
    query = ingest.stream_ingest(pairs, root, str(tmp_path / "ckpt"), available_now=True, mode=mode)
    query.awaitTermination()


def held(spark, root):
    return sorted((r["city"], "air" if r["air"] else "weather") for r in ingest.read_quarantine(spark, root).select(
        "city", "air", "weather").collect())


def accepted(spark, root):
    return sorted({r["city"] for r in tables.read_features(spark, root).select("city").collect()})


def test_partners_that_land_days_apart_are_not_lost(spark, tmp_path):
    root = str(tmp_path / "store")
    hours = payload_hours(spark, tmp_path)
    # x pairs at once; y waits for its weather, z for its air; w never gets its air.
    land_at(tmp_path, "air", [air("x"), air("y")], "1.json", 0)
    land_at(tmp_path, "weather", [weather("x"), weather("z"), weather("w")], "1.json", 0)
    ingest_landed(spark, tmp_path, root)
    assert accepted(spark, root) == ["x"] and held(spark, root) == []
    land_at(tmp_path, "air", [air("p")], "2.json", 10)
    land_at(tmp_path, "weather", [weather("p")], "2.json", 10)
    ingest_landed(spark, tmp_path, root)
    assert accepted(spark, root) == ["p", "x"]
    assert held(spark, root) == sorted([("y", "air"), ("z", "weather"), ("w", "weather")] * hours)
    land_at(tmp_path, "air", [air("z"), air("q")], "3.json", 20)
    land_at(tmp_path, "weather", [weather("y"), weather("q")], "3.json", 20)
    ingest_landed(spark, tmp_path, root)
    for k in (4, 5):  # later landings let the late partners leave the join
        for side, make in (("air", air), ("weather", weather)):
            land_at(tmp_path, side, [make(f"r{k}")], f"{k}.json", 10 * k)
        ingest_landed(spark, tmp_path, root)
    assert accepted(spark, root) == ["p", "q", "r4", "r5", "x", "y", "z"]
    assert held(spark, root) == [("w", "weather")] * hours
    # Every hour that landed is in a reading or in quarantine.
    assert 15 * hours == 2 * tables.read_features(spark, root).count() + len(held(spark, root))


def payload_hours(spark, tmp_path):
    from stationcast.sources import payloads
    folder = land(tmp_path, "one", [air("x")])
    return payloads.read_hourly_air(spark, folder).count()


def test_a_backlog_meets_whatever_its_age(spark, tmp_path):
    """By reading time, files that lie there together land together."""
    root = str(tmp_path / "store")
    land_at(tmp_path, "air", [air("x")], "1.json", 0)
    land_at(tmp_path, "weather", [weather("x")], "1.json", 300)
    pairs = ingest.stream_pairs(spark, str(tmp_path / "air"), str(tmp_path / "weather"))
    ingest.stream_ingest(pairs, root, str(tmp_path / "ckpt"), available_now=True).awaitTermination()
    assert accepted(spark, root) == ["x"]


def lone(spark, *rows):
    """Pairs of one hour with one side or both: (city, has air, has weather)."""
    at_ = dt.datetime(2024, 5, 1, 3)
    air_side, weather_side = tuple([1.0] * 7 + [at_]), tuple([2.0] * 4 + [at_])
    return spark.createDataFrame([(c, at_ if c != "no time" else None, air_side if a else None, weather_side if w else None)
                                  for c, a, w in rows], ingest.PAIR)


@pytest.mark.parametrize("mode", ["keep", "replace"])
@pytest.mark.parametrize("killed", ["before", "between", "after"])
def test_a_killed_batch_runs_again(spark, tmp_path, monkeypatch, mode, killed):
    root = str(tmp_path)
    ingest.ingest_pairs(lone(spark, ("a", True, False), ("b", False, True), ("c", True, False)), root, mode=mode, batch=("s", 0))
    assert held(spark, root) == [("a", "air"), ("b", "weather"), ("c", "air")]
    batch = lone(spark, ("a", False, True), ("b", True, False), ("d", True, True), ("no time", True, False))
    where = {"before": (ingest, "upsert_features"), "between": (ingest, "_stored_hours"), "after": None}[killed]
    if where:
        with monkeypatch.context() as m:
            m.setattr(*where, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
            with pytest.raises(RuntimeError):
                ingest.ingest_pairs(batch, root, mode=mode, batch=("s", 1))
    for _ in range(2):
        ingest.ingest_pairs(batch, root, mode=mode, batch=("s", 1))
        assert accepted(spark, root) == ["a", "b", "d"] and tables.read_features(spark, root).count() == 3
        assert held(spark, root) == [("c", "air"), ("no time", "air")]
    # A side that lands again after its pair was stored is not held.
    ingest.ingest_pairs(lone(spark, ("a", True, False)), root, mode=mode, batch=("s", 2))
    assert held(spark, root) == [("c", "air"), ("no time", "air")]


def test_a_stream_killed_after_its_write_repeats_nothing(spark, tmp_path, monkeypatch):
    """In mode replace the second run of batch 0 must not bring old values back."""
    folder, root, checkpoint = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "ckpt")
    refresh = tables.refresh_latest

    def run():
        rows = event_stream(spark, folder).select("city", F.col("ts").alias(S.TIME), F.col("value").alias("aqi"))
        query = ingest.stream_upsert(rows, root, checkpoint, available_now=True, mode="replace")
        query.awaitTermination()
    land_events(spark, folder, [("a", at(1), 1.0), ("b", at(1), 2.0)])
    monkeypatch.setattr(tables, "refresh_latest", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(Exception, match="killed"):
        run()
    # A correction arrives by another way before the stream comes back.
    monkeypatch.setattr(tables, "refresh_latest", refresh)
    fix = spark.createDataFrame([("a", at(1), 50.0)], f"city string, {S.TIME} timestamp, aqi double")
    tables.upsert_features(fix, root, mode="replace")
    run()
    got = sorted((r["city"], r["aqi"]) for r in tables.read_features(spark, root).collect())
    assert got == [("a", 50.0), ("b", 2.0)]
    assert tables.read_latest(spark, root).count() == 2


def test_rows_that_are_late_or_repeated_are_set_aside(spark, tmp_path, monkeypatch):
    root, folder, checkpoint = (str(tmp_path / n) for n in ("store", "in", "ckpt"))
    schema = spark.createDataFrame([], f"city string, {S.TIME} timestamp, value double").schema

    def run():
        rows = event_stream(spark, folder).withColumnRenamed("ts", S.TIME)
        query = ingest.stream_on_time(rows, root, checkpoint, available_now=True)
        query.awaitTermination()

    land_events(spark, folder, [("a", at(1), None), ("a", at(1), 1.0), ("a", at(6), 5.0), (None, at(6), 1.0), ("a", None, 2.0)])
    run()
    # 04:00 is the watermark by now. The batch fails after its side output and runs again.
    land_events(spark, folder, [("a", at(4), 7.0), ("a", at(5), 8.0), ("a", at(6), 9.0), ("b", at(2), 3.0), ("b", at(9), 4.0)])
    real = ingest.M.committed

    def fails(spark, path, *rest):
        if path.endswith(ingest.KEPT):
            raise OSError("gone")
        return real(spark, path, *rest)
    with monkeypatch.context() as m:
        m.setattr(ingest.M, "committed", fails)
        with pytest.raises(Exception):  # noqa: B017
            run()
    run()
    kept = {(r["city"], r[S.TIME].hour, r["value"]) for r in ingest.read_kept(spark, root, schema).collect()}
    assert kept == {("a", 1, 1.0), ("a", 6, 5.0), ("a", 5, 8.0), ("b", 9, 4.0)}
    aside = sorted((r["reason"], r["value"] or 0.0) for r in ingest.read_aside(spark, root, schema).collect())
    assert aside == [("duplicate", 0.0), ("duplicate", 9.0), ("late", 3.0), ("late", 7.0), ("no key", 1.0), ("no key", 2.0)]
