"""Rewrites that readers do not see half of, and ledgers of batches."""

import threading

import pytest
from py4j.protocol import Py4JJavaError

from stationcast import schema as S
from stationcast.sources import manifest as M
from stationcast.sources import tables
from tests.test_tables import readings, stored


def values(df):
    return sorted((r["city"], r[S.TIME].day, r["aqi"]) for r in df.collect())


@pytest.mark.parametrize("rewrite", ["replace", "recreate"])
def test_an_open_reader_keeps_its_rows(spark, tmp_path, rewrite):
    root = str(tmp_path)
    tables.upsert_features(readings(spark, ("a", 1, 0, 1), ("a", 2, 0, 2)), root)
    opened = tables.read_features(spark, root)
    opened_lines = opened.toLocalIterator(prefetchPartitions=False)
    first = next(opened_lines)
    changed = readings(spark, ("a", 1, 0, 10), ("b", 5, 0, 50))
    if rewrite == "replace":
        tables.upsert_features(changed, root, mode="replace")
        want = [("a", 1, 10.0), ("a", 2, 2.0), ("b", 5, 50.0)]
    else:
        tables.recreate_version(changed, root, tables.VERSION)
        want = [("a", 1, 10.0), ("b", 5, 50.0)]
    # The reader began before the rewrite and goes on after it; running it again gives its own rows too.
    assert sorted([first["aqi"], *(r["aqi"] for r in opened_lines)]) == [1.0, 2.0]
    assert values(opened) == [("a", 1, 1.0), ("a", 2, 2.0)]
    assert values(tables.read_features(spark, root)) == want


def test_a_write_that_fails_shows_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    tables.upsert_features(readings(spark, ("a", 1, 0, 1)), root)
    monkeypatch.setattr(M, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    for write in (lambda: tables.upsert_features(readings(spark, ("a", 1, 0, 9), ("c", 3, 0, 3)), root, mode="replace"),
                  lambda: tables.recreate_version(readings(spark, ("d", 4, 0, 4)), root, tables.VERSION)):
        with pytest.raises(OSError):
            write()
    assert stored(spark, root) == [("a", 1, 0, 1.0)]


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    root, errors = str(tmp_path), []
    tables.upsert_features(readings(spark, ("z", 1, 0, 0)), root)

    def write(k):
        try:
            tables.upsert_features(readings(spark, *[(f"s{k}", 1, h, k) for h in range(3)], ("z", 1, 0, 100 + k)), root)
        except Exception as e:  # noqa: BLE001
            errors.append(e)
    writers = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not errors
    assert stored(spark, root) == sorted([("z", 1, 0, 0.0), *((f"s{k}", 1, h, float(k)) for k in range(3) for h in range(3))])


def test_a_stale_manifest_is_refused(spark, tmp_path):
    path = tables.table_path(str(tmp_path))
    tables.upsert_features(readings(spark, ("a", 1, 0, 1)), str(tmp_path))
    before = M.current(spark, path)
    tables.upsert_features(readings(spark, ("a", 2, 0, 2)), str(tmp_path))
    with pytest.raises(M.ConcurrentWrite):
        M.publish(spark, path, before)
    # A writer that died inside its manifest does not stop the next one.
    last = M.current(spark, path).number
    assert M.create_exclusive(spark, f"{path}/_manifests/{last + 1:012d}.json", '{"days": {')
    assert not M.create_exclusive(spark, f"{path}/_manifests/{last + 1:012d}.json")
    assert M.current(spark, path).number == last
    tables.upsert_features(readings(spark, ("a", 3, 0, 3)), str(tmp_path))
    assert M.current(spark, path).number == last + 2 and len(stored(spark, str(tmp_path))) == 3


@pytest.mark.parametrize("mode", ["keep", "replace"])
def test_a_batch_is_written_once(spark, tmp_path, mode):
    root = str(tmp_path)
    first, second = readings(spark, ("a", 1, 0, 1)), readings(spark, ("a", 1, 0, 2), ("b", 2, 0, 2))
    for number, batch in [(0, first), (0, first), (1, second), (1, second), (0, first)]:
        tables.upsert_features(batch, root, mode=mode, refresh=True, batch=("stream", number))
    want = [("a", 1, 0, 1.0 if mode == "keep" else 2.0), ("b", 2, 0, 2.0)]
    assert stored(spark, root) == want
    assert sorted((r["city"], r["aqi"]) for r in tables.read_latest(spark, root).collect()) == [(c, v) for c, _, _, v in want]
    # Another stream's batch 0 is another batch.
    tables.upsert_features(readings(spark, ("c", 3, 0, 3)), root, mode=mode, batch=("other", 0))
    assert len(stored(spark, root)) == 3
    assert {k: v[0] for k, v in M.current(spark, tables.table_path(root)).batches.items()} == {"stream": 1, "other": 0}


def test_the_snapshot_of_a_killed_batch_is_made_up_for(spark, tmp_path, monkeypatch):
    root, refresh = str(tmp_path), tables.refresh_latest
    monkeypatch.setattr(tables, "refresh_latest", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    batch = readings(spark, ("a", 1, 0, 1), ("a", 2, 0, 2))
    with pytest.raises(RuntimeError):
        tables.upsert_features(batch, root, mode="replace", refresh=True, batch=("stream", 0))
    monkeypatch.setattr(tables, "refresh_latest", refresh)
    assert len(stored(spark, root)) == 2
    tables.upsert_features(batch, root, mode="replace", refresh=True, batch=("stream", 0))
    assert len(stored(spark, root)) == 2 and [r["aqi"] for r in tables.read_latest(spark, root).collect()] == [2.0]


def test_crowded_days_are_merged(spark, tmp_path, monkeypatch):
    root, path = str(tmp_path), tables.table_path(str(tmp_path))
    monkeypatch.setattr(M.compactable, "__defaults__", (3,))
    for h in range(8):
        tables.upsert_features(readings(spark, ("a", 1, h, h)), root)
        assert max(len(c) for c in M.current(spark, path).days.values()) <= 4
    assert [r[2] for r in stored(spark, root)] == list(range(8))


def test_days_are_picked_and_unused_folders_dropped(spark, tmp_path):
    root, path = str(tmp_path), tables.table_path(str(tmp_path))
    tables.upsert_features(readings(spark, *[("a", d, 0, d) for d in range(1, 6)]), root)
    picked = tables.read_features(spark, root, days=["2024-01-02", "2024-01-04", "2030-01-01"])
    assert len(picked.inputFiles()) == 2 and values(picked) == [("a", 2, 2.0), ("a", 4, 4.0)]
    tables.upsert_features(readings(spark, ("a", 3, 0, 30)), root, mode="replace")
    assert M.drop_unused(spark, path) == []
    gone = M.drop_unused(spark, path, keep=1)
    assert len(gone) == 1 and gone[0].endswith("event_date=2024-01-03")
    assert values(tables.read_features(spark, root)) == [("a", d, 30.0 if d == 3 else float(d)) for d in range(1, 6)]


def test_versions_are_claimed_once(spark, tmp_path):
    root = str(tmp_path)
    runs = [tables.register_run(spark, root, "m", {"mae": 1.0}, "x", []) for _ in range(2)]
    # Another writer holds the next version, but has not appended its run yet.
    assert M.create_exclusive(spark, f"{root}/models/m/_claims/3")
    runs.append(tables.register_run(spark, root, "m", {"mae": 2.0}, "y", []))
    assert runs == [1, 2, 4]


def test_missing_tables_and_folders(spark, tmp_path):
    assert M.current(spark, str(tmp_path)) == M.Manifest()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_features(spark, str(tmp_path))
    assert M.read(spark, str(tmp_path), M.Manifest(), S.READING).count() == 0
    with pytest.raises(Py4JJavaError):
        M.create_exclusive(spark, "nosuchscheme://x/y")


def opened_days(df):
    return sorted({part for f in df.inputFiles() for part in f.split("/") if part.startswith("event_date=")})


def test_recent_rows_open_only_the_days_they_reach(spark, tmp_path):
    root = str(tmp_path)
    # One station with a row an hour, one with a row every fourth day, one silent since the second day.
    hourly = [("h", d, h, d) for d in range(1, 21) for h in range(24)]
    sparse = [("s", d, 5, d) for d in range(1, 21, 4)]
    tables.upsert_features(readings(spark, *hourly[::2], ("gone", 2, 0, 2)), root)
    tables.upsert_features(readings(spark, *hourly[1::2], *sparse), root)
    recent = tables.read_recent(spark, root, 3)
    assert opened_days(recent) == [f"event_date=2024-01-{d:02d}" for d in (2, 9, 13, 17, 20)]
    assert values(recent) == sorted([("gone", 2, 2.0), *(("s", d, float(d)) for d in (9, 13, 17)), *[("h", 20, 20.0)] * 24])
    # A replaced day counts with its new commit only, and a table written without counts is counted from its rows.
    tables.upsert_features(readings(spark, ("h", 20, 3, 7)), root, mode="replace")
    want = values(tables.read_recent(spark, root, 25))
    assert sum(v == ("h", 20, 20.0) for v in want) == 23 and ("h", 20, 7.0) in want
    assert sum(v[0] == "h" for v in want) == 48 and len(want) == 48 + 5 + 1
    path = tables.table_path(root)
    for folder in M._names(spark, f"{path}/counts")[:2]:
        M.remove(spark, f"{path}/counts/{folder}")
    assert values(tables.read_recent(spark, root, 25)) == want


def test_recent_rows_of_an_emptied_table(spark, tmp_path):
    root = str(tmp_path)
    tables.upsert_features(readings(spark, ("a", 1, 0, 1)), root)
    tables.recreate_version(readings(spark, ("a", 1, 0, 1)).limit(0), root, tables.VERSION)
    assert tables.read_recent(spark, root, 3).count() == 0
