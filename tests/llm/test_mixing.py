"""The mix against its SQL and against a plain water-filling."""

import random

import duckdb
import pytest

from stationcast.llm import mixing as M


def planted(seed, sources=9, docs=400, hot=True):
    rng = random.Random(seed)
    names = [None, "", "é", "z", "A", "a", *(f"s{i}" for i in range(sources))]
    rows = []
    for i in range(docs):
        source = "a" if hot and rng.random() < 0.3 else rng.choice(names)
        text = rng.choice([None, "", " \n"]) if rng.random() < 0.1 else " ".join(["w"] * rng.randrange(1, 60))
        rows.append((i, text, source))
    rows += [(None, "no id", "z"), (None, "no id too", "z"), (3, rows[3][1], rows[3][2]), (3, "other text", "Q"), (8, None, "empty")]
    return rows


def brute_targets(sizes):
    """source -> target, sharing the excess again until none is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: M.WEIGHTS[i % len(M.WEIGHTS)] for i, s in enumerate(order)}
    target, total, open_ = dict.fromkeys(order, 0.0), sum(sizes.values()), set(order)
    left = float(total)
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        for s in open_:
            target[s] += weight[s] * share
        left = sum(max(0.0, target[s] - 3 * sizes[s]) for s in order)
        for s in order:
            if target[s] >= 3 * sizes[s]:
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def write(spark, tmp_path, rows):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.mode("overwrite").parquet(path)
    return path


def by_sql(path):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    return sorted(db.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({M.OP11_SQL})").fetchall(), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_query_equals_sql_and_water_filling(spark, tmp_path, seed):
    rows = planted(seed, sources=3 * seed, hot=seed != 2)
    path = write(spark, tmp_path, rows)
    got = sorted((tuple(r) for r in M.op11(spark, str(tmp_path)).collect()), key=str)
    assert got == by_sql(path)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    targets = brute_targets(sizes)
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    for r in M.rated(spark.read.parquet(path)).collect():
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]], abs=1e-6)
        rate = targets[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert int(rate - 1e-9) <= r["copies"] <= min(3, int(rate + 1e-9) + 1)


def test_many_sources_are_joined_without_a_broadcast(spark, tmp_path, monkeypatch):
    rows = planted(5)
    path = write(spark, tmp_path, rows)
    monkeypatch.setattr(M, "MOST_BROADCAST", 0)
    monkeypatch.setattr(M, "HOT", 5)
    got = sorted((tuple(r) for r in M.op11(spark, str(tmp_path)).collect()), key=str)
    assert got == by_sql(path) and len(got) == len(rows)


def test_taken_words_come_near_the_targets(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randrange(1, 80), f"s{i % 7 if i % 3 else 0}") for i in range(2_000)]
    path = write(spark, tmp_path, rows)
    sums = (M.rated(spark.read.parquet(path)).selectExpr("source", "target", "size * copies as taken")
            .groupBy("source", "target").sum("taken").collect())
    for r in sums:
        assert r["sum(taken)"] == pytest.approx(r["target"], rel=0.02)


def test_the_mix_repeats_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "x", 9), (2, "a", "y", 9)], "doc_id long, text string, source string, size int")
    # Shares of 4 words: 5/7 of them are 20/7 for x (below 9), 8/7 for y (below 3).
    mixed = M.mix(docs).groupBy("doc_id").count().collect()
    copies = {r["doc_id"]: r["copies"] for r in M.rated(docs).collect()}
    assert {r["doc_id"]: r["count"] for r in mixed} == {d: c for d, c in copies.items() if c}
    assert set(M.mix(docs).columns) == {"doc_id", "text", "source", "size", "copy"}


def test_empty_and_wordless_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.rated(docs).count() == 0
    rows = M.rated(spark.createDataFrame([(1, None, "x"), (2, " ", None)], docs.schema)).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in rows] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        M.rated(docs, weights=())
