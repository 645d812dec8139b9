"""Histogram trees against plain numpy ones."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import DefaultParamsReader

from stationcast.plans import trees as T

TARGETS, PREDICTIONS = ["t1", "t2", "t3"], ["p1", "p2", "p3"]


def planted(n=600, features=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, features)).astype(float)
    y = np.stack([2.0 * (x[:, 0] > 4) + x[:, 1] * 0.3, -x[:, 2] * (x[:, 3] > 6), x[:, 4] ** 2 * 0.1], axis=1)
    return x, y + rng.normal(0, 0.05, y.shape)


def frame(spark, x, y, parts=3):
    rows = [(i, Vectors.dense(a), *map(float, b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["id", "features", *TARGETS]).repartition(parts)


def brute_tree(x, r, w, depth, penalty, columns, min_weight=1.0):
    """Nested (feature, value, left, right) or a leaf's values; every value of the data is a candidate cut."""
    def score(s, n):
        return (s ** 2).sum() / (n + penalty)
    total, n = (w[:, None] * r).sum(axis=0), w.sum()
    leaf = total / (n + penalty)
    if depth == 0:
        return leaf
    best = (1e-10 * (1 + abs(score(total, n))), None)
    for f in np.flatnonzero(columns):
        for v in np.unique(x[:, f]):
            low = x[:, f] <= v
            a, b = w[low].sum(), w[~low].sum()
            if a < min_weight or b < min_weight:
                continue
            gain = score((w[low, None] * r[low]).sum(axis=0), a) + score((w[~low, None] * r[~low]).sum(axis=0), b) - score(total, n)
            if gain > best[0] * (1 + 1e-9):
                best = (gain, (f, v, low))
    if best[1] is None:
        return leaf
    f, v, low = best[1]
    return (f, v, *(brute_tree(x[s], r[s], w[s], depth - 1, penalty, columns, min_weight) for s in (low, ~low)))


def brute_predict(tree, x):
    if not isinstance(tree, tuple):
        return np.tile(tree, (len(x), 1))
    f, v, left, right = tree
    low = x[:, f] <= v
    out = np.empty((len(x), brute_predict(left, x[:1]).shape[1]))
    out[low], out[~low] = brute_predict(left, x[low]), brute_predict(right, x[~low])
    return out


def keys(spark, n):
    from pyspark.sql import functions as F
    rows = spark.range(n).select("id", F.xxhash64("id").alias("k")).collect()
    return np.array([r["k"] for r in sorted(rows, key=lambda r: r["id"])], dtype=np.int64).view(np.uint64)


SETTINGS = {"plain": T.Settings(6, 3, 0.3), "second order": T.Settings(8, 3, 0.3, penalty=1.0, row_share=0.8, column_share=0.8)}


@pytest.mark.parametrize("name", SETTINGS)
def test_boosting_equals_numpy(spark, name):
    s, (x, y) = SETTINGS[name], planted()
    models = T.Learner(s).fit(frame(spark, x, y), TARGETS, PREDICTIONS, ["id"])
    k = keys(spark, len(x))
    margin = np.tile(y.mean(axis=0), (len(x), 1))
    for r in range(s.rounds):
        before = margin.copy()
        for t in range(3):
            number = r * 3 + t
            w = T.row_weights(k, number, s)
            tree = brute_tree(x, (y - before)[:, [t]], w, s.depth, s.penalty, T.columns_of(number, 5, s))
            margin[:, t] += s.rate * brute_predict(tree, x)[:, 0]
    got = np.stack([m.predict(x) for m in models], axis=1)
    assert np.allclose(got, margin, atol=1e-8)
    if name == "second order":
        assert 0.7 < T.row_weights(k, 0, s).mean() < 0.9
        drawn = [T.columns_of(i, 5, s) for i in range(20)]
        assert {d.sum() for d in drawn} == {4} and len({tuple(d) for d in drawn}) > 2


def test_joint_forest_equals_numpy(spark, monkeypatch):
    s, (x, y) = T.Settings(5, 4, joint=True), planted(seed=1)
    monkeypatch.setattr(T, "MOST_CELLS", 2 * 8 * 5 * 64 * 4)  # two trees a pass
    models = T.Learner(s).fit(frame(spark, x, y), TARGETS, PREDICTIONS, ["id"])
    k, base = keys(spark, len(x)), y.mean(axis=0)
    total = np.zeros_like(y)
    for number in range(s.rounds):
        w = T.row_weights(k, number, s)
        total += brute_predict(brute_tree(x, y - base, w, s.depth, 0.0, np.ones(5, dtype=bool)), x)
    assert np.allclose(np.stack([m.predict(x) for m in models], axis=1), base + total / s.rounds, atol=1e-8)
    # One structure for the three horizons.
    cuts = [[(t["feature"], t["cut"]) for t in m.content["trees"]] for m in models]
    assert cuts[0] == cuts[1] == cuts[2]


def test_weights_of_a_bootstrap(spark):
    w = T.row_weights(np.arange(100_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 3, T.Settings(1, 1, joint=True))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.01


@pytest.mark.parametrize("joint", [False, True])
def test_partitions_and_the_way_of_summing_do_not_matter(spark, monkeypatch, joint):
    x, y = planted(seed=2)
    s = T.Settings(5, 3, 0.3, penalty=1.0, row_share=0.8, column_share=0.8, joint=joint)
    one = T.Learner(s).fit(frame(spark, x, y, 1), TARGETS, PREDICTIONS, ["id"])
    monkeypatch.setattr(T, "CUT", 2)
    many = T.Learner(s).fit(frame(spark, x, y, 9), TARGETS, PREDICTIONS, ["id"])
    monkeypatch.setattr(T, "DIRECT", 2)
    monkeypatch.setattr(T, "TOGETHER", 0)
    passes = T.Learner(s).fit(frame(spark, x, y, 9), TARGETS, PREDICTIONS, ["id"])
    for a, b, c in zip(one, many, passes):
        assert np.allclose(a.predict(x), b.predict(x), atol=1e-9) and np.allclose(a.predict(x), c.predict(x), atol=1e-9)


def test_transform_save_and_load(spark, tmp_path):
    x, y = planted(200)
    df = frame(spark, x, y)
    model = T.Learner(T.Settings(3, 2, 0.5)).fit(df, TARGETS, PREDICTIONS, ["id"])[1]
    model.write().save(str(tmp_path / "m"))
    again = DefaultParamsReader.loadParamsInstance(str(tmp_path / "m"), spark.sparkContext)
    rows = again.transform(df).select("id", "p2").collect()
    want = model.predict(x)
    assert len(rows) == 200 and all(abs(r["p2"] - want[r["id"]]) < 1e-12 for r in rows)
    assert again.transform(df.limit(0)).count() == 0
    weights = again.featureImportances
    assert abs(sum(weights) - 1) < 1e-9 and max(weights) in (weights[2], weights[3])


def test_constant_targets_and_no_rows(spark):
    x, _ = planted(50)
    models = T.Learner(T.Settings(3, 2, 0.5)).fit(frame(spark, x, np.full((50, 3), 7.0)), TARGETS, PREDICTIONS, ["id"])
    assert np.allclose(models[0].predict(x), 7.0) and sum(models[0].featureImportances) == 0
    with pytest.raises(ValueError):
        T.Learner(T.Settings(1, 1)).fit(frame(spark, x, x[:, :3]).limit(0), TARGETS, PREDICTIONS, ["id"])
    with pytest.raises(ValueError):
        T.Learner(T.Settings(1, 1, bins=300)).fit(frame(spark, x, x[:, :3]), TARGETS, PREDICTIONS, ["id"])
