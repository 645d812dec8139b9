import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationcast import schema as S
from stationcast.operators import evaluate
from stationcast.plans import forecast as forecasting
from stationcast.plans import training
from stationcast.sources import tables
from tests.series_data import to_spark

FEW = training.candidate_models(forest_trees=3, boosting_rounds=2, extreme_rounds=2)


def planted(spark, n=600):
    """Targets that are known linear functions of two features, plus a little noise."""
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"city": "a", "ingestion_timestamp": pd.date_range("2024-01-01", periods=n, freq="h"),
                          "pm25": rng.normal(20, 5, n), "humidity": rng.normal(60, 10, n)})
    for h, (a, b) in enumerate(((2.0, 0.5), (1.0, -0.25), (0.5, 1.0)), 1):
        frame[f"target_day{h}"] = 10.0 * h + a * frame["pm25"] + b * frame["humidity"] + rng.normal(0, 0.01, n)
    return to_spark(spark, frame, "city string, ingestion_timestamp timestamp, pm25 double, humidity double, "
                                  "target_day1 double, target_day2 double, target_day3 double")


def scored(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"model": ["x"] * 30 + ["y"] * 30})
    for h in S.HORIZONS:
        frame[f"target_day{h}"] = rng.normal(80, 10, 60)
    for h in S.HORIZONS:
        frame[f"pred_day{h}"] = frame[f"target_day{h}"] + rng.normal(0, h, 60)
    return frame, spark.createDataFrame(frame)


def test_metrics_follow_their_definitions(spark):
    frame, df = scored(spark)
    got = evaluate.regression_metrics(df).toPandas().set_index("model")
    spread = evaluate.prediction_spread(df).toPandas().set_index("model")
    for name, g in frame.groupby("model"):
        y, p = g[S.TARGETS].to_numpy(), g[S.PREDICTIONS].to_numpy()
        r2 = 1 - ((y - p) ** 2).sum(0) / ((y - y.mean(0)) ** 2).sum(0)
        want = [30, np.abs(y - p).mean(), np.sqrt(((y - p) ** 2).mean()), r2.mean(), *np.abs(y - p).mean(0)]
        np.testing.assert_allclose(got.loc[name].astype(float), want, rtol=1e-9)
        assert spread.loc[name, "prediction_std"] == pytest.approx(p.std())


def test_constant_target_has_no_r2_to_divide(spark):
    rows = [("x", *[5.0] * 3, *[5.0] * 3), ("x", *[5.0] * 3, *[5.0] * 3), ("y", *[5.0] * 3, *[6.0] * 3)]
    df = spark.createDataFrame(rows, ", ".join(["model string"] + [f"{c} double" for c in S.TARGETS + S.PREDICTIONS]))
    got = {r["model"]: r["r2"] for r in evaluate.regression_metrics(df).collect()}
    assert got == {"x": 1.0, "y": 0.0}


def test_first_model_wins_ties(spark):
    df = spark.createDataFrame([("b", 2, 1.5), ("a", 1, 1.5), ("c", 3, 9.0)], "model string, position long, mae double")
    assert evaluate.select_best(df).first()["model"] == "a"
    assert [r["model"] for r in evaluate.rank_models(df).collect()] == ["a", "b", "c"]


@pytest.mark.parametrize("runs,want", [
    ([(1, "x Multi-Output", {"mae": 3.0}), (2, "multi-output y", {"mae": 2.0}), (3, "plain", {"mae": 0.1})], 2),
    ([(1, "multi-output", {"rmse": 1.0}), (2, "MULTI-OUTPUT", {"mae": 50.0})], 2),
    ([(1, "multi-output", {"mae": 2.0}), (2, "multi-output", {"mae": 2.0})], 1),
    ([(1, None, {"mae": 1.0}), (2, "plain", {}), (3, "", {"mae": 9.0})], 3)])
def test_serving_model(spark, runs, want):
    df = spark.createDataFrame([("m", v, d, m, "p") for v, d, m in runs], S.MODEL_RUN)
    assert evaluate.resolve_serving_model(df).first()["version"] == want


def test_comparison_table_rounds_predictions(spark):
    row = evaluate.comparison_table(spark.createDataFrame(
        [(1.25, 2.0, 3.0, 1.25, 1.35, 2.0)], ", ".join(f"{c} double" for c in S.TARGETS + S.PREDICTIONS))).first()
    assert (row["actual_day1"], row["predicted_day1"], row["predicted_day2"]) == (1.25, 1.2, 1.4)


def test_split_ignores_partitioning(spark):
    df = planted(spark)
    train, test = training.split(df)
    again = training.split(df.repartition(7))[1]
    assert train.count() == 480 and test.count() == 120
    assert sorted(test.select(S.TIME).collect()) == sorted(again.select(S.TIME).collect())
    assert sorted(training.split(df, seed=1)[1].select(S.TIME).collect()) != sorted(test.select(S.TIME).collect())


@pytest.mark.parametrize("n, want", [(0, 0), (1, 1), (4, 1), (5, 1), (6, 2), (599, 120)])
def test_split_takes_a_fifth_rounded_up(spark, monkeypatch, n, want):
    df = planted(spark).orderBy(S.TIME).limit(n)
    train, test = training.split(df)
    assert test.count() == want and train.count() == n - want
    # Of many rows few are looked at in any round.
    monkeypatch.setattr(training.quantiles.value_at_rank, "__defaults__", (3,))
    assert sorted(training.split(df)[1].select(S.TIME).collect()) == sorted(test.select(S.TIME).collect())


def test_linear_regression_recovers_planted_coefficients(spark):
    ready = training.assemble(planted(spark), ["pm25", "humidity"])
    models = training.fit_horizons(training.candidate_models()["LinearRegression"], ready)
    got = [[m.intercept, *m.coefficients] for m in models]
    np.testing.assert_allclose(got, [[10, 2, 0.5], [20, 1, -0.25], [30, 0.5, 1]], atol=0.05)


def test_compare_models_finds_the_linear_truth(spark):
    result = training.compare_models(planted(spark), FEW)
    metrics = result.metrics.toPandas().set_index("model")
    assert result.features == ["pm25", "humidity"]
    assert list(result.models) == ["XGBoost", "RandomForest", "GradientBoosting", "LinearRegression"]
    assert all(len(m) == 3 for m in result.models.values())
    assert np.isfinite(metrics.astype(float)).all().all()
    assert result.best() == "LinearRegression" and metrics.loc["LinearRegression", "r2"] > 0.99
    importance = training.mean_importance(spark, result.models["RandomForest"], result.features).collect()
    assert {r["label"] for r in importance} == {"PM2.5", "Humidity"}
    assert sum(r["importance"] for r in importance) == pytest.approx(1.0)
    assert importance[0]["importance"] <= importance[1]["importance"]


def readings(spark, hours=400):
    rng = np.random.default_rng(8)
    frames = []
    for city, n in (("a", hours), ("b", hours // 2), ("young", 30)):
        t = pd.date_range("2024-01-01", periods=n, freq="h")
        frame = pd.DataFrame({"city": city, "timestamp": t, S.TIME: t})
        for c in S.MEASURES:
            frame[c] = rng.normal(50, 10, n).clip(1)
        frames.append(frame.assign(hour=t.hour, day=t.day, month=t.month, day_of_week=t.dayofweek, target_aqi=0.0,
                                   target_day="x"))
    return spark.createDataFrame(pd.concat(frames), S.READING)


def test_train_register_and_forecast(spark, tmp_path):
    root, history = str(tmp_path), readings(spark)
    only = {"LinearRegression": FEW["LinearRegression"], "RandomForest": FEW["RandomForest"]}
    result, version = training.train_and_register(history, root, "p", candidates=only)
    assert version == 1 and len(result.features) == 23
    assert tables.register_run(spark, root, "p", {"mae": 1e9, "rmse": 1.0}, "multi-output worse",
                               result.models["RandomForest"]) == 2
    assert tables.register_run(spark, root, "q", {"mae": 0.0}, "other name", result.models["RandomForest"]) == 1
    models, names = forecasting.load_serving_models(spark, root, "p")
    assert names == result.features and len(models) == 3
    rows = forecasting.forecast(history, models, names, F.lit(dt.date(2024, 2, 1))).orderBy("city", "horizon").collect()
    assert len(rows) == 9
    assert [r["target_date"] for r in rows[:3]] == ["Fri, Feb 02", "Sat, Feb 03", "Sun, Feb 04"]
    assert all(r["pred_aqi"] >= 0 and r["label"] for r in rows[:6])
    # Too short a history: no features, no prediction.
    assert all(r["pred_aqi"] is None and r["advice"] == S.NOT_AVAILABLE for r in rows[6:])


def test_nothing_to_train_on(spark, tmp_path):
    assert training.train_and_register(readings(spark, 40), str(tmp_path), "p", candidates=FEW) is None


def test_unknown_targets(spark):
    with pytest.raises(ValueError):
        training.training_frame(readings(spark, 40), targets="weekly")


def test_funnel(spark):
    history = readings(spark, 200)
    framed = training.labelled_frame(history, targets="fixed")
    got = {r["city"]: r for r in evaluate.funnel_counts(history.unionByName(history), framed, list(S.FEATURE_LABELS)).collect()}
    assert (got["a"]["fetched"], got["a"]["deduped"], got["a"]["labelled"], got["a"]["complete"]) == (400, 200, 128, 56)
    assert (got["a"]["state"], got["b"]["state"], got["young"]["state"]) == ("ok", "stop", "stop")


def test_scalar_prediction(spark):
    rows = forecasting.adapt_scalar_prediction(spark.createDataFrame([("a", 151.0)], "city string, prediction double"))
    got = forecasting.labelled_horizons(rows, F.lit(dt.date(2024, 1, 1))).orderBy("horizon").collect()
    assert [r["pred_aqi"] for r in got] == [None, None, 151]
    assert [r["label"] for r in got] == [None, None, "Unhealthy"]
    assert got[0]["advice"] == S.NOT_AVAILABLE
