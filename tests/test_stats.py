import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stationcast.operators import profiles, quantiles, stats
from tests.series_data import to_spark

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def data(kind: str, n: int = 4000) -> np.ndarray:
    rng = np.random.default_rng(5)
    return {"normal": rng.normal(0, 1, n), "ties": rng.choice([0.0, 0.0, 0.0, 1.0, 2.5], n),
            "constant": np.full(n, 3.25), "outlier": np.append(rng.random(n - 1), 1e12),
            "heavy": rng.pareto(0.5, n), "negative": -rng.exponential(5, n)}[kind]


@pytest.mark.parametrize("kind", ["normal", "ties", "constant", "outlier", "heavy", "negative"])
def test_bracketed_quantiles_are_exact(spark, kind, monkeypatch):
    # A coarse sketch and a low limit force several rounds of narrowing.
    monkeypatch.setattr(quantiles, "ACCURACY", 20)
    monkeypatch.setattr(quantiles, "_SPREAD", 6.0 / 20)
    values = data(kind)
    df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(5)
    got = quantiles.exact_quantiles(df, ["x"], PROBS, {"x": len(values)}, candidates=50)["x"]
    np.testing.assert_allclose(got, np.quantile(values, PROBS), rtol=1e-12)


def test_any_number_of_candidates_gives_the_same(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": data("normal"), "y": data("heavy")}))
    counts = {"x": 4000, "y": 4000}
    a = quantiles.exact_quantiles(df, ["x", "y"], PROBS, counts)
    b = quantiles.exact_quantiles(df, ["x", "y"], PROBS, counts, candidates=50)
    for c in counts:
        np.testing.assert_allclose(a[c], b[c], rtol=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-4, 4).map(float) | st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_quantiles_of_any_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = quantiles.exact_quantiles(df, ["x"], [0.25, 0.5, 0.9], {"x": len(values)}, candidates=5)["x"]
    np.testing.assert_allclose(got, np.quantile(values, [0.25, 0.5, 0.9]), rtol=1e-9, atol=1e-9)


def test_describe_equals_pandas(spark):
    frame = pd.DataFrame({"x": data("normal"), "y": data("ties")})
    frame.loc[::7, "x"] = np.nan
    df = to_spark(spark, frame, "x double, y double")
    got = stats.describe(df, ["x", "y"]).toPandas().set_index("feature")
    want = frame.describe()
    for c in frame:
        np.testing.assert_allclose(
            got.loc[c, ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]].astype(float), want[c], rtol=1e-9)


def test_describe_of_an_empty_column(spark):
    row = stats.describe(spark.createDataFrame([(1.0, None)], "x double, y double"), ["x", "y"]).collect()[1]
    assert row["count"] == 0 and row["mean"] is None and row["q50"] is None


@pytest.mark.parametrize("kind", ["normal", "ties", "heavy", "outlier", "negative"])
def test_histogram_equals_numpy_auto(spark, kind):
    values = data(kind, 1500)
    counts, edges = np.histogram(values, bins="auto")
    got = (stats.histogram(spark.createDataFrame(pd.DataFrame({"x": values})), ["x"]).orderBy("bin").toPandas())
    assert list(got["n"]) == list(counts)
    np.testing.assert_allclose(got["left_edge"], edges[:-1], rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(got["right_edge"], edges[1:], rtol=1e-9, atol=1e-9)


def test_histogram_of_a_constant(spark):
    got = stats.histogram(spark.createDataFrame(pd.DataFrame({"x": data("constant")})), ["x"]).collect()
    assert [(r["left_edge"], r["right_edge"], r["n"]) for r in got] == [(2.75, 3.75, 4000)]


def test_density_curve(spark):
    values = data("normal", 300)
    got = stats.density_curve(spark.createDataFrame(pd.DataFrame({"x": values, "c": 1.0})), ["x", "c"], points=50,
                              bin_width={"x": 0.5}).orderBy("point").toPandas()
    assert set(got["feature"]) == {"x"}
    grid = np.linspace(values.min(), values.max(), 50)
    h = values.std(ddof=1) * len(values) ** -0.2
    want = np.exp(-0.5 * ((grid[:, None] - values) / h) ** 2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(got["density"], want, rtol=1e-9)
    np.testing.assert_allclose(got["scaled"], want * 300 * 0.5, rtol=1e-9)


def test_correlation_equals_pandas_with_missing_values(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame(rng.normal(size=(200, 4)), columns=list("abcd"))
    frame["b"] += frame["a"]
    frame["d"] = 1.0
    frame = frame.mask(rng.random(frame.shape) < 0.2)
    got = stats.correlation_matrix(to_spark(spark, frame, "a double, b double, c double, d double"), list("abcd")).toPandas()
    got = got.pivot(index="x", columns="y", values="r").astype(float)
    want = frame.corr()
    want.loc["d", "d"] = np.nan
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)


def test_null_profile(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, 3.0), (4.0, 5.0)], "x double, y double")
    got = {r["column_name"]: (r["nulls"], r["share"]) for r in stats.null_profile(df, ["x", "y"]).collect()}
    assert got == {"x": (1, 0.25), "y": (2, 0.5)}


def hourly(spark, n=2000):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"city": "a", "ingestion_timestamp": pd.date_range("2024-01-01", periods=n, freq="h")})
    frame["hour"] = frame["ingestion_timestamp"].dt.hour
    frame["aqi"] = rng.normal(70, 10, n) + frame["hour"]
    return frame, to_spark(spark, frame, "city string, ingestion_timestamp timestamp, hour long, aqi double")


def test_bootstrap_interval_has_the_right_width(spark):
    frame, df = hourly(spark)
    got = profiles.diurnal_profile(df).orderBy("hour").toPandas()
    by_hour = frame.groupby("hour")["aqi"]
    np.testing.assert_allclose(got["aqi_mean"], by_hour.mean())
    half = 1.96 * by_hour.std() / np.sqrt(by_hour.count())
    ratio = (got["ci_high"] - got["ci_low"]) / (2 * half)
    assert ratio.mean() == pytest.approx(1.0, abs=0.08) and ratio.between(0.75, 1.25).all()


@pytest.mark.parametrize("count", [1, 2, 8, 9, 40, 3000, 1 << 17, 1 << 21])
def test_bootstrap_weights_are_poisson(count):
    seeds = np.random.default_rng(count).integers(0, profiles._PRIME, 200)
    w = profiles.weights(seeds, np.full(200, count), 100)
    assert w.mean() == pytest.approx(count, abs=4 * (count / w.size) ** 0.5)
    assert w.var() == pytest.approx(count, rel=0.06) and w.min() >= 0 and (w == np.rint(w)).all()


def test_bootstrap_of_equal_values_follows_their_count(spark):
    """Many rows of few values: the interval is as wide as for rows drawn one by one."""
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"city": [f"c{i % 50}" for i in range(20_000)],
                          "ingestion_timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(20_000) // 50, unit="h")})
    frame["hour"] = frame["ingestion_timestamp"].dt.hour
    frame["aqi"] = rng.integers(50, 60, 20_000).astype(float)
    df = to_spark(spark, frame, "city string, ingestion_timestamp timestamp, hour long, aqi double")
    got = profiles.diurnal_profile(df).orderBy("hour").toPandas()
    by_hour = frame.groupby("hour")["aqi"]
    half = 1.96 * by_hour.std() / np.sqrt(by_hour.count())
    assert ((got["ci_high"] - got["ci_low"]) / (2 * half)).between(0.85, 1.15).all()
    plan = profiles.diurnal_profile(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_bootstrap_does_not_depend_on_partitioning(spark):
    _, df = hourly(spark, 300)
    a = profiles.diurnal_profile(df.repartition(1), 50).orderBy("hour").toPandas()
    b = profiles.diurnal_profile(df.repartition(7), 50).orderBy("hour").toPandas()
    np.testing.assert_allclose(a.astype(float), b.astype(float))


def test_linear_fit(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), (F.col("id") * 3.0 + 2.0).alias("y"))
    row = profiles.linear_fit(df, [("x", "y")]).first()
    assert (row["slope"], row["intercept"], row["r2"]) == pytest.approx((3.0, 2.0, 1.0))
    flat = profiles.linear_fit(df.withColumn("x", F.lit(1.0)), [("x", "y")]).first()
    assert flat["slope"] is None and flat["n"] == 100


def test_density_shuffles_cells_not_values(spark):
    """What leaves the first shuffle is bounded by the range in bandwidths, whatever the number of distinct values."""
    def cells(n):
        df = spark.range(n).select((F.col("id") / n).alias("x"))
        got = stats.density_curve(df, ["x"], points=20)
        h = n ** -0.2 * (1 / 12) ** 0.5
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "cell" in plan and abs(got.agg(F.avg("density")).first()[0] - 0.97) < 0.05
        return 1 / h * stats.FINE
    assert cells(200_000) < 15_000


def test_correlation_of_constants_gaps_and_partitions(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(1e6, 1.0, 3000)
    frame = pd.DataFrame({"a": a, "b": a * 2 + rng.normal(0, 1, 3000), "c": 0.1, "d": np.nan, "e": rng.normal(0, 1, 3000)})
    frame.loc[rng.random(3000) < 0.3, "b"] = np.nan
    frame.loc[frame.index < 2990, "e"] = np.nan
    df = to_spark(spark, frame, "a double, b double, c double, d double, e double")
    want = frame.corr()
    for parts in (1, 7):
        got = stats.correlation_matrix(df.repartition(parts), list("abcde")).toPandas()
        assert len(got) == 25
        for r in got.itertuples():
            exact = want.loc[r.x, r.y]
            if "c" in (r.x, r.y) or "d" in (r.x, r.y):
                assert r.r is None or np.isnan(r.r)
            else:
                assert abs(r.r - exact) < 1e-9
    empty = stats.correlation_matrix(df.limit(0), ["a", "b"]).toPandas()
    assert len(empty) == 4 and empty["r"].isna().all()
