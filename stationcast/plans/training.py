"""Readings -> training frame -> fitted and compared models -> registered run."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast import schema as S
from stationcast.functions.cleaning import (drop_zero_weather, feature_columns, format_key_ts,
                                            require_features, require_targets)
from stationcast.functions.display import display_label
from stationcast.operators import evaluate, quantiles
from stationcast.operators.dedup import dedup_readings
from stationcast.operators.series import (BLOCK_DAYS, features_and_cadence_targets,
                                          features_and_fixed_targets)
from stationcast.plans.trees import Learner, Settings
from stationcast.session import ensure_checkpoint_dir, materialize
from stationcast.sources import tables

SEED = 42
TEST_PERCENT = 20

# An estimator for a label column and a prediction column, or a learner that fits all horizons together.
Factory = Callable[[str, str], Estimator] | Learner


# --- frame ---------------------------------------------------------------------------------

def labelled_frame(readings: DataFrame, targets: str = "cadence", clean_weather: bool = True,
                   block_days: int = BLOCK_DAYS) -> DataFrame:
    """Deduplicated readings with features and targets, incomplete rows still in.

    ``targets``: "cadence" looks one to three days ahead at each station's own cadence, "fixed" 24, 48
    and 72 rows. ``clean_weather`` drops the rows whose weather was filled with zeros.
    """
    rows = dedup_readings(drop_zero_weather(readings) if clean_weather else readings)
    if targets == "fixed":
        return features_and_fixed_targets(rows, block_days)
    if targets == "cadence":
        return features_and_cadence_targets(rows, block_days)
    raise ValueError(f"unknown targets {targets!r}")


def complete_rows(framed: DataFrame) -> DataFrame:
    return require_features(require_targets(framed))


def training_frame(readings: DataFrame, targets: str = "cadence", clean_weather: bool = True,
                   block_days: int = BLOCK_DAYS) -> DataFrame:
    return complete_rows(labelled_frame(readings, targets, clean_weather, block_days))


def split_order(seed: int = SEED) -> Column:
    """A number below 2^52 from the row's key, in whose order rows are dealt: the same for any partitioning."""
    key = F.concat_ws("|", F.col(S.STATION), format_key_ts(F.col(S.TIME)), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint").cast("double")


def split(df: DataFrame, seed: int = SEED, test_percent: int = TEST_PERCENT) -> tuple[DataFrame, DataFrame]:
    """(train, test): shuffled, a fifth of the rows, rounded up, for testing.

    The order number of the last test row is found by counting between approximate quantiles, so no row is sorted or
    collected; both sides are filters. Rows of one key stay together. The frame is read three times to find it, so it
    should be a written one.
    """
    n = df.count()
    wanted = -(-n * test_percent // 100)
    if wanted == 0:
        return df, df.where(F.lit(False))
    order = split_order(seed)
    last = quantiles.value_at_rank(df.select(order.alias("order")), "order", wanted - 1, n)
    return df.where(order > last), df.where(order <= last)


def assemble(df: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features").transform(df)


# --- models --------------------------------------------------------------------------------

def candidate_models(forest_trees: int = 100, boosting_rounds: int = 150, extreme_rounds: int = 200,
                     seed: int = SEED) -> dict[str, Factory]:
    """The four candidates, in the order that breaks ties.

    The trees are grown for all horizons from the same passes (see ``trees``): "XGBoost" by second-order boosting with
    an L2 penalty of 1, a row and a column sample per tree; "RandomForest" as one joint forest of the three horizons;
    "GradientBoosting" without penalty or samples.
    """
    extreme = Learner(Settings(extreme_rounds, 5, 0.05, penalty=1.0, row_share=0.8, column_share=0.8, seed=seed),
                      importance="average")
    forest = Learner(Settings(forest_trees, 6, joint=True, seed=seed))
    boosting = Learner(Settings(boosting_rounds, 4, 0.05, seed=seed))

    def linear(label: str, prediction: str) -> Estimator:
        return LinearRegression(labelCol=label, predictionCol=prediction, regParam=0.0, solver="normal")

    return {"XGBoost": extreme, "RandomForest": forest, "GradientBoosting": boosting,
            "LinearRegression": linear}


def fit_horizons(factory: Factory, train: DataFrame) -> list[Model]:
    """One model per target, on an assembled frame: by one fit of all targets, or by fits side by side."""
    if isinstance(factory, Learner):
        return factory.fit(train, S.TARGETS, S.PREDICTIONS, [c for c in S.KEY if c in train.columns] or S.TARGETS)
    ensure_checkpoint_dir(train.sparkSession)

    @inheritable_thread_target(train.sparkSession)
    def fit(target: str, prediction: str) -> Model:
        return factory(target, prediction).fit(train.select("features", target))

    with ThreadPoolExecutor(len(S.HORIZONS)) as pool:
        return list(pool.map(fit, S.TARGETS, S.PREDICTIONS))


def predict(models: list[Model], df: DataFrame) -> DataFrame:
    """Adds one prediction column per horizon."""
    return reduce(lambda rows, model: model.transform(rows), models, df)


def score(models: dict[str, list[Model]], test: DataFrame) -> DataFrame:
    """(key, targets, predictions, model) rows of every model on the test rows."""
    scored = [predict(fitted, test).select(*S.KEY, *S.TARGETS, *S.PREDICTIONS, F.lit(name).alias("model"))
              for name, fitted in models.items()]
    return reduce(DataFrame.unionByName, scored)


@dataclass
class Comparison:
    features: list[str]
    models: dict[str, list[Model]]
    scored: DataFrame
    metrics: DataFrame
    train_rows: int

    def best(self) -> str:
        return evaluate.select_best(self.metrics).first()["model"]


def compare_models(frame: DataFrame, candidates: dict[str, Factory] | None = None,
                   seed: int = SEED) -> Comparison | None:
    """Fit every candidate on the training rows and score it on the test rows; None for an empty frame."""
    candidates = candidates or candidate_models(seed=seed)
    spark, names = frame.sparkSession, feature_columns(frame)
    # Twelve fits and four scorings read this table.
    ready = materialize(assemble(frame, names).select(*S.KEY, "features", *S.TARGETS))
    if ready.isEmpty():
        return None
    train, test = split(ready, seed)
    models = {name: fit_horizons(factory, train) for name, factory in candidates.items()}
    # The trees run once; all metrics read the narrow result.
    scored = materialize(score(models, test))
    order = F.create_map(*[F.lit(x) for i, name in enumerate(models) for x in (name, i + 1)])
    metrics = (evaluate.regression_metrics(scored).join(evaluate.prediction_spread(scored), "model")
               .withColumn("position", F.element_at(order, F.col("model")).cast("bigint")))
    # One row per candidate.
    metrics = spark.createDataFrame(metrics.collect(), metrics.schema)
    return Comparison(names, models, scored, metrics, train.count())


def mean_importance(spark: SparkSession, models: list[Model], names: list[str]) -> DataFrame:
    """Feature importance averaged over the horizon models, lowest first."""
    rows = [(h, i + 1, name, float(model.featureImportances[i]))
            for h, model in zip(S.HORIZONS, models) for i, name in enumerate(names)]
    long = spark.createDataFrame(rows, "horizon bigint, position bigint, feature string, importance double")
    return (long.groupBy("feature", "position").agg(F.avg("importance").alias("importance"))
            .withColumn("label", display_label(F.col("feature")))
            .orderBy("importance", "position"))


def train_and_register(readings: DataFrame, root: str, name: str, targets: str = "cadence",
                       clean_weather: bool = True, candidates: dict[str, Factory] | None = None,
                       stations: list[str] | None = None) -> tuple[Comparison, int] | None:
    """Compare the candidates, register the best one and store the feature list beside it.

    ``stations`` trains on these stations only; by default one model serves all. None when no complete row is
    left to train on.
    """
    if stations is not None:
        readings = readings.where(F.col(S.STATION).isin(stations))
    result = compare_models(training_frame(readings, targets, clean_weather), candidates)
    if result is None:
        return None
    best = result.metrics.where(F.col("model") == result.best()).first()
    # Serving looks for the marker "multi-output".
    description = (f"estimator={best['model']}; multi-output over horizons {S.HORIZONS}; "
                   f"{result.train_rows} training rows; {len(result.features)} features; targets={targets}")
    spark = readings.sparkSession
    version = tables.register_run(spark, root, name, {"mae": best["mae"], "rmse": best["rmse"]},
                                  description, result.models[best["model"]])
    tables.write_feature_list(spark, result.features, tables.feature_list_path(root, name, version))
    return result, version
