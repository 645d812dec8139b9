"""Scoring predictions, ranking models and choosing which one serves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationcast import schema as S

MULTI_OUTPUT = "multi-output"


def long_predictions(scored: DataFrame) -> DataFrame:
    """(model, horizon, y, prediction) rows from one row per sample."""
    rows = [F.struct(F.lit(h).cast("bigint").alias("horizon"), F.col(t).alias("y"), F.col(p).alias("prediction"))
            for h, t, p in zip(S.HORIZONS, S.TARGETS, S.PREDICTIONS)]
    return scored.select("model", F.inline(F.array(*rows)))


def horizon_metrics(scored: DataFrame) -> DataFrame:
    """n, MAE, MSE and R² per model and horizon."""
    error = F.col("y") - F.col("prediction")
    per = long_predictions(scored).groupBy("model", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"), F.var_pop("y").alias("_var"))
    # A constant target has no variance to explain: a perfect fit scores 1, any other 0.
    r2 = (F.when(F.col("_var") > 0, F.lit(1.0) - F.col("mse") / F.col("_var"))
          .when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return per.withColumn("r2", r2).drop("_var")


def regression_metrics(scored: DataFrame) -> DataFrame:
    """Per model: MAE, RMSE and R² over the horizons, and each horizon's MAE.

    RMSE is the root of the mean MSE, not the mean of the per-horizon roots.
    """
    days = [F.max(F.when(F.col("horizon") == h, F.col("mae"))).alias(f"day{h}_mae") for h in S.HORIZONS]
    return horizon_metrics(scored).groupBy("model").agg(
        F.max("n").alias("n"), F.avg("mae").alias("mae"), F.sqrt(F.avg("mse")).alias("rmse"),
        F.avg("r2").alias("r2"), *days)


def prediction_spread(scored: DataFrame) -> DataFrame:
    """Standard deviation of all predictions of a model; near 0 means the model does not react."""
    return (long_predictions(scored).groupBy("model")
            .agg(F.stddev_pop("prediction").alias("prediction_std")))


def select_best(metrics: DataFrame) -> DataFrame:
    """The lowest MAE; the model listed first wins ties. Expects (model, position, mae)."""
    return metrics.agg(F.min_by("model", F.struct("mae", "position")).alias("model"),
                       F.min("mae").alias("mae"))


def rank_models(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy("mae", "position")


def melt_metrics(metrics: DataFrame) -> DataFrame:
    """(model, horizon, mae) rows from the per-day columns."""
    days = [F.col(f"day{h}_mae").alias(f"Day {h} MAE") for h in S.HORIZONS]
    return (metrics.select("model", *days)
            .unpivot("model", [f"Day {h} MAE" for h in S.HORIZONS], "forecast_horizon", "mae"))


def resolve_serving_model(runs: DataFrame) -> DataFrame:
    """Per model name, the run to serve.

    Among runs described as multi-output the one with the lowest MAE (a missing one counts as worst,
    the oldest version wins ties); if there is none, the highest version.
    """
    multi = F.coalesce(F.contains(F.lower("description"), F.lit(MULTI_OUTPUT)), F.lit(False))
    mae = F.coalesce(F.try_element_at("metrics", F.lit("mae")), F.lit(float("inf")))
    order = [multi.desc(), F.when(multi, mae).asc(),
             F.when(multi, F.col("version")).asc(), F.col("version").desc()]
    ranked = runs.withColumn("_rn", F.row_number().over(Window.partitionBy("name").orderBy(*order)))
    return ranked.where(F.col("_rn") == 1).drop("_rn")


def comparison_table(scored: DataFrame) -> DataFrame:
    """Actual and predicted values side by side, predictions to one decimal (halves to even)."""
    columns: list[Column] = []
    for h, t, p in zip(S.HORIZONS, S.TARGETS, S.PREDICTIONS):
        columns += [F.col(t).alias(f"actual_day{h}"), F.bround(p, 1).alias(f"predicted_day{h}")]
    return scored.select(*[c for c in S.KEY if c in scored.columns], *columns)


def funnel_counts(raw: DataFrame, framed: DataFrame, features: list[str], warn_below: int = 50) -> DataFrame:
    """Per station: rows fetched, left after dedup, with all targets, and complete.

    ``framed`` is the deduplicated frame with features and targets, before incomplete rows go.
    """
    def all_set(columns: list[str]) -> Column:
        test = F.lit(True)
        for c in columns:
            test = test & F.col(c).isNotNull()
        return test

    labelled = all_set(S.TARGETS)
    complete = labelled & all_set(features)
    fetched = raw.groupBy(S.STATION).agg(F.count(F.lit(1)).alias("fetched"))
    kept = framed.groupBy(S.STATION).agg(
        F.count(F.lit(1)).alias("deduped"), F.count(F.when(labelled, 1)).alias("labelled"),
        F.count(F.when(complete, 1)).alias("complete"))
    state = (F.when(F.col("complete") == 0, "stop")
             .when(F.col("labelled") < warn_below, "warn").otherwise("ok"))
    return fetched.join(kept, S.STATION, "left").na.fill(0).withColumn("state", state)
