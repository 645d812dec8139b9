"""The newest readings of every station -> labelled forecasts."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationcast import schema as S
from stationcast.functions.cleaning import align_features
from stationcast.functions.display import aqi_category, finalize_prediction, horizon_date, horizon_label
from stationcast.operators.dedup import dedup_readings, latest_row, recent_rows
from stationcast.operators.evaluate import resolve_serving_model
from stationcast.operators.series import DAY, feature_window_columns
from stationcast.plans.training import assemble, predict
from stationcast.sources import tables

# The longest lag and the current row.
HISTORY_ROWS = 3 * DAY + 1


def inference_row(history: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row of features per station, computed from the rows its lags can reach."""
    recent = recent_rows(dedup_readings(history), HISTORY_ROWS)
    window = Window.partitionBy(S.STATION).orderBy(S.TIME)
    newest = latest_row(recent.withColumns(feature_window_columns(window)))
    return align_features(newest, names, keep=S.KEY)


def stored_inference_row(spark: SparkSession, root: str, names: list[str] | None = None,
                         version: int = tables.VERSION) -> DataFrame:
    """:func:`inference_row` of the reading table, from the days that the lags of each station reach."""
    return inference_row(tables.read_recent(spark, root, HISTORY_ROWS, version), names)


def load_serving_models(spark: SparkSession, root: str, name: str) -> tuple[list[Model], list[str] | None]:
    """The horizon models to serve, and the feature order they were trained with."""
    run = resolve_serving_model(tables.read_runs(spark, root).where(F.col("name") == name)).first()
    models = []
    for horizon in S.HORIZONS:
        models.append(DefaultParamsReader.loadParamsInstance(f"{run['model_path']}/horizon={horizon}",
                                                             spark.sparkContext))
    return models, tables.read_feature_list(spark, tables.feature_list_path(root, name, run["version"]))


def labelled_horizons(predictions: DataFrame, run_date: Column) -> DataFrame:
    """(city, run_date, horizon, ...) rows from one row of predictions per station.

    A horizon without a prediction stays, marked as not available.
    """
    rows = [F.struct(F.lit(h).cast("bigint").alias("horizon"), F.col(p).alias("prediction"))
            for h, p in zip(S.HORIZONS, S.PREDICTIONS)]
    long = (predictions.select(S.STATION, run_date.alias("run_date"), F.inline(F.array(*rows)))
            .withColumn("pred_aqi", finalize_prediction(F.col("prediction"))))
    category = aqi_category(F.col("pred_aqi"))
    category["advice"] = F.coalesce(category["advice"], F.lit(S.NOT_AVAILABLE))
    return long.select(S.STATION, "run_date", "horizon", horizon_label(F.col("horizon")).alias("day_label"),
                       horizon_date(F.col("run_date"), F.col("horizon")).alias("target_date"),
                       "pred_aqi", *[c.alias(name) for name, c in category.items()])


def adapt_scalar_prediction(rows: DataFrame, prediction: str = "prediction") -> DataFrame:
    """A model with one output predicts the third day; the first two have no value."""
    empty = F.lit(None).cast("double")
    return rows.withColumns({S.PREDICTIONS[0]: empty, S.PREDICTIONS[1]: empty,
                             S.PREDICTIONS[2]: F.col(prediction)})


def forecast(history: DataFrame, models: list[Model], names: list[str] | None,
             run_date: Column | None = None) -> DataFrame:
    """The next three days of every station. A station with too short a history has missing features
    and so gets no prediction."""
    run_date = F.current_date() if run_date is None else run_date
    rows = inference_row(history, names)
    names = [c for c in rows.columns if c not in S.KEY]
    complete = rows.na.drop("any", subset=names)
    predicted = predict(models, assemble(complete, names)).select(S.STATION, *S.PREDICTIONS)
    return labelled_horizons(rows.select(S.STATION).join(predicted, S.STATION, "left"), run_date)
