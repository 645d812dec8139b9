"""Metrics with fixed predictors, model fits and forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcast import schema as S
from stationcast.operators import evaluate, stats
from stationcast.operators.dedup import latest_row
from stationcast.plans import forecast as forecasting
from stationcast.plans import training
from stationcast.plans.trees import Learner, Settings
from stationcast.session import materialize, scratch_path
from stationcast.sources import tables
from workloads import sql as Q
from workloads.registry import query
from workloads.tables import Tables

CITY, TIME = S.STATION, S.TIME

# Predictors that need no model: every horizon gets the same feature.
PREDICTORS = {"lag": "aqi_lag_24h", "mean": "aqi_rolling_mean_24h", "slow_mean": "aqi_rolling_mean_72h"}


def _fixed_scored(t: Tables) -> DataFrame:
    frame = training.training_frame(t.readings, targets="fixed")
    models = F.array(*[F.struct(F.lit(name).alias("model"), *[F.col(c).alias(p) for p in S.PREDICTIONS])
                       for name, c in PREDICTORS.items()])
    return frame.select(*S.KEY, *S.TARGETS, F.inline(models))


def _positioned(metrics: DataFrame) -> DataFrame:
    order = F.create_map(*[F.lit(x) for i, name in enumerate(PREDICTORS) for x in (name, i + 1)])
    return metrics.withColumn("position", F.element_at(order, F.col("model")).cast("bigint"))


_SCORED = Q.COMPLETE + ", scored AS (" + " UNION ALL ".join(
    f"SELECT city, ingestion_timestamp, '{name}' AS model, {i + 1}::BIGINT AS position, "
    f"{', '.join(S.TARGETS)}, {c} AS p FROM complete" for i, (name, c) in enumerate(PREDICTORS.items())) + ")"
_PER_HORIZON = _SCORED + ", long AS (" + " UNION ALL ".join(
    f"SELECT city, model, position, {h}::BIGINT AS horizon, {t} AS y, p FROM scored"
    for h, t in zip(S.HORIZONS, S.TARGETS)) + """), per_horizon AS (SELECT model, position, horizon, count(*) AS n,
  avg(abs(y - p)) AS mae, avg(pow(y - p, 2)) AS mse, 1 - avg(pow(y - p, 2)) / var_pop(y) AS r2 FROM long
  GROUP BY 1, 2, 3)"""
_METRICS = _PER_HORIZON + """, metrics AS (SELECT model, position, max(n) AS n, avg(mae) AS mae, sqrt(avg(mse)) AS rmse,
  avg(r2) AS r2, max(CASE WHEN horizon = 1 THEN mae END) AS day1_mae, max(CASE WHEN horizon = 2 THEN mae END) AS day2_mae,
  max(CASE WHEN horizon = 3 THEN mae END) AS day3_mae FROM per_horizon GROUP BY 1, 2)"""


@query("horizon_metrics", f"WITH {_PER_HORIZON} SELECT model, horizon, n, {Q.r('mae', 'mse', 'r2')} FROM per_horizon")
def horizon_metrics(t: Tables) -> DataFrame:
    return evaluate.horizon_metrics(_fixed_scored(t))


_DAY_MAE = [f"day{h}_mae" for h in S.HORIZONS]


@query("regression_metrics", f"WITH {_METRICS} SELECT model, n, {Q.r('mae', 'rmse', 'r2', *_DAY_MAE)} FROM metrics")
def regression_metrics(t: Tables) -> DataFrame:
    return evaluate.regression_metrics(_fixed_scored(t))


@query("prediction_spread", f"WITH {_PER_HORIZON} SELECT model, round(stddev_pop(p) + 1e-9, 4) AS prediction_std FROM long GROUP BY 1")
def prediction_spread(t: Tables) -> DataFrame:
    return evaluate.prediction_spread(_fixed_scored(t))


@query("select_best", f"WITH {_METRICS} SELECT model, {Q.r('mae')} FROM metrics ORDER BY metrics.mae, position LIMIT 1")
def select_best(t: Tables) -> DataFrame:
    return evaluate.select_best(_positioned(evaluate.regression_metrics(_fixed_scored(t))))


@query("rank_models", f"WITH {_METRICS} SELECT model, {Q.r('mae')}, position FROM metrics ORDER BY metrics.mae, position")
def rank_models(t: Tables) -> DataFrame:
    metrics = _positioned(evaluate.regression_metrics(_fixed_scored(t)))
    return evaluate.rank_models(metrics).select("model", "mae", "position")


@query("melt_metrics", f"WITH {_METRICS} " + " UNION ALL ".join(
    f"SELECT model, 'Day {h} MAE' AS forecast_horizon, round(day{h}_mae + 1e-9, 4) AS mae FROM metrics" for h in S.HORIZONS))
def melt_metrics(t: Tables) -> DataFrame:
    return evaluate.melt_metrics(evaluate.regression_metrics(_fixed_scored(t)))


@query("comparison_table", f"WITH {_SCORED} SELECT {Q.KEY}, " + ", ".join(
    f"round({t} + 1e-9, 4) AS actual_day{h}, round(round_even(p, 1) + 1e-9, 4) AS predicted_day{h}"
    for h, t in zip(S.HORIZONS, S.TARGETS)) + " FROM scored WHERE model = 'mean'")
def comparison_table(t: Tables) -> DataFrame:
    return evaluate.comparison_table(_fixed_scored(t).where(F.col("model") == "mean"))


# Every station is a model name; each predictor is one of its versions.
_RUNS = _SCORED + """, station_mae AS (SELECT city AS name, position AS version, model,
    avg((abs(target_day1 - p) + abs(target_day2 - p) + abs(target_day3 - p)) / 3) AS mae FROM scored GROUP BY 1, 2, 3),
  runs AS (SELECT *, CASE WHEN name IN ('site-2') THEN 'single output' WHEN model = 'lag' THEN NULL
    ELSE model || ' Multi-Output run' END AS description,
    CASE WHEN name = 'site-1' AND model = 'mean' THEN 'Infinity'::DOUBLE ELSE mae END AS rank_mae FROM station_mae),
  ranked AS (SELECT *, coalesce(contains(lower(description), 'multi-output'), false) AS multi FROM runs)"""


@query("resolve_serving_model", f"""WITH {_RUNS}, chosen AS (SELECT *, row_number() OVER (PARTITION BY name
    ORDER BY multi DESC, CASE WHEN multi THEN rank_mae END, CASE WHEN multi THEN version END, version DESC) AS rn FROM ranked)
  SELECT name, version, description FROM chosen WHERE rn = 1""")
def resolve_serving_model(t: Tables) -> DataFrame:
    per_row = reduce(lambda a, b: a + b, [F.abs(F.col(y) - F.col(p)) for y, p in zip(S.TARGETS, S.PREDICTIONS)]) / 3
    mae = (_positioned(_fixed_scored(t)).groupBy(F.col(CITY).alias("name"), F.col("position").alias("version"), "model")
           .agg(F.avg(per_row).alias("mae")))
    description = (F.when(F.col("name") == "site-2", "single output").when(F.col("model") == "lag", None)
                   .otherwise(F.concat("model", F.lit(" Multi-Output run"))))
    no_mae = (F.col("name") == "site-1") & (F.col("model") == "mean")
    metrics = (F.when(no_mae, F.create_map(F.lit("rmse"), F.lit(1.0)))
               .otherwise(F.create_map(F.lit("mae"), F.col("mae"))))
    runs = mae.select("name", "version", description.alias("description"), metrics.alias("metrics"))
    return evaluate.resolve_serving_model(runs).select("name", "version", "description")


@query("describe_predictions", f"WITH {_SCORED}, picked AS (SELECT p FROM scored WHERE model = 'mean') " + " UNION ALL ".join(
    f"SELECT {h}::BIGINT AS position, 'pred_day{h}' AS feature, count(p) AS count, round(avg(p) + 1e-9, 4) AS mean, "
    "round(stddev_samp(p) + 1e-9, 4) AS std, round(min(p) + 1e-9, 4) AS min, "
    "round(quantile_cont(p, 0.25) + 1e-9, 4) AS q25, round(quantile_cont(p, 0.5) + 1e-9, 4) AS q50, "
    "round(quantile_cont(p, 0.75) + 1e-9, 4) AS q75, round(max(p) + 1e-9, 4) AS max FROM picked" for h in S.HORIZONS))
def describe_predictions(t: Tables) -> DataFrame:
    return stats.describe(_fixed_scored(t).where(F.col("model") == "mean"), S.PREDICTIONS)


def _labelled_sql(value: str) -> str:
    def case(field: int) -> str:
        whens = " ".join(f"WHEN pred_aqi <= {c[0]} THEN '{c[field]}'" for c in S.CATEGORIES[:-1])
        return f"CASE WHEN pred_aqi IS NULL THEN NULL {whens} ELSE '{S.CATEGORIES[-1][field]}' END"
    return f"""WITH {Q.READINGS}, featured AS (SELECT *, {Q.FEATURES}, row_number() OVER (PARTITION BY city
    ORDER BY ingestion_timestamp DESC) AS rn FROM readings {Q.WINDOWS}),
  h AS (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS horizon),
  predicted AS (SELECT city, horizon, {value} AS pred_aqi FROM featured, h WHERE rn = 1)
  SELECT city, '2024-02-01' AS run_date, horizon, CASE horizon WHEN 1 THEN 'Tomorrow' WHEN 2 THEN 'Day 2' ELSE 'Day 3' END AS day_label,
  strftime(DATE '2024-02-01' + CAST(horizon AS INTEGER), '%a, %b %d') AS target_date, pred_aqi, {case(1)} AS label,
  {case(2)} AS css_class, {case(3)} AS pill_class, coalesce({case(4)}, '{S.NOT_AVAILABLE}') AS advice FROM predicted"""


_RUN_DATE = "2024-02-01"


def _newest_prediction(t: Tables) -> DataFrame:
    rows = forecasting.inference_row(t.readings, Q.FEATURE_NAMES)
    return rows.select(CITY, (F.col("aqi_rolling_mean_24h") * 10).alias("prediction"))


@query("labelled_forecast", _labelled_sql(
    "CAST(greatest(0, round_even(aqi_rolling_mean_24h * 10 + 7 * (horizon - 1), 0)) AS BIGINT)"))
def labelled_forecast(t: Tables) -> DataFrame:
    rows = _newest_prediction(t)
    steps = [(F.col("prediction") + 7 * i).alias(p) for i, p in enumerate(S.PREDICTIONS)]
    out = forecasting.labelled_horizons(rows.select(CITY, *steps), F.lit(_RUN_DATE).cast("date"))
    return out.withColumn("run_date", F.col("run_date").cast("string"))


@query("scalar_forecast", _labelled_sql(
    "CASE WHEN horizon = 3 THEN CAST(greatest(0, round_even(aqi_rolling_mean_24h * 10, 0)) AS BIGINT) END"))
def scalar_forecast(t: Tables) -> DataFrame:
    rows = forecasting.adapt_scalar_prediction(_newest_prediction(t))
    out = forecasting.labelled_horizons(rows.select(CITY, *S.PREDICTIONS), F.lit(_RUN_DATE).cast("date"))
    return out.withColumn("run_date", F.col("run_date").cast("string"))


# --- prediction archives -------------------------------------------------------------------
# One JSON document per station, as an archive file of its own.

_STEPS_SQL = "CAST(greatest(0, round_even(aqi_rolling_mean_24h * 10 + 7 * (horizon - 1), 0)) AS BIGINT)"


def _documents(t: Tables, rows: DataFrame, label: str) -> str:
    path = scratch_path(t.spark, label)
    rows.select(CITY, "value").write.partitionBy(CITY).text(path)
    return path


def _forecasts(t: Tables) -> DataFrame:
    steps = [(F.col("prediction") + 7 * i).alias(p) for i, p in enumerate(S.PREDICTIONS)]
    rows = _newest_prediction(t).select(CITY, *steps)
    return forecasting.labelled_horizons(rows, F.lit(_RUN_DATE).cast("date"))


def _in_order(*columns: str) -> Column:
    """A station's three horizons as one array."""
    return F.transform(F.array_sort(F.collect_list(F.struct("horizon", F.struct(*columns).alias("r")))),
                       lambda e: e["r"])


@query("past_predictions", f"""SELECT city, target_date AS date, pred_aqi AS predicted_aqi, label, css_class, pill_class
  FROM ({_labelled_sql(_STEPS_SQL)})""")
def past_predictions(t: Tables) -> DataFrame:
    renamed = _forecasts(t).withColumnsRenamed({"target_date": "date", "pred_aqi": "predicted_aqi"})
    documents = renamed.groupBy(CITY).agg(F.to_json(_in_order(*S.PAST_PREDICTION.names)).alias("value"))
    return tables.read_past_predictions(t.spark, _documents(t, documents, "past"))


@query("last_prediction", f"""WITH newest AS ({Q.hourly(Q.SITE)}), ranked AS (SELECT *, row_number() OVER (PARTITION BY city
    ORDER BY ingestion_timestamp DESC) AS rn FROM newest)
  SELECT f.city, '2024-02-01' AS "timestamp", 'mean' AS model_name, {', '.join(
      f'round(coalesce(r.{c}, 0.0) + 1e-9, 4) AS {c}' for c in S.CONDITIONS)}, day_label, target_date, pred_aqi, label,
  css_class, pill_class, advice FROM ({_labelled_sql(_STEPS_SQL)}) f JOIN ranked r ON r.city = f.city AND rn = 1""")
def last_prediction(t: Tables) -> DataFrame:
    fields = S.LAST_PREDICTION["predictions"].dataType.elementType.names
    predictions = _forecasts(t).groupBy(CITY).agg(_in_order(*fields).alias("predictions"))
    documents = latest_row(t.readings).join(predictions, CITY).select(CITY, F.to_json(F.struct(
        F.lit(_RUN_DATE).alias("timestamp"), F.struct(*S.CONDITIONS).alias("current_conditions"), "predictions",
        F.lit("mean").alias("model_name"))).alias("value"))
    path = _documents(t, documents, "last")
    return tables.read_last_prediction(t.spark, path)


# --- fitted models -------------------------------------------------------------------------
# All with the full rounds, the defaults of candidate_models.


def _assembled(t: Tables, names: list[str] = Q.FEATURE_NAMES) -> DataFrame:
    frame = training.training_frame(t.readings, targets="fixed")
    return materialize(training.assemble(frame, names).select(*S.KEY, "features", *S.TARGETS))


@query("linear_regression_line", f"WITH {Q.COMPLETE} " + " UNION ALL ".join(
    f"SELECT {h}::BIGINT AS horizon, round(regr_slope({t}, aqi_lag_24h) + 1e-9, 4) AS slope, "
    f"round(regr_intercept({t}, aqi_lag_24h) + 1e-9, 4) AS intercept FROM complete" for h, t in zip(S.HORIZONS, S.TARGETS)))
def linear_regression_line(t: Tables) -> DataFrame:
    """A fit on one feature, whose coefficients have a closed form."""
    linear = training.candidate_models()["LinearRegression"]
    models = training.fit_horizons(linear, _assembled(t, ["aqi_lag_24h"]))
    rows = [(h, float(m.coefficients[0]), float(m.intercept)) for h, m in zip(S.HORIZONS, models)]
    return t.spark.createDataFrame(rows, "horizon bigint, slope double, intercept double")


def _fit_and_score(t: Tables, name: str) -> DataFrame:
    train, test = training.split(_assembled(t))
    models = training.fit_horizons(training.candidate_models()[name], train)
    return training.score({name: models}, test)


@query("linear_regression")
def linear_regression(t: Tables) -> DataFrame:
    return _fit_and_score(t, "LinearRegression")


@query("random_forest")
def random_forest(t: Tables) -> DataFrame:
    return _fit_and_score(t, "RandomForest")


@query("gradient_boosting")
def gradient_boosting(t: Tables) -> DataFrame:
    return _fit_and_score(t, "GradientBoosting")


@query("extreme_boosting")
def extreme_boosting(t: Tables) -> DataFrame:
    return _fit_and_score(t, "XGBoost")


@query("compare_models")
def compare_models(t: Tables) -> DataFrame:
    frame = training.training_frame(t.readings, targets="fixed")
    return evaluate.rank_models(training.compare_models(frame, training.candidate_models()).metrics)


@query("mean_importance")
def mean_importance(t: Tables) -> DataFrame:
    train, _ = training.split(_assembled(t))
    models = training.fit_horizons(training.candidate_models()["RandomForest"], train)
    return training.mean_importance(t.spark, models, Q.FEATURE_NAMES)


@query("train_register_forecast")
def train_register_forecast(t: Tables) -> DataFrame:
    """Train, register, load the serving models back, forecast, archive and read the archive."""
    root = scratch_path(t.spark, "registry")
    readings = materialize(t.readings)
    training.train_and_register(readings, root, "predictor", targets="fixed",
                                candidates=training.candidate_models())
    models, names = forecasting.load_serving_models(t.spark, root, "predictor")
    made = forecasting.forecast(readings, models, names, F.lit(_RUN_DATE).cast("date"))
    tables.archive_predictions(made, f"{root}/archive")
    return t.spark.read.parquet(f"{root}/archive").withColumn("run_date", F.col("run_date").cast("string"))


# --- fits whose rows are known -------------------------------------------------------------
# One tree of one cut has a closed form: the cut of largest gain among all values of all features.

_STUMP_TARGETS = ["l_extendedprice", "l_extendedprice * (1 - l_discount)", "l_quantity * l_tax * 100"]
_STUMP_FEATURES = ["l_quantity", "round(l_discount * 100)", "round(l_tax * 100)"]
_HALVES = [f"s{h}" for h in S.HORIZONS]
_CUTS = "WITH rows AS (SELECT " + ", ".join(
    [f"CAST({f} AS DOUBLE) AS f{i}" for i, f in enumerate(_STUMP_FEATURES)]
    + [f"CAST({y} AS DOUBLE) AS y{h}" for h, y in zip(S.HORIZONS, _STUMP_TARGETS)]) + """ FROM lineitem),
  base AS (SELECT avg(y1) AS b1, avg(y2) AS b2, avg(y3) AS b3 FROM rows), sums AS (""" + " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS feature, f{i} AS cut, count(*) AS n, sum(y1 - b1) AS s1, sum(y2 - b2) AS s2, sum(y3 - b3) AS s3 "
    f"FROM rows, base GROUP BY f{i}" for i in range(len(_STUMP_FEATURES))) + """),
  cuts AS (SELECT feature, cut, sum(n) OVER w AS n, """ + ", ".join(f"sum({s}) OVER w AS {s}" for s in _HALVES) + """,
    sum(n) OVER v AS all_n, """ + ", ".join(f"sum({s}) OVER v AS all_{s}" for s in _HALVES) + """ FROM sums
    WINDOW w AS (PARTITION BY feature ORDER BY cut), v AS (PARTITION BY feature)),
  sides AS (SELECT * FROM cuts WHERE n < all_n)"""


def _stump_gain(sums: list[str], penalty: float) -> str:
    return " + ".join(f"pow({s}, 2) / (n + {penalty}) + pow(all_{s} - {s}, 2) / (all_n - n + {penalty}) "
                      f"- pow(all_{s}, 2) / (all_n + {penalty})" for s in sums)


def _stump_sql(rate: float, penalty: float, joint: bool) -> str:
    def best(h: int) -> str:
        sums = _HALVES if joint else [f"s{h}"]
        return (f"SELECT {h}::BIGINT AS horizon, feature, cut, b{h} + {rate} * s{h} / (n + {penalty}) AS low, "
                f"b{h} + {rate} * (all_s{h} - s{h}) / (all_n - n + {penalty}) AS high FROM base, "
                f"(SELECT * FROM sides ORDER BY {_stump_gain(sums, penalty)} DESC LIMIT 1)")
    return f"{_CUTS}, best AS ({' UNION ALL '.join(f'({best(h)})' for h in S.HORIZONS)})"


def _stumps(t: Tables, settings: Settings) -> list[Model]:
    rows = t.table("lineitem").select(
        "l_orderkey", "l_linenumber", *[F.expr(f"cast({f} as double)").alias(f"f{i}") for i, f in enumerate(_STUMP_FEATURES)],
        *[F.expr(f"cast({y} as double)").alias(target) for y, target in zip(_STUMP_TARGETS, S.TARGETS)])
    ready = materialize(training.assemble(rows, ["f0", "f1", "f2"]))
    return Learner(settings).fit(ready, S.TARGETS, S.PREDICTIONS, ["l_orderkey", "l_linenumber"])


def _stump_rows(t: Tables, settings: Settings) -> DataFrame:
    """The cut of each horizon's tree, and what the model says on either side of it."""
    rows = []
    for h, model in zip(S.HORIZONS, _stumps(t, settings)):
        c = model.content
        (tree,) = c["trees"]
        rows.append((h, tree["feature"][1], tree["cut"][1], *(c["base"] + c["rate"] * v for v in tree["value"][2:4])))
    return t.spark.createDataFrame(rows, "horizon bigint, feature bigint, cut double, low double, high double")


_STUMP_OUT = "SELECT horizon, feature, round(cut + 1e-9, 4) AS cut, round(low + 1e-9, 4) AS low, round(high + 1e-9, 4) AS high FROM best"


@query("second_order_stump", f"{_stump_sql(0.05, 1.0, False)} {_STUMP_OUT}")
def second_order_stump(t: Tables) -> DataFrame:
    return _stump_rows(t, Settings(1, 1, 0.05, penalty=1.0))


@query("gradient_stump", f"{_stump_sql(0.05, 0.0, False)} {_STUMP_OUT}")
def gradient_stump(t: Tables) -> DataFrame:
    return _stump_rows(t, Settings(1, 1, 0.05))


@query("joint_stump", f"{_stump_sql(1.0, 0.0, True)} {_STUMP_OUT}")
def joint_stump(t: Tables) -> DataFrame:
    """One tree of a joint forest on all rows: one cut serves the three horizons."""
    return _stump_rows(t, Settings(1, 1, joint=True, bootstrap=False))


@query("stump_importance", f"""{_stump_sql(0.05, 1.0, False)} SELECT 'f' || k AS feature, k + 1 AS position,
  round(count(best.feature) / 3.0 + 1e-9, 4) AS importance, 'f' || k AS label FROM range(3) AS r(k)
  LEFT JOIN best ON best.feature = k GROUP BY k""")
def stump_importance(t: Tables) -> DataFrame:
    """A tree of one cut gives all importance to its feature."""
    return training.mean_importance(t.spark, _stumps(t, Settings(1, 1, 0.05, penalty=1.0)), ["f0", "f1", "f2"])


# An index that never changes: every model must say so, whatever its rounds.
_CONSTANT = 70.0


def _constant(t: Tables) -> DataFrame:
    return materialize(t.readings.withColumn("aqi", F.lit(_CONSTANT)))


@query("compare_constant", """SELECT * FROM (VALUES ('XGBoost', 1::BIGINT), ('RandomForest', 2), ('GradientBoosting', 3),
  ('LinearRegression', 4)) AS v(model, position), (SELECT 0.0::DOUBLE AS mae, 0.0::DOUBLE AS rmse, 0.0::DOUBLE AS prediction_std)""")
def compare_constant(t: Tables) -> DataFrame:
    frame = training.training_frame(_constant(t), targets="fixed")
    ranked = evaluate.rank_models(training.compare_models(frame, training.candidate_models(20, 20, 20)).metrics)
    return ranked.select("model", "position", *[F.abs(c).alias(c) for c in ("mae", "rmse", "prediction_std")])


@query("forecast_constant", _labelled_sql(f"CAST({int(_CONSTANT)} AS BIGINT)"))
def forecast_constant(t: Tables) -> DataFrame:
    """Trained, registered, loaded, forecast, archived twice and read back."""
    root = scratch_path(t.spark, "registry")
    readings = _constant(t)
    training.train_and_register(readings, root, "predictor", targets="fixed", candidates={
        "GradientBoosting": training.candidate_models(boosting_rounds=20)["GradientBoosting"]})
    models, names = forecasting.load_serving_models(t.spark, root, "predictor")
    made = forecasting.forecast(readings, models, names, F.lit(_RUN_DATE).cast("date"))
    for _ in range(2):
        tables.archive_predictions(made, f"{root}/archive")
    return t.spark.read.parquet(f"{root}/archive").withColumn("run_date", F.col("run_date").cast("string"))


@query("registered_runs", f"""WITH {Q.COMPLETE}, n AS (SELECT count(DISTINCT city) AS cities FROM complete)
  SELECT 'predictor-' || k AS name, v AS version, position, feature FROM n, range(cities) AS c(k), range(1, 3) AS r(v),
  (VALUES {', '.join(f"({i + 1}::BIGINT, '{name}')" for i, name in enumerate(Q.FEATURE_NAMES))}) AS f(position, feature)""")
def registered_runs(t: Tables) -> DataFrame:
    """One model name per station, each registered twice: versions count up per name, and each has its feature list."""
    root = scratch_path(t.spark, "registry")
    complete = training.training_frame(t.readings, targets="fixed")
    cities = complete.select(CITY).distinct().count()
    for k in range(cities):
        for _ in range(2):
            version = tables.register_run(t.spark, root, f"predictor-{k}", {"mae": 1.0}, "multi-output", [])
            tables.write_feature_list(t.spark, training.feature_columns(complete),
                                      tables.feature_list_path(root, f"predictor-{k}", version))
    lists = [t.spark.createDataFrame([(r["name"], r["version"], tables.read_feature_list(
        t.spark, tables.feature_list_path(root, r["name"], r["version"])))], "name string, version bigint, names array<string>")
        for r in tables.read_runs(t.spark, root).collect()]
    return reduce(DataFrame.unionByName, lists).select(
        "name", "version", F.posexplode("names").alias("position", "feature")).withColumn("position", F.col("position") + 1)
