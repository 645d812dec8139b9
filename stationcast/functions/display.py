"""Labels and formatted values for people."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcast import schema as S


def display_label(name: Column, labels: dict[str, str] = S.FEATURE_LABELS) -> Column:
    """The human label of a column name; a name without one is shown as it is."""
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(labels.items())])
    return F.coalesce(F.try_element_at(known, name), name)


def _by_category(aqi: Column, field: int) -> Column:
    bounded = S.CATEGORIES[:-1]
    chosen = F.when(aqi.isNull(), F.lit(None).cast("string"))
    for row in bounded:
        chosen = chosen.when(aqi <= row[0], F.lit(row[field]))
    return chosen.otherwise(F.lit(S.CATEGORIES[-1][field]))


def aqi_category(aqi: Column) -> dict[str, Column]:
    """label, css_class, pill_class and advice of an index value; upper bounds are inclusive."""
    names = ["label", "css_class", "pill_class", "advice"]
    return {name: _by_category(aqi, i + 1) for i, name in enumerate(names)}


def finalize_prediction(prediction: Column) -> Column:
    """Nearest whole number, halves to even, never below 0."""
    whole = F.greatest(F.lit(0.0), F.rint(prediction)).cast("bigint")
    return F.when(prediction.isNotNull(), whole)


def horizon_label(horizon: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in S.HORIZON_LABELS]), horizon.cast("int"))


def horizon_date(run_date: Column, horizon: Column) -> Column:
    return F.date_format(F.date_add(run_date, horizon.cast("int")), "EEE, MMM dd")


def weekday_name(day_of_week: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in S.WEEKDAYS]), day_of_week.cast("int") + 1)


def _metric(value: Column, digits: int, suffix: str) -> Column:
    # format_string rounds halves up, so the halves-to-even step comes first.
    shown = F.format_string(f"%.{digits}f{suffix}", F.bround(value, digits))
    return F.when(value.isNotNull(), shown).otherwise(F.lit("N/A"))


def condition_cards(latest: DataFrame) -> DataFrame:
    """Five (card, value) rows per station; a missing column counts as 0, a missing value as N/A."""
    cards = [("AQI Now", "aqi", 0, ""), ("PM 2.5", "pm25", 1, ""), ("Temperature", "temperature", 1, "°C"),
             ("Humidity", "humidity", 0, "%%"), ("Wind Speed", "wind_speed", 1, " m/s")]

    def value(name: str) -> Column:
        return F.col(name) if name in latest.columns else F.lit(0.0)

    rows = [F.struct(F.lit(i + 1).cast("bigint").alias("position"), F.lit(card).alias("card"),
                     _metric(value(name), digits, suffix).alias("value"))
            for i, (card, name, digits, suffix) in enumerate(cards)]
    return latest.select(S.STATION, F.inline(F.array(*rows)))


def model_display_name(model_class: Column, inner_class: Column) -> Column:
    """Known estimators by label; a wrapper around one estimator per target names what it wraps."""
    wrapped = F.concat(F.lit("Multi-Output "), F.coalesce(inner_class, F.lit("Ensemble")))
    return (F.when(model_class == S.MULTI_OUTPUT_CLASS, wrapped)
            .otherwise(display_label(model_class, S.MODEL_LABELS)))
