"""Casting, missing values and calendar columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationcast import schema as S

KEY_FORMAT = "yyyy-MM-dd HH:mm:ss"
DAY_FORMAT = "yyyy-MM-dd"


def to_number(value: Column) -> Column:
    """Double, or null for text that is no number and for NaN (Spark's aggregates keep NaN)."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def coerce_numeric(df: DataFrame, columns: list[str] = S.NUMERIC) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: to_number(F.col(c)) for c in present})


def coerce_int(df: DataFrame, columns: list[str] = S.CALENDAR) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.col(c).cast("bigint") for c in present})


def parse_timestamp(value: Column) -> Column:
    """Timestamp, or null for text that is none."""
    return F.try_to_timestamp(value)


def with_time(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def without_time(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """The rows to quarantine: without a time there is neither a key nor a calendar."""
    return df.where(F.col(column).isNull()).withColumn("reason", F.lit(f"no {column}"))


def with_key(df: DataFrame) -> DataFrame:
    """Rows that have a station and an ingestion time, and so can be stored."""
    return df.na.drop("any", subset=S.KEY)


def without_key(df: DataFrame) -> DataFrame:
    missing = F.col(S.STATION).isNull() | F.col(S.TIME).isNull()
    return df.where(missing).withColumn("reason", F.lit("no key"))


def zero_fill(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing numbers become 0; text stays as it is."""
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return df.na.fill(0.0, [c for c in columns if c in df.columns])


def time_features(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """hour, day, month and day_of_week with Monday = 0."""
    ts = F.col(column)
    return df.withColumns({
        "hour": F.hour(ts).cast("bigint"),
        "day": F.dayofmonth(ts).cast("bigint"),
        "month": F.month(ts).cast("bigint"),
        "day_of_week": F.weekday(ts).cast("bigint"),
    })


def co_to_mg(co: Column) -> Column:
    """Micrograms to milligrams per cubic metre."""
    return co / F.lit(1000.0)


def stamp_ingestion(df: DataFrame, now: Column | None = None) -> DataFrame:
    """The run's clock, to the second. Pass ``now`` to replay a run."""
    clock = F.current_timestamp() if now is None else now
    return df.withColumn(S.TIME, F.date_trunc("second", clock))


def placeholder_targets(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Training derives its targets by shifting; the stored columns only keep the schema."""
    later = F.col(column) + F.expr("INTERVAL 3 DAYS")
    return df.withColumns({"target_aqi": F.lit(0.0), "target_day": F.date_format(later, DAY_FORMAT)})


def format_key_ts(ts: Column) -> Column:
    return F.date_format(ts, KEY_FORMAT)


def conform(df: DataFrame) -> DataFrame:
    """The reading columns, in table order and type; absent ones become null."""
    # Columns that fit already stay untouched: a renaming no-op would keep Spark from reusing a shuffle.
    fits = {f.name for f in df.schema if f.name in S.READING.names and f.dataType == S.READING[f.name].dataType}
    return df.select([
        F.col(f.name) if f.name in fits
        else (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in S.READING
    ])


# --- filters -------------------------------------------------------------------------------

def only_city(df: DataFrame, *names: str) -> DataFrame:
    """Exact match, so that a stale source under a similar name stays out."""
    if S.STATION not in df.columns:
        return df
    return df.where(F.col(S.STATION).isin(*names))


def drop_zero_weather(df: DataFrame) -> DataFrame:
    return df.where(F.col("temperature") > 0)


def require_aqi(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["aqi"])


def require_targets(df: DataFrame) -> DataFrame:
    return df.na.drop("any", subset=S.TARGETS)


def require_features(df: DataFrame) -> DataFrame:
    return df.na.drop("any", subset=feature_columns(df))


# --- column lists --------------------------------------------------------------------------

def numeric_columns(df: DataFrame, drop: list[str] = S.NOT_CORRELATED) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in drop]


def feature_columns(df: DataFrame) -> list[str]:
    """Everything that is not identity, time or target, in schema order."""
    return [c for c in df.columns if c not in S.NOT_FEATURES]


def align_features(df: DataFrame, names: list[str] | None, keep: list[str] = ()) -> DataFrame:
    """The training columns in training order; a column the frame lacks is 0, a null stays null."""
    names = names or feature_columns(df)
    aligned = [(F.col(c) if c in df.columns else F.lit(0.0)).alias(c) for c in names]
    return df.select(*keep, *aligned)
