"""One row per key, newest rows, and keyed appends.

``row_number() <= n`` lets Spark drop surplus rows per map task before the shuffle, so a key that
holds a large share of the input sends at most ``n`` rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationcast import schema as S


def keep_first(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rn") <= n).drop("_rn")


def dedup_readings(df: DataFrame, keys: list[str] = S.KEY) -> DataFrame:
    """One row per station and time. The other columns break ties, so the survivor is always the same;
    a value wins over a missing one."""
    return keep_first(df, keys, [F.col(c).asc_nulls_last() for c in df.columns if c not in keys])


def concat_features(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def append_dedup(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows, then new ones; per key (to the second) the first one stays."""
    rank = "_source"
    both = concat_features(existing.withColumn(rank, F.lit(0)), new.withColumn(rank, F.lit(1)))
    both = both.withColumn(S.TIME, F.date_trunc("second", F.col(S.TIME)))
    ties = [F.col(c).asc_nulls_last() for c in both.columns if c not in (*S.KEY, rank)]
    return keep_first(both, S.KEY, [F.col(rank), *ties]).drop(rank)


def chronological(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col(S.TIME).asc(), F.col(S.STATION).asc())


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col(S.TIME).desc(), F.col(S.STATION).asc())


def head(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows by station and time."""
    return df.orderBy(*S.KEY).limit(n)


def latest_row(df: DataFrame) -> DataFrame:
    """The newest row of every station, as an aggregate that combines on the map side."""
    rest = [c for c in df.columns if c not in S.KEY]
    newest = df.groupBy(S.STATION).agg(F.max(F.struct(S.TIME, *rest)).alias("_row"))
    return newest.select(S.STATION, "_row.*").select(df.columns)


def recent_rows(df: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows of every station."""
    return keep_first(df, [S.STATION], [F.col(S.TIME).desc()], n)
