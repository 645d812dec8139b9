"""Row-based lags, rolling windows and leads over each station's series.

A window over a whole station would put the station with the most rows into one task. Instead a
series is cut into blocks of ``block_days`` and windowed per (station, block). Only rows near a block
border need neighbours from other blocks: those rows, with just enough of their surroundings, go
through a second window per station. That second window sees a fixed number of rows per block, so its
size depends on the time span and not on how many rows a station has. Daily rows want blocks of years
(``block_days``), or every row is near a border.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stationcast import schema as S
from stationcast.session import materialize

BLOCK_DAYS = 90
DAY = 24
DEFAULT_ROWS_PER_DAY = 24
_BLOCK, _ROW = "_block", "_row"


def with_block(df: DataFrame, block_days: int = BLOCK_DAYS) -> DataFrame:
    return df.withColumn(_BLOCK, F.floor(F.unix_seconds(S.TIME) / F.lit(86400 * block_days)))


def _station_window() -> WindowSpec:
    return Window.partitionBy(S.STATION).orderBy(S.TIME)


def _block_window() -> WindowSpec:
    return Window.partitionBy(S.STATION, _BLOCK).orderBy(S.TIME)


def _within(first: int, last: int, w: WindowSpec) -> Column:
    """True for the first ``first`` and the last ``last`` rows of a window partition."""
    at_start = F.lag(S.TIME, first).over(w).isNull() if first else F.lit(False)
    at_end = F.lead(S.TIME, last).over(w).isNull() if last else F.lit(False)
    return at_start | at_end


def _over_blocks(blocked: DataFrame, columns: Callable[[WindowSpec], dict[str, Column]],
                 reach: Callable[[Callable[[int, int], Column]], Column]) -> DataFrame:
    """``reach`` applies a test of (rows back, rows ahead) to what the columns of a row need."""
    inner = _block_window()
    marked = blocked.withColumns({
        "_border": reach(lambda back, ahead: _within(back, ahead, inner)),
        "_near_border": reach(lambda back, ahead: _within(back + ahead, back + ahead, inner)),
    })
    inside = marked.withColumns(columns(inner)).where(~F.col("_border"))
    border = (marked.where(F.col("_near_border")).withColumns(columns(_station_window()))
              .where(F.col("_border")))
    return inside.unionByName(border).drop(_BLOCK, "_border", "_near_border")


def over_series(df: DataFrame, columns: Callable[[WindowSpec], dict[str, Column]], before: int,
                after: int, block_days: int = BLOCK_DAYS) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``df`` holds one row per station and time. A block should hold many times ``before + after`` rows,
    as only then few rows are near a border; and it must fit one task, which it does when times are
    unique to the second (86,400 rows a day at most).
    """
    return _over_blocks(with_block(df, block_days), columns, lambda test: test(before, after))


def rolling(aggregate: Callable[[Column], Column], value: str, rows: int, min_rows: int,
            w: WindowSpec) -> Column:
    """Aggregate of the last ``rows`` rows, if at least ``min_rows`` of them have a value."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(frame) >= min_rows, aggregate(F.col(value)).over(frame))


def lag_columns(w: WindowSpec) -> dict[str, Column]:
    return {f"aqi_lag_{h}h": F.lag("aqi", h).over(w) for h in (DAY, 2 * DAY, 3 * DAY)}


def rolling_columns(w: WindowSpec) -> dict[str, Column]:
    return {
        "aqi_rolling_mean_24h": rolling(F.avg, "aqi", DAY, 12, w),
        "aqi_rolling_std_24h": rolling(F.stddev_samp, "aqi", DAY, 12, w),
        "aqi_rolling_mean_72h": rolling(F.avg, "aqi", 3 * DAY, 36, w),
    }


def trend_columns(w: WindowSpec) -> dict[str, Column]:
    return {"aqi_diff_24h": F.col("aqi") - F.lag("aqi", DAY).over(w)}


def sensor_rolling_columns(w: WindowSpec) -> dict[str, Column]:
    return {
        "pm25_rolling_mean_24h": rolling(F.avg, "pm25", DAY, 12, w),
        "wind_speed_rolling_mean_24h": rolling(F.avg, "wind_speed", DAY, 12, w),
    }


def feature_window_columns(w: WindowSpec) -> dict[str, Column]:
    return {**lag_columns(w), **rolling_columns(w), **trend_columns(w), **sensor_rolling_columns(w)}


def fixed_target_columns(w: WindowSpec, rows_per_day: int = DAY) -> dict[str, Column]:
    return {name: F.lead("aqi", rows_per_day * h).over(w) for name, h in zip(S.TARGETS, S.HORIZONS)}


def lag_features(df: DataFrame, block_days: int = BLOCK_DAYS) -> DataFrame:
    return over_series(df, lag_columns, 3 * DAY, 0, block_days)


def series_features(df: DataFrame, block_days: int = BLOCK_DAYS) -> DataFrame:
    """All lag, rolling and trend features."""
    return over_series(df, feature_window_columns, 3 * DAY, 0, block_days)


def targets_fixed(df: DataFrame, block_days: int = BLOCK_DAYS) -> DataFrame:
    """The value 24, 48 and 72 rows ahead."""
    return over_series(df, fixed_target_columns, 0, 3 * DAY, block_days)


def features_and_fixed_targets(df: DataFrame, block_days: int = BLOCK_DAYS) -> DataFrame:
    """Features and fixed targets from the same windows."""
    return over_series(df, lambda w: {**feature_window_columns(w), **fixed_target_columns(w)},
                       3 * DAY, 3 * DAY, block_days)


def row_gap(df: DataFrame, block_days: int = BLOCK_DAYS) -> DataFrame:
    """Seconds since the station's previous row."""
    def gap(w: WindowSpec) -> dict[str, Column]:
        previous = F.lag(S.TIME, 1).over(w)
        return {"gap_seconds": F.unix_seconds(S.TIME) - F.unix_seconds(previous)}
    return over_series(df, gap, 1, 0, block_days)


def rows_per_day(median_gap_hours: Column) -> Column:
    """Rows that make a day at this cadence, halves to even, at least 1 and at most 240."""
    # greatest() skips nulls, so a station without a gap is handled first.
    rows = F.greatest(F.lit(1.0), F.rint(F.lit(24.0) / F.greatest(median_gap_hours, F.lit(0.1))))
    return (F.when(median_gap_hours.isNull(), F.lit(DEFAULT_ROWS_PER_DAY)).otherwise(rows)).cast("bigint")


def _gaps(keys: DataFrame, block_days: int) -> DataFrame:
    """Seconds between successive rows; null for a station's first row."""
    seconds = F.unix_seconds(S.TIME)

    keys = with_block(keys, block_days)
    within = keys.select(S.STATION, (seconds - F.lag(seconds, 1).over(_block_window())).alias("gap_seconds"))
    blocks = keys.groupBy(S.STATION, _BLOCK).agg(F.min(seconds).alias("_first"), F.max(seconds).alias("_last"))
    by_block = Window.partitionBy(S.STATION).orderBy(_BLOCK)
    between = blocks.select(S.STATION, (F.col("_first") - F.lag("_last", 1).over(by_block)).alias("gap_seconds"))
    # The first row of a block has its gap in `between`.
    return within.where(F.col("gap_seconds").isNotNull()).unionByName(between)


def median_cadence(df: DataFrame, block_days: int = BLOCK_DAYS) -> DataFrame:
    """Per station: exact median gap in hours and the rows per day it means (24 for a single row).

    Gaps are counted before the median. Distinct gaps of a station add up to at most its time span,
    so even twenty years at one-second resolution leave fewer than 40,000 of them.
    """
    gaps = (_gaps(df.select(*S.KEY), block_days)
            .groupBy(S.STATION, "gap_seconds").agg(F.count(F.lit(1)).alias("times")))
    median = F.percentile(F.col("gap_seconds"), F.lit(0.5), F.col("times")) / F.lit(3600.0)
    cadence = gaps.groupBy(S.STATION).agg(median.alias("median_gap_hours"))
    return cadence.withColumn("rows_per_day", rows_per_day(F.col("median_gap_hours")))


def over_series_by_cadence(df: DataFrame, columns: Callable[[WindowSpec], dict[str, Column]], before: int,
                           block_days: int = BLOCK_DAYS) -> DataFrame:
    """``over_series`` plus the targets ``rows_per_day * n`` rows ahead, n = 1..3, at each station's own
    cadence.

    A row's number in its series is its number in its block plus the rows of all earlier blocks. Every row
    goes, as narrow as it can be, to the three rows it is a target of, and these meet by (station, row
    number). So the plan is the same for any number of cadences, and a long series is spread over all tasks.
    """
    narrow = df.select(*S.KEY, "aqi")
    counted = with_block(narrow, block_days).groupBy(S.STATION, _BLOCK).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(S.STATION).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # One row per station and block.
    blocks = materialize(
        counted.select(S.STATION, _BLOCK, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
        .join(median_cadence(narrow, block_days).select(S.STATION, "rows_per_day"), S.STATION))

    def numbered(rows: DataFrame) -> DataFrame:
        return (with_block(rows, block_days).join(blocks, [S.STATION, _BLOCK])
                .withColumn(_ROW, F.col("_before") + F.row_number().over(_block_window())).drop("_before"))

    steps = F.array(*[F.struct((F.col(_ROW) - h * F.col("rows_per_day")).alias("_for"), F.lit(h).alias("_h"))
                      for h in S.HORIZONS])
    ahead = (numbered(narrow).select(S.STATION, "aqi", F.inline(steps)).where("_for > 0")
             .groupBy(S.STATION, F.col("_for").alias(_ROW))
             .agg(*[F.max(F.when(F.col("_h") == h, F.col("aqi"))).alias(name)
                    for name, h in zip(S.TARGETS, S.HORIZONS)]))
    return _over_blocks(numbered(df), columns, lambda test: test(before, 0)).join(
        ahead, [S.STATION, _ROW], "left").drop(_ROW)


def targets_by_cadence(df: DataFrame, block_days: int = BLOCK_DAYS) -> DataFrame:
    """The three targets at each station's cadence, and the cadence as ``rows_per_day``."""
    return over_series_by_cadence(df, lambda w: {}, 0, block_days)


def features_and_cadence_targets(df: DataFrame, block_days: int = BLOCK_DAYS) -> DataFrame:
    """Features and cadence targets from the same windows."""
    return over_series_by_cadence(df, feature_window_columns, 3 * DAY, block_days).drop("rows_per_day")
