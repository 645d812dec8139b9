"""Summaries, histograms, density, correlation and profiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcast import schema as S
from stationcast.functions.cleaning import drop_zero_weather
from stationcast.operators import profiles, stats
from workloads import sql as Q
from workloads.registry import query
from workloads.tables import Tables


def _each(template: str, columns: list[str]) -> str:
    return " UNION ALL ".join(template.format(c=c, i=i + 1) for i, c in enumerate(columns))


_DESCRIBE = """SELECT {i}::BIGINT AS position, '{c}' AS feature, count({c}) AS count, round(avg({c}) + 1e-9, 4) AS mean,
  round(stddev_samp({c}) + 1e-9, 4) AS std, round(min({c}) + 1e-9, 4) AS min,
  round(quantile_cont({c}, 0.25) + 1e-9, 4) AS q25, round(quantile_cont({c}, 0.5) + 1e-9, 4) AS q50,
  round(quantile_cont({c}, 0.75) + 1e-9, 4) AS q75, round(max({c}) + 1e-9, 4) AS max FROM """


@query("describe", f"WITH {Q.CLEAN} {_each(_DESCRIBE + 'clean', [*S.MEASURES, *S.CALENDAR])}")
def describe(t: Tables) -> DataFrame:
    return stats.describe(drop_zero_weather(t.readings), [*S.MEASURES, *S.CALENDAR])


@query("describe_nullable", f"WITH {Q.RAW} {_each(_DESCRIBE + 'raw', S.MEASURES)}")
def describe_nullable(t: Tables) -> DataFrame:
    return stats.describe(t.raw, S.MEASURES)


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_lineitem", _each(_DESCRIBE + "lineitem", _LINE))
def describe_lineitem(t: Tables) -> DataFrame:
    """A whole fact table."""
    return stats.describe(t.table("lineitem"), _LINE)


_TYPES = {"city": "string", "timestamp": "timestamp", "ingestion_timestamp": "timestamp",
          **{c: "double" for c in S.MEASURES}, **{c: "bigint" for c in S.CALENDAR},
          "target_aqi": "double", "target_day": "string"}
_INFO = " UNION ALL ".join(f"SELECT {i + 1}::BIGINT AS position, '{c}' AS column_name, '{d}' AS dtype, "
                           f'count("{c}") AS non_null FROM nullable' for i, (c, d) in enumerate(_TYPES.items()))


@query("column_info", f"WITH {Q.NULLABLE} {_INFO}")
def column_info(t: Tables) -> DataFrame:
    return stats.column_info(t.nullable)


@query("null_profile", f"WITH {Q.RAW} " + _each(
    "SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, "
    "round((count(*) - count({c})) / count(*) + 1e-9, 4) AS share FROM raw", S.MEASURES))
def null_profile(t: Tables) -> DataFrame:
    return stats.null_profile(t.raw, S.MEASURES)


@query("null_profile_daily", f"WITH {Q.RAW} " + _each(
    "SELECT strftime(ingestion_timestamp, '%Y-%m-%d') AS part, '{c}' AS column_name, count(*) - count({c}) AS nulls, "
    "round((count(*) - count({c})) / count(*) + 1e-9, 4) AS share FROM raw GROUP BY 1", S.MEASURES))
def null_profile_daily(t: Tables) -> DataFrame:
    return stats.null_profile(t.raw, S.MEASURES, by=F.date_format(S.TIME, "yyyy-MM-dd"))


@query("range_stats", f"""WITH {Q.RAW} SELECT count(*) AS n_rows, min(ingestion_timestamp) AS first_time,
  max(ingestion_timestamp) AS last_time, round(avg(aqi) + 1e-9, 4) AS aqi_mean,
  round(stddev_samp(aqi) + 1e-9, 4) AS aqi_std, round(min(aqi) + 1e-9, 4) AS aqi_min,
  round(max(aqi) + 1e-9, 4) AS aqi_max FROM raw""")
def range_stats(t: Tables) -> DataFrame:
    return stats.range_stats(t.raw)


def _histogram_sql(ctes: str, source: str, columns: list[str]) -> str:
    values = _each(f"SELECT '{{c}}' AS feature, {{c}} AS x FROM {source} WHERE {{c}} IS NOT NULL", columns)
    return f"""{ctes} long AS ({values}),
  spec AS (SELECT feature, count(*) AS n, min(x) AS low, max(x) AS high,
    quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM long GROUP BY 1),
  sized AS (SELECT feature, n, CASE WHEN low = high THEN low - 0.5 ELSE low END AS low,
    CASE WHEN low = high THEN high + 0.5 ELSE high END AS high, CASE WHEN low = high THEN 1 ELSE
    CAST(ceil((high - low) / least(greatest(2.0 * iqr / pow(n, 1.0 / 3.0), (high - low) / sqrt(n) / 2.0),
    (high - low) / (log2(n) + 1.0))) AS BIGINT) END AS bins FROM spec),
  edges AS (SELECT feature, bins, CAST(bin AS BIGINT) AS bin, low + bin * ((high - low) / bins) AS left_edge,
    CASE WHEN bin + 1 = bins THEN high ELSE low + (bin + 1) * ((high - low) / bins) END AS right_edge
    FROM (SELECT *, unnest(range(bins)) AS bin FROM sized))
  SELECT e.feature, e.bin, round(left_edge + 1e-9, 4) AS left_edge, round(right_edge + 1e-9, 4) AS right_edge,
  count(l.x) AS n FROM edges e LEFT JOIN long l ON l.feature = e.feature AND l.x >= left_edge
    AND (l.x < right_edge OR (bin + 1 = bins AND l.x <= right_edge)) GROUP BY 1, 2, 3, 4"""


@query("histogram", _histogram_sql(f"WITH {Q.CLEAN},", "clean", S.MEASURES))
def histogram(t: Tables) -> DataFrame:
    return stats.histogram(drop_zero_weather(t.readings), S.MEASURES)


@query("histogram_lineitem", _histogram_sql("WITH", "lineitem", _LINE))
def histogram_lineitem(t: Tables) -> DataFrame:
    return stats.histogram(t.table("lineitem"), _LINE)


def _density_sql(ctes: str, source: str, columns: list[str]) -> str:
    values = _each(f"SELECT '{{c}}' AS feature, {{c}} AS x FROM {source} WHERE {{c}} IS NOT NULL", columns)
    return f"""{ctes} long AS ({values}),
  spec AS (SELECT feature, count(*) AS n, min(x) AS low, (max(x) - min(x)) / 199 AS step,
    stddev_samp(x) * pow(count(*), -0.2) AS h FROM long GROUP BY 1),
  grid AS (SELECT *, CAST(unnest(range(200)) AS BIGINT) AS point FROM spec WHERE h > 0)
  SELECT g.feature, point, round(low + point * step + 1e-9, 4) AS x,
  round(sum(exp(-0.5 * pow((low + point * step - l.x) / h, 2))) / (n * h * {math.sqrt(2 * math.pi)!r}) + 1e-9, 4) AS density
  FROM grid g JOIN long l USING (feature) GROUP BY g.feature, point, low, step, n, h"""


@query("density_curve", _density_sql(f"WITH {Q.CLEAN},", "clean", S.MEASURES))
def density_curve(t: Tables) -> DataFrame:
    return stats.density_curve(drop_zero_weather(t.readings), S.MEASURES)


def _corr_sql(ctes: str, source: str, columns: list[str]) -> str:
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, " + (f"CASE WHEN var_pop({a}) > 0 THEN 1.0 END" if a == b else
                                              f"round(corr({a}, {b}) + 1e-9, 4)")
        + f" AS r FROM {source}" for a in columns for b in columns)
    return f"{ctes} {pairs}"


@query("correlation_matrix", _corr_sql(f"WITH {Q.CLEAN}", "clean", S.MEASURES))
def correlation_matrix(t: Tables) -> DataFrame:
    return stats.correlation_matrix(drop_zero_weather(t.readings), S.MEASURES)


@query("correlation_matrix_nullable", _corr_sql(f"WITH {Q.RAW}", "raw", S.MEASURES))
def correlation_matrix_nullable(t: Tables) -> DataFrame:
    return stats.correlation_matrix(t.raw, S.MEASURES)


# The resampling weights, as integer arithmetic both engines share.
def _mix(x: str) -> str:
    return f"(({x}) * ({x})) % {profiles._PRIME}"


_START = f"(seed + replicate * 7368787) % {profiles._PRIME}"
_U = f"(({_mix('m1 + replicate + 104729')}) * 48271 % {profiles._PRIME}) / {float(profiles._PRIME)!r}"
_WEIGHT = "CASE " + " ".join(f"WHEN u < {p!r} THEN {k}" for k, p in enumerate(profiles._POISSON_CDF)) + \
    f" ELSE {len(profiles._POISSON_CDF)} END"


@query("diurnal_profile", f"""WITH {Q.CLEAN}, seeded AS (SELECT hour, aqi, ('0x' || substr(md5(concat_ws('|', city,
    strftime(ingestion_timestamp, '%Y-%m-%d %H:%M:%S'))), 1, 8))::BIGINT % {profiles._PRIME} AS seed FROM clean),
  drawn AS (SELECT *, unnest(range(1, 1001))::BIGINT AS replicate FROM seeded),
  started AS (SELECT *, {_START} AS s0 FROM drawn), mixed AS (SELECT *, {_mix('s0')} AS m1 FROM started),
  uniform AS (SELECT *, {_U} AS u FROM mixed), weighted AS (SELECT *, {_WEIGHT} AS w FROM uniform),
  means AS (SELECT hour, replicate, sum(w * aqi) / sum(w) AS m FROM weighted WHERE w > 0 GROUP BY 1, 2),
  ci AS (SELECT hour, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM means GROUP BY 1),
  hours AS (SELECT hour, avg(aqi) AS aqi_mean, count(aqi) AS n FROM clean GROUP BY 1)
  SELECT hour, {Q.r('aqi_mean')}, n, {Q.r('ci_low', 'ci_high')} FROM hours LEFT JOIN ci USING (hour)""")
def diurnal_profile(t: Tables) -> DataFrame:
    return profiles.diurnal_profile(drop_zero_weather(t.readings))


@query("hour_means", f"""WITH {Q.CLEAN} SELECT hour, round(avg(aqi) + 1e-9, 4) AS aqi_mean, count(aqi) AS n
  FROM clean GROUP BY 1""")
def hour_means(t: Tables) -> DataFrame:
    return profiles.hour_means(drop_zero_weather(t.readings))


_DAY_NAMES = ", ".join(f"'{d}'" for d in S.WEEKDAYS)


@query("weekday_profile", f"""WITH {Q.CLEAN} SELECT day_of_week, round(avg(aqi) + 1e-9, 4) AS aqi_mean, count(aqi) AS n,
  list_value({_DAY_NAMES})[day_of_week + 1] AS weekday FROM clean GROUP BY 1""")
def weekday_profile(t: Tables) -> DataFrame:
    return profiles.weekday_profile(drop_zero_weather(t.readings))


_FITS = [("temperature", "aqi"), ("wind_speed", "aqi")]


@query("linear_fit", f"WITH {Q.CLEAN} " + " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, round(regr_slope({y}, {x}) + 1e-9, 4) AS slope, "
    f"round(regr_intercept({y}, {x}) + 1e-9, 4) AS intercept, round(regr_r2({y}, {x}) + 1e-9, 4) AS r2, "
    f"CAST(regr_count({y}, {x}) AS BIGINT) AS n FROM clean" for x, y in _FITS))
def linear_fit(t: Tables) -> DataFrame:
    return profiles.linear_fit(drop_zero_weather(t.readings), _FITS)
