"""Daily and weekly profiles, and straight-line fits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcast import schema as S
from stationcast.functions.display import weekday_name

# Fixed values of the resampling weights: P(Poisson(1) <= k) for k = 0, 1, ... up to the resolution of the uniform, 2^-31.
_POISSON_CDF = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
                0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
                0.999998874797402, 0.9999998885745217, 0.9999999899522336, 0.9999999991683893,
                0.9999999999364022]
_PRIME = 2147483647


def hour_means(df: DataFrame) -> DataFrame:
    return df.groupBy("hour").agg(F.avg("aqi").alias("aqi_mean"), F.count("aqi").alias("n"))


#: Up to so many equal values are drawn one by one, more of them at once.
SINGLY = 8
#: Mean from which a count is drawn from the normal curve: its steps are then below a thousandth of its spread.
_LARGE = 1 << 20
#: Values whose replicates are drawn at a time.
_TOGETHER = 256


def _uniform(seed: np.ndarray, replicate: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend only on seed and replicate; products stay below 2^62."""
    mixed = (seed + replicate * 7368787) % _PRIME
    mixed = mixed * mixed % _PRIME + replicate + 104729
    mixed = mixed % _PRIME
    return (mixed * mixed % _PRIME * 48271 % _PRIME) / float(_PRIME)


def weights(seed: np.ndarray, count: np.ndarray, replicates: int) -> np.ndarray:
    """How often each of some values is drawn in each replicate, together: Poisson with the value's count as mean.

    That is the sum of the Poisson(1) weights of its rows, drawn singly for few rows and by inversion for many. A row drawn
    for itself has count 1.
    """
    r = np.arange(1, replicates + 1, dtype=np.int64)[None, :]
    out = np.zeros((len(seed), replicates))
    for j in range(SINGLY):
        few = np.flatnonzero((count > j) & (count <= SINGLY))
        if len(few):
            out[few] += np.searchsorted(_POISSON_CDF, _uniform(seed[few, None] + j * 7919, r), side="right")
    for i in np.flatnonzero(count > SINGLY):
        u, mean = _uniform(seed[i:i + 1, None], r)[0], float(count[i])
        if mean >= _LARGE:
            z = np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * _uniform(seed[i:i + 1, None] + 7919, r)[0])
            out[i] = np.rint(mean + np.sqrt(mean) * z + (z * z - 1) / 6)
            continue
        low = max(0, int(mean - 10 * np.sqrt(mean)))
        k = np.arange(low + 1, int(mean + 10 * np.sqrt(mean)) + 20)
        # Chances relative to the first, added up and scaled: what lies outside is below the uniform's resolution.
        chance = np.exp(np.append(0.0, np.cumsum(np.log(mean) - np.log(k))))
        out[i] = low + np.searchsorted(np.cumsum(chance) / chance.sum(), u, side="right")
    return out


def _resampled(batches: Iterator[pa.RecordBatch], replicates: int) -> Iterator[pa.RecordBatch]:
    """One partition's sums of weights and of weighted values per hour and replicate."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        hour, value, seed = (np.asarray(batch.column(c)) for c in ("hour", "aqi", "seed"))
        for lo in range(0, len(hour), _TOGETHER):
            part = slice(lo, lo + _TOGETHER)
            w = weights(seed[part], np.ones(len(seed[part]), dtype=np.int64), replicates)
            for h in np.unique(hour[part]):
                mine = hour[part] == h
                total = sums.setdefault(int(h), np.zeros((2, replicates)))
                total[0] += w[mine].sum(axis=0)
                total[1] += value[part][mine] @ w[mine]
    for h, (w, wx) in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(replicates, h)), pa.array(np.arange(1, replicates + 1)), pa.array(w), pa.array(wx)],
            names=["hour", "replicate", "w", "wx"])


def diurnal_profile(df: DataFrame, replicates: int = 1000, level: float = 95.0) -> DataFrame:
    """Mean index by hour of day with a bootstrap interval.

    Every row is drawn Poisson(1) times per replicate, by its own key's hash, which gives the same interval for any
    partitioning. Each task adds up its rows to at most 24 x replicates sums before the shuffle.
    """
    key = F.concat_ws("|", F.col(S.STATION), F.date_format(S.TIME, "yyyy-MM-dd HH:mm:ss"))
    seed = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % F.lit(_PRIME)
    drawn = (df.where(F.col("aqi").isNotNull() & F.col("hour").isNotNull())
             .select(F.col("hour").cast("long").alias("hour"), F.col("aqi").cast("double").alias("aqi"), seed.alias("seed"))
             # Little data means much arithmetic here, so the partitions must not be merged by their bytes.
             .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seed"))
    means = (drawn.mapInArrow(lambda batches: _resampled(batches, replicates),
                                "hour bigint, replicate bigint, w double, wx double")
             .groupBy("hour", "replicate").agg((F.try_divide(F.sum("wx"), F.sum("w"))).alias("_mean"), F.sum("w").alias("_w"))
             .where("_w > 0"))
    tail = (100.0 - level) / 200.0
    # percentile sees at most `replicates` values per hour.
    interval = (means.groupBy("hour").agg(F.percentile("_mean", [tail, 1.0 - tail]).alias("_ci"))
                .select("hour", F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high")))
    return hour_means(df).join(interval, "hour", "left")


def weekday_profile(df: DataFrame) -> DataFrame:
    means = df.groupBy("day_of_week").agg(F.avg("aqi").alias("aqi_mean"), F.count("aqi").alias("n"))
    return means.withColumn("weekday", weekday_name(F.col("day_of_week")))


def linear_fit(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Least-squares line of y on x per (x, y) pair, all in one pass."""
    wide = df.agg(*[f(F.col(y), F.col(x)).alias(f"{x}__{y}__{name}") for x, y in pairs
                    for name, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept),
                                    ("r2", F.regr_r2), ("n", F.regr_count))])
    rows = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"),
                     *[F.col(f"{x}__{y}__{name}").alias(name) for name in ("slope", "intercept", "r2", "n")])
            for x, y in pairs]
    return wide.select(F.inline(F.array(*rows)))
