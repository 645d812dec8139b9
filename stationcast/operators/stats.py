"""Summaries, histograms, density curves and correlations over whole tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from stationcast import schema as S
from stationcast.operators import quantiles

QUARTILES = [0.25, 0.5, 0.75]
#: Grid points per bandwidth on which densities are added up.
FINE = 250


def _long(df: DataFrame, rows: list[Column]) -> DataFrame:
    return df.select(F.inline(F.array(*rows)))


def _position(columns: list[str], i: int) -> Column:
    return F.lit(i + 1).cast("bigint").alias("position")


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, x) rows, one per column. Aggregating these by ``i`` keeps the generated code small, which
    for many columns is faster than one wide aggregation."""
    return _long(df, [F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x"))
                      for i, c in enumerate(columns)])


def moments(df: DataFrame, columns: list[str]) -> dict[str, Row]:
    """n, mean, std (n-1), min and max per column, in one pass."""
    rows = _values(df, columns).groupBy("i").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max")).collect()
    found = {columns[r["i"]]: r for r in rows}
    empty = Row(n=0, mean=None, std=None, min=None, max=None)
    return {c: found.get(c, empty) for c in columns}


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std (n-1), min, exact quartiles and max: one row per column."""
    m = moments(df, columns)
    quartiles = quantiles.exact_quantiles(df, columns, QUARTILES, {c: m[c]["n"] for c in columns})
    rows = [(i + 1, c, m[c]["n"], m[c]["mean"], m[c]["std"], m[c]["min"], *quartiles[c], m[c]["max"])
            for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(
        rows, "position bigint, feature string, count bigint, mean double, std double, min double, "
              "q25 double, q50 double, q75 double, max double")


def column_info(df: DataFrame) -> DataFrame:
    """Type and non-null count of every column."""
    types = dict(df.dtypes)
    wide = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return _long(wide, [
        F.struct(_position(df.columns, i), F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
                 F.col(c).alias("non_null")) for i, c in enumerate(df.columns)])


def null_profile(df: DataFrame, columns: list[str], by: Column | None = None) -> DataFrame:
    """Null count and share per column, for the whole table or per value of ``by`` (named ``part``)."""
    grouped = df.groupBy() if by is None else df.groupBy(by.alias("part"))
    wide = grouped.agg(F.count(F.lit(1)).alias("_rows"),
                       *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    keep = [] if by is None else ["part"]
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls"),
                     F.try_divide(F.col(c), F.col("_rows")).cast("double").alias("share")) for c in columns]
    return wide.select(*keep, F.inline(F.array(*rows)))


def range_stats(df: DataFrame) -> DataFrame:
    """Row count, first and last time, and the spread of the index."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(S.TIME).alias("first_time"),
                  F.max(S.TIME).alias("last_time"), F.avg("aqi").alias("aqi_mean"),
                  F.stddev_samp("aqi").alias("aqi_std"), F.min("aqi").alias("aqi_min"),
                  F.max("aqi").alias("aqi_max"))


def auto_bins(n: int, low: float, high: float, q25: float, q75: float) -> int:
    """Number of equal bins: the narrower of Sturges and Freedman-Diaconis widths, where the latter
    is held above half the square-root rule's width. That bounds the count by 2 sqrt(n) + 1."""
    spread = high - low
    if spread == 0:
        return 1
    sturges = spread / (math.log2(n) + 1.0)
    freedman = 2.0 * (q75 - q25) / n ** (1.0 / 3.0)
    width = min(max(freedman, spread / math.sqrt(n) / 2.0), sturges)
    return math.ceil(spread / width)


def histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts in automatically chosen equal bins, empty ones included; the last bin is closed.

    One pass finds the ranges, one the quartiles, one counts all columns together.
    """
    m = moments(df, columns)
    counts = {c: m[c]["n"] for c in columns}
    quartiles = quantiles.exact_quantiles(df, columns, [0.25, 0.75], counts)
    filled = [c for c in columns if counts[c] > 0]
    edges = {}
    for c in filled:
        # A constant column gets one bin around its value.
        low, high = m[c]["min"], m[c]["max"]
        bins = auto_bins(counts[c], low, high, *quartiles[c])
        edges[c] = (low - 0.5, high + 0.5, 1) if low == high else (low, high, bins)
    return binned_counts(df, edges)


def _edge(low: float, high: float, bins: int, index: Column) -> Column:
    return F.when(index >= bins, F.lit(high)).otherwise(F.lit(low) + index * F.lit((high - low) / bins))


def binned_counts(df: DataFrame, edges: dict[str, tuple[float, float, int]]) -> DataFrame:
    def bin_of(c: str) -> Column:
        low, high, bins = edges[c]
        guess = F.floor((F.col(c) - low) / F.lit((high - low) / bins))
        guess = F.greatest(F.lit(0), F.least(F.lit(bins - 1), guess))
        # The division may land next to the bin whose edges enclose the value.
        down = F.col(c) < _edge(low, high, bins, guess)
        up = (F.col(c) >= _edge(low, high, bins, guess + 1)) & (guess < bins - 1)
        return guess - down.cast("int") + up.cast("int")

    values = _long(df, [F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNotNull(), bin_of(c))
                                 .cast("bigint").alias("bin")) for c in edges])
    counted = (values.where(F.col("bin").isNotNull())
               .groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n")))
    spec = df.sparkSession.createDataFrame(
        [(c, float(lo), float(hi), bins) for c, (lo, hi, bins) in edges.items()],
        "feature string, low double, high double, bins bigint")
    width = (F.col("high") - F.col("low")) / F.col("bins")
    grid = spec.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bins") - 1)).alias("bin"))
    right = F.when(F.col("bin") + 1 == F.col("bins"), F.col("high")).otherwise(
        F.col("low") + (F.col("bin") + 1) * width)
    return (grid.join(counted, ["feature", "bin"], "left")
            .select("feature", "bin", (F.col("low") + F.col("bin") * width).alias("left_edge"),
                    right.alias("right_edge"), F.coalesce("n", F.lit(0)).alias("n")))


def density_curve(df: DataFrame, columns: list[str], points: int = 200,
                  bin_width: dict[str, float] | None = None) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on an even grid over the data range.

    ``density`` integrates to 1; ``scaled`` is on the scale of histogram counts when ``bin_width``
    gives the histogram's bin width. Values are first shared among the four nearest points of a fine grid, ``FINE``
    per bandwidth, by cubic interpolation, so that what follows has a number of rows that the data's range in bandwidths
    sets, not the number of rows. That moves no mass and changes a kernel by less than 0.1 / FINE^4 of its height. Each
    task then adds up its share of every point, so the second shuffle carries ``points`` rows per task and column.
    """
    spark = df.sparkSession
    m = moments(df, columns)
    # A constant or single value has no bandwidth and so no curve.
    spec = spark.createDataFrame(
        [(c, m[c]["n"], m[c]["min"], (m[c]["max"] - m[c]["min"]) / (points - 1), m[c]["std"] * m[c]["n"] ** -0.2)
         for c in columns if m[c]["std"]],
        "feature string, n bigint, low double, step double, h double")
    # spec has one row per column, by construction.
    fine = F.col("h") / FINE
    at = (F.col("x") - F.col("low")) / fine
    t = at - F.floor(at)
    weights = {-1: -t * (t - 1) * (t - 2) / 6, 0: (t + 1) * (t - 1) * (t - 2) / 2, 1: -(t + 1) * t * (t - 2) / 2,
               2: (t + 1) * t * (t - 1) / 6}
    shares = F.array(*[F.struct((F.floor(at) + k).alias("cell"), w.alias("share")) for k, w in weights.items()])
    values = (_long(df, [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
              .where(F.col("x").isNotNull()).join(F.broadcast(spec), "feature")
              .select("feature", F.inline(shares)).where("share <> 0")
              .groupBy("feature", "cell").agg(F.sum("share").alias("times")))
    # Little data means much arithmetic here, so the partitions must not be merged by their bytes.
    values = values.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "feature", "cell")
    placed = values.join(F.broadcast(spec), "feature").select(
        "feature", (F.col("low") + F.col("cell") * fine).alias("x"), "times", "n", "low", "step", "h",
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    z = (F.col("low") + F.col("point") * F.col("step") - F.col("x")) / F.col("h")
    summed = (placed.groupBy("feature", "point")
              .agg(F.sum(F.col("times") * F.exp(z * z * F.lit(-0.5))).alias("mass"),
                   F.first("n").alias("n"), F.first("low").alias("low"),
                   F.first("step").alias("step"), F.first("h").alias("h")))
    density = F.col("mass") / (F.col("n") * F.col("h") * F.lit(math.sqrt(2.0 * math.pi)))
    out = summed.select("feature", F.col("point").cast("bigint").alias("point"),
                        (F.col("low") + F.col("point") * F.col("step")).alias("x"),
                        density.alias("density"), "n")
    if bin_width:
        widths = F.create_map(*[F.lit(v) for kv in bin_width.items() for v in kv])
        out = out.withColumn("scaled", F.col("density") * F.col("n") * F.try_element_at(widths, F.col("feature")))
    return out.drop("n")


def _comoments(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """One row per pair for a whole partition: n, both means, and the sums of products of deviations."""
    k = len(columns)
    n, mean, cross, square = (np.zeros((k, k)) for _ in range(4))
    for batch in batches:
        x = np.stack([np.asarray(batch.column(c).cast(pa.float64())) if batch.column(c).null_count == 0
                      else batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], axis=1)
        there = np.stack([np.asarray(batch.column(c).is_valid()) for c in columns], axis=1).astype(float)
        # Deviations from a value of the column: exactly 0 where the column is constant.
        start = np.array([x[np.argmax(there[:, i] > 0), i] if there[:, i].any() else 0.0 for i in range(k)])
        x = np.where(there > 0, x - start, 0.0)
        # Entry (a, b) is about column a where b is there too.
        m = there.T @ there
        some = np.maximum(m, 1.0)
        local = x.T @ there / some
        own_cross = x.T @ x - m * local * local.T
        own_square = (x * x).T @ there - m * local * local
        here = start[:, None] + local
        gap, both = np.where(n > 0, here - mean, 0.0), np.maximum(n + m, 1.0)
        cross += own_cross + gap * gap.T * n * m / both
        square += own_square + gap * gap * n * m / both
        mean = np.where(n > 0, mean + gap * m / both, np.where(m > 0, here, 0.0))
        n = n + m
    a, b = np.triu_indices(k)
    yield pa.RecordBatch.from_arrays(
        [pa.array(v) for v in (np.arange(len(a)), n[a, b], mean[a, b], mean[b, a], cross[a, b], square[a, b], square[b, a])],
        names=["i", "n", "mean_a", "mean_b", "cross", "square_a", "square_b"])


def _correlation(parts: pd.DataFrame) -> pd.DataFrame:
    """Merge the partitions' rows of one pair."""
    parts = parts[parts["n"] > 0]
    if parts.empty:
        return pd.DataFrame({"i": pd.Series(dtype="int64"), "r": pd.Series(dtype="float64")})
    n, total = parts["n"], parts["n"].sum()
    a, b = (parts[c] - parts[c].iloc[0] for c in ("mean_a", "mean_b"))
    mean_a, mean_b = (n * a).sum() / total, (n * b).sum() / total
    cross = (parts["cross"] + n * (a - mean_a) * (b - mean_b)).sum()
    spread = np.sqrt((parts["square_a"] + n * (a - mean_a) ** 2).sum()) * np.sqrt((parts["square_b"] + n * (b - mean_b) ** 2).sum())
    return pd.DataFrame({"i": parts["i"].iloc[:1], "r": [cross / spread if spread != 0 else None]})


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair over the rows that have both, as long rows.

    One pass for all pairs, and no row is repeated: each task adds up co-moments of its rows, which merge, and sends one
    row per pair. Each pair appears in both orders; without spread there is no value.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    names = [f"c{i}" for i in range(len(columns))]
    numbers = df.select(*[F.col(c).cast("double").alias(name) for c, name in zip(columns, names)])
    found = (numbers.mapInArrow(lambda batches: _comoments(batches, names), "i bigint, n double, mean_a double, "
                                "mean_b double, cross double, square_a double, square_b double")
             .groupBy("i").applyInPandas(_correlation, "i bigint, r double"))
    every = df.sparkSession.range(len(pairs)).select(F.col("id").alias("i"))
    found = every.join(found, "i", "left").withColumn("i", F.col("i").cast("int"))
    names = [F.array(*[F.lit(p[k]) for p in pairs]) for k in (0, 1)]
    x, y = (F.get(n, F.col("i")) for n in names)
    value = F.when((x == y) & F.col("r").isNotNull(), F.lit(1.0)).otherwise(F.col("r"))
    return found.select(F.inline(F.when(
        x == y, F.array(F.struct(x.alias("x"), y.alias("y"), value.alias("r")))
    ).otherwise(F.array(F.struct(x.alias("x"), y.alias("y"), value.alias("r")),
                        F.struct(y.alias("x"), x.alias("y"), value.alias("r"))))))
