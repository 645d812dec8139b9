"""Exact quantiles of columns of any length.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here each wanted rank is
narrowed down between two approximate quantiles whose own ranks are then counted exactly, until few
enough values are left to sort. Of those only the wanted value reaches the driver, with counts and bounds.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATES = 100_000
ACCURACY = 10_000
# Both bounds are off by at most 1 / ACCURACY of the values searched and aim 2 / ACCURACY past the rank.
_SPREAD = 6.0 / ACCURACY


@dataclass
class _Search:
    """The value at ``rank`` (0-based) of ``column`` lies strictly between ``low`` and ``high``."""

    column: str
    rank: int
    below: int  # values <= low
    inside: int  # values strictly between
    low: float | None = None
    high: float | None = None
    found: float | None = None

    def bracket(self) -> tuple:
        return self.column, self.low, self.high


def _inside(column: str, low: float | None, high: float | None) -> Column:
    c = F.col(column)
    keep = c.isNotNull()
    if low is not None:
        keep = keep & (c > F.lit(low))
    if high is not None:
        keep = keep & (c < F.lit(high))
    return F.when(keep, c)


def _bounds(df: DataFrame, searches: list[_Search]) -> list[tuple[float, float]]:
    """Approximate values just below and just above each wanted rank; one sketch per bracket."""
    probs = defaultdict(set)
    wanted = []
    for s in searches:
        at, margin = (s.rank - s.below + 0.5) / s.inside, 2.0 / ACCURACY
        pair = max(0.0, at - margin), min(1.0, at + margin)
        wanted.append(pair)
        probs[s.bracket()].update(pair)
    brackets = {b: sorted(p) for b, p in probs.items()}
    row = df.agg(*[F.percentile_approx(_inside(*b), p, ACCURACY).alias(f"b{i}")
                   for i, (b, p) in enumerate(brackets.items())]).first()
    values = {b: dict(zip(p, row[i])) for i, (b, p) in enumerate(brackets.items())}
    return [(values[s.bracket()][low], values[s.bracket()][high]) for s, (low, high) in zip(searches, wanted)]


def _narrow(df: DataFrame, searches: list[_Search], candidates: int) -> None:
    """One round: find bounds, count their ranks, and pick the value between them once that is little.

    Counts and values are aggregated per column and bounds, so each task's share is spread over the spans.
    """
    bounds = _bounds(df, searches)
    spans = sorted({(s.column, *pair) for s, pair in zip(searches, bounds)})
    few = {(s.column, *pair) for s, pair in zip(searches, bounds) if s.inside * _SPREAD <= candidates}
    rows = F.array(*[F.struct(
        F.lit(i).alias("i"), F.col(c).cast("double").alias("x"), F.lit(float(low)).alias("low"),
        F.lit(float(high)).alias("high"), F.lit((c, low, high) in few).alias("few")) for i, (c, low, high) in enumerate(spans)])
    ranks = F.create_map(*[F.lit(v) for i, span in enumerate(spans) for v in (
        i, [s.rank for s, pair in zip(searches, bounds) if (s.column, *pair) == span])])
    x, low, high = F.col("x"), F.col("low"), F.col("high")
    found = (df.select(F.inline(rows)).where(x.isNotNull()).groupBy("i")
             .agg(F.count_if(x < low).alias("lt_low"), F.count_if(x <= low).alias("le_low"),
                  F.count_if(x < high).alias("lt_high"), F.count_if(x <= high).alias("le_high"),
                  F.array_sort(F.collect_list(F.when(F.col("few") & (x > low) & (x < high), x))).alias("inside"))
             .withColumn("picked", F.transform(F.element_at(ranks, F.col("i")), lambda rank: F.when(
                 rank >= F.col("le_low"), F.get("inside", (rank - F.col("le_low")).cast("int")))))
             .drop("inside").collect())
    by_span = {spans[r["i"]]: r for r in found}
    for s, (low, high) in zip(searches, bounds):
        r = by_span[s.column, low, high]
        lt_low, le_low, lt_high, le_high = r["lt_low"], r["le_low"], r["lt_high"], r["le_high"]
        if s.rank < lt_low:
            s.high, s.inside = low, lt_low - s.below
        elif s.rank < le_low:
            s.found = low
        elif s.rank < lt_high:
            s.low, s.high, s.below, s.inside = low, high, le_low, lt_high - le_low
            if (s.column, low, high) in few:
                at = [o.rank for o, pair in zip(searches, bounds) if (o.column, *pair) == (s.column, low, high)]
                s.found = r["picked"][at.index(s.rank)]
        elif s.rank < le_high:
            s.found = high
        else:
            s.low, s.inside, s.below = high, s.inside - (le_high - s.below), le_high


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], counts: dict[str, int],
                    candidates: int = CANDIDATES) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column. ``counts`` are the columns' non-null counts."""
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns if counts[c] == 0}
    filled = [c for c in columns if counts[c] > 0]
    wanted = {}
    for c in filled:
        for p in probs:
            at = p * (counts[c] - 1)
            for rank in (math.floor(at), math.ceil(at)):
                wanted[c, rank] = _Search(c, rank, 0, counts[c])
    while open_ := [s for s in wanted.values() if s.found is None]:
        _narrow(df, open_, candidates)
    for c in filled:
        out[c] = []
        for p in probs:
            at = p * (counts[c] - 1)
            low, high = float(wanted[c, math.floor(at)].found), float(wanted[c, math.ceil(at)].found)
            out[c].append(low + (high - low) * (at - math.floor(at)))
    return out


def value_at_rank(df: DataFrame, column: str, rank: int, count: int, candidates: int = CANDIDATES) -> float:
    """The value with exactly ``rank`` values before it in order; ``count`` is the column's non-null count."""
    search = _Search(column, rank, 0, count)
    while search.found is None:
        _narrow(df, [search], candidates)
    return float(search.found)
