"""Periodic runs of words (a passage said over and over) found by uniting suffix classes in the order of falling LCP.

The words of a text are sorted as suffixes (prefix doubling, many texts at a time), neighbours in that order get the
length of their longest common prefix (LCP), and the pairs are taken in the order of falling LCP. Union-find keeps the
classes of suffixes that share at least that many words; each class is a sorted list of positions, and the smaller
list is put into the larger one. Two positions i < j that become neighbours in such a list share exactly the LCP of
the moment, so when j - i is not above it, they seed a run of period j - i from i to j + LCP. The seed of a run's first
word is always among these, and its period is the smallest one: with a smaller period another position of the class
would lie between the two. A seed whose left neighbours are equal is not at the start of its run and is left out.

A run is at least ``min_length`` words and ``min_exponent`` periods long. Its words after the first period are dropped
from the collapsed text. Rows with a null or empty text have no words, no runs and an empty collapsed text. Repeated
rows and any doc_id, null included, are handled row by row; empty tables give empty results. Other columns pass
through; those named runs, n_words or collapsed are replaced. A text is worked on whole; the arrays of one text take
about 8 bytes a word and doubling step.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationcast.llm import text as X
from stationcast.llm.common import table

MIN_LENGTH = 6
MIN_EXPONENT = 4
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_NEW = ("runs", "n_words", "collapsed")


def suffix_order(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in the order of their suffixes, and per level k a rank that is equal where 2^k keys are equal.

    ``keys`` ends with a key that occurs once, so suffixes that share a prefix of some length all reach that far.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    slots, items, sorted_keys = np.arange(n), order, keys[order]
    rank = np.zeros(n, dtype=np.int64)
    levels, length = [], 1
    while True:
        heads = X.group_starts(sorted_keys)
        sizes = np.diff(np.append(heads, len(items)))
        rank = rank.copy()
        rank[items] = np.repeat(slots[heads], sizes)
        levels.append(rank)
        open_ = np.repeat(sizes > 1, sizes)
        slots, items = slots[open_], items[open_]
        if len(items) == 0:
            return order, levels
        pair = rank[items] * n + rank[items + length]
        by = np.argsort(pair, kind="stable")
        items, sorted_keys = items[by], pair[by]
        order[slots] = items
        length *= 2


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many keys the suffixes at ``a`` and ``b`` share."""
    shared = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        shared[levels[k][a + shared] == levels[k][b + shared]] += 1 << k
    return shared


def _seeds(order: np.ndarray, at: np.ndarray, shared: np.ndarray, exponent: int) -> list[tuple[int, int, int]]:
    """(first position, period, LCP) of newly adjacent positions; ``at`` are the slots whose suffix meets the next
    one's with ``shared`` words, by falling LCP."""
    slots = np.union1d(at, at + 1)
    places = order[slots].tolist()
    low = np.searchsorted(slots, at).tolist()
    parent = list(range(len(places)))
    sets: list[list[int] | None] = [[p] for p in places]
    found = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, lcp in zip(low, shared.tolist()):
        # Neighbours in suffix order are neighbours among the slots.
        a, b = root(x), root(x + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        parent[b], sets[b] = a, None
        most = lcp // (exponent - 1)
        before = -1
        for k, p in enumerate(small):
            i = bisect_left(large, p)
            if i and large[i - 1] != before and p - large[i - 1] <= most:
                found.append((large[i - 1], p - large[i - 1], lcp))
            if i < len(large):
                q = large[i]
                if q - p <= most and (k + 1 == len(small) or small[k + 1] > q):
                    found.append((p, q - p, lcp))
            large.insert(i, p)
            before = p
    return found


def find_runs(keys: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of the runs in ``keys``, by start and period.

    The first and the last key must occur once each; keys that occur once separate texts.
    """
    least = min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1))
    order, levels = suffix_order(keys)
    # The level whose prefixes are no longer than the least useful LCP leaves few pairs to measure.
    coarse = levels[min(least.bit_length() - 1, len(levels) - 1)]
    at = np.flatnonzero(coarse[order[:-1]] == coarse[order[1:]])
    shared = common_prefixes(levels, order[at], order[at + 1])
    at, shared = at[shared >= least], shared[shared >= least]
    by = np.argsort(-shared, kind="stable")
    found = _seeds(order, at[by], shared[by], min_exponent)
    if not found:
        return np.zeros((0, 3), dtype=np.int64)
    start, period, lcp = np.array(found, dtype=np.int64).T
    length = lcp + period
    first = (keys[start - 1] != keys[start + period - 1]) & (length >= min_length) & (length >= min_exponent * period)
    runs = np.stack([start, length, period], axis=1)[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _collapse(batch: pa.RecordBatch, min_length: int, min_exponent: int) -> Iterator[tuple]:
    """(runs, number of words, collapsed text) of slices of a batch's texts, as Arrow columns."""
    texts = X.as_texts(batch.column("text"))
    for lo, hi in X.slices(texts):
        part = texts.slice(lo, hi - lo)
        w = X.words(part)
        n, sizes = hi - lo, np.diff(w.first)
        # One key of its own before each text and one at the end: no two suffixes share it.
        place = np.arange(len(w.start)) + w.doc + 1
        own = np.setdiff1d(np.arange(len(w.start) + n + 1), place, assume_unique=True)
        keys = np.empty(len(w.start) + n + 1, dtype=np.uint64)
        keys[place] = X.mix(w.hashes() ^ X.mix(w.doc.astype(np.uint64)))
        keys[own] = X.mix(X.mix(np.arange(n + 1, dtype=np.uint64) + np.uint64(1 << 40)))
        runs = find_runs(keys, min_length, min_exponent)
        doc = np.searchsorted(own, runs[:, 0]) - 1
        start = runs[:, 0] - own[doc] - 1
        ends = np.searchsorted(doc, np.arange(n + 1))
        spans = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(
            [pa.array(start), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(_RUN)))
        # A word is gone where more runs that drop it have begun than ended.
        steps = np.zeros(len(keys) + 1, dtype=np.int64)
        np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
        np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(steps)[:-1][place] == 0
        out = []
        for d in range(n):
            words = part[d].as_buffer().to_pybytes().split()
            if ends[d] < ends[d + 1]:
                words = [words[i] for i in np.flatnonzero(kept[w.first[d]:w.first[d + 1]])]
            out.append(b" ".join(words).decode())
        yield lo, hi, (spans, pa.array(sizes.astype(np.int64)), pa.array(out, pa.string()))


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """The rows with ``runs`` (array of start, length, period in words, by start and period), ``n_words`` and
    ``collapsed``, the text of the words that stay, joined by one space."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has at least two periods and two words")
    docs = docs.drop(*_NEW)
    others = docs.columns

    def run(batches):
        for batch in batches:
            for lo, hi, new in _collapse(batch, min_length, min_exponent):
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*rows.columns, *new], names=[*others, *_NEW])
    schema = T.StructType([*docs.schema, *T.StructType.fromDDL(
        "runs array<struct<start:bigint,length:bigint,period:bigint>>, n_words bigint, collapsed string").fields])
    return docs.mapInArrow(run, schema)


def looped(docs: DataFrame) -> DataFrame:
    """The texts with a tenth of them, by crc32 of doc_id, made to repeat from word a on with a period p that fits
    three to ten times. A null doc_id or a text without words stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(f"({X.WORD})"), F.lit(1))
    g, n = F.floor(h / 10), F.size("_words")
    a = F.pmod(g, n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))

    def source(i: Column) -> Column:
        return F.get("_words", F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))
    # One scan: only the texts that change are split into words.
    docs = docs.withColumn("_words", F.when(F.pmod(h, F.lit(10)) == 0, words))
    return docs.withColumn("text", F.when(n > 0, F.array_join(
        F.transform(F.sequence(F.lit(0), n - 1), source), " ")).otherwise(F.col("text"))).drop("_words")


def digests(rows: DataFrame) -> DataFrame:
    """What is compared of :func:`collapse_runs`: the longest run (ties: smallest start, then period) and hashes."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as s, -r.period as p)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return rows.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.s")).alias("start"),
        F.col("_best.length").alias("length"), (-F.col("_best.p")).alias("period"),
        F.expr("1000 * _best.length div -_best.p").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(collapse_runs(looped(table(spark, sf_dir, "documents").select("doc_id", "text"))))
