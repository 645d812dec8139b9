"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader.

A text's features are its words and word pairs, both as they are and as shapes (which kinds of characters follow one
another), hashed to 2^18 places, and three shares of repeats: words equal to the one before, 3-grams seen before in the
text, and signs. A feature's value is its count by the number of words, so a score is a sparse dot product: the mean
of the weights of the text's n-grams. Weights come from FTRL-Proximal with one rate per place.

Learning uses at most ``MOST_DOCUMENTS`` labelled rows that are not held out, in the order of a hash of their id; they are
fitted in one task. Every text is scored whole. Empty and null texts have the score of the intercept. Repeated rows
count repeatedly in learning; rows with null ids are scored but not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast.llm import text as X
from stationcast.llm.common import digest_bucket, sample_ids, table

PLACES = 1 << 18
EXTRA = 3
SCALE = 10.0
MOST_DOCUMENTS = 6000
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.1, 3
SEED = 3


def _kinds() -> np.ndarray:
    """Byte kinds for shapes: lower case (and bytes beyond ASCII), upper case, digits; each sign is its own kind."""
    kinds = np.arange(256, dtype=np.int64) + 8
    kinds[97:123] = kinds[128:] = 1
    kinds[65:91] = 2
    kinds[48:58] = 3
    return kinds


_KINDS = _kinds()
_PAIRS = X.mix(np.arange(300 * 300, dtype=np.uint64) + np.uint64(17))


def _shapes(w: X.Words) -> np.ndarray:
    """One hash per word of the changes of kind in it, whatever their order."""
    kinds = _KINDS[w.data]
    before = np.zeros_like(kinds)
    before[1:] = kinds[:-1]
    inside = np.ones(len(kinds), dtype=bool)
    inside[w.start] = False
    before[~inside] = 0
    step = np.where(before != kinds, _PAIRS[before * 300 + kinds], np.uint64(0))
    sums = np.zeros(len(kinds) + 1, dtype=np.uint64)
    np.cumsum(step, out=sums[1:])
    return X.mix(sums[w.end] - sums[w.start])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of all n-grams of all texts, the text of each, the extra shares per text, and the words per text."""
    w = X.words(texts)
    n = np.diff(w.first)
    doc = w.doc
    h, shape = w.hashes(), _shapes(w)
    places, owners = [], []
    for k, hashes in enumerate((h, shape)):
        for size in (1, 2):
            g, at = (hashes, np.arange(len(hashes))) if size == 1 else X.ngrams(hashes, w.first, 2)
            places.append((X.mix(g ^ np.uint64(2 * k + size)) & np.uint64(PLACES - 1)).astype(np.int64))
            owners.append(doc[at])
    extra = np.zeros((len(texts), EXTRA))
    if len(h):
        same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        extra[:, 0] = np.bincount(doc[1:][same], minlength=len(texts))
        g3, at = X.ngrams(h, w.first, 3)
        if len(g3):
            key = X.mix(g3 ^ doc[at].astype(np.uint64))
            order = np.argsort(key, kind="stable")
            again = np.zeros(len(key), dtype=bool)
            again[order[1:]] = key[order[1:]] == key[order[:-1]]
            extra[:, 1] = np.bincount(doc[at][again], minlength=len(texts))
        signs = (_KINDS[w.data] > 8) & (w.data != 46) & (w.data != 44) & (w.data > 32)
        sums = np.append(0, np.cumsum(signs))
        extra[:, 2] = np.bincount(doc, weights=(sums[w.end] - sums[w.start]) > 0, minlength=len(texts))
    extra /= np.maximum(n, 1)[:, None]
    return np.concatenate(places), np.concatenate(owners), extra, n


def fit(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """FTRL-Proximal over the texts in a fixed shuffled order. Weights: places, extra shares, intercept."""
    size = PLACES + EXTRA + 1
    z, squares, weights = np.zeros(size), np.zeros(size), np.zeros(size)
    rows = []
    column = pa.array(texts, pa.large_string())
    for lo, hi in X.slices(column):
        places, owners, extra, n = features(column.slice(lo, hi - lo))
        order = np.argsort(owners, kind="stable")
        places, cuts = places[order], np.searchsorted(owners[order], np.arange(hi - lo + 1))
        for i in range(hi - lo):
            at, counts = np.unique(places[cuts[i]:cuts[i + 1]], return_counts=True)
            at = np.concatenate([at, PLACES + np.arange(EXTRA + 1)])
            rows.append((at, np.concatenate([SCALE * counts / max(n[i], 1), SCALE * extra[i], [1.0]])))
    order = np.random.default_rng(SEED).permutation(len(rows))
    for _ in range(EPOCHS):
        for i in order:
            at, x = rows[i]
            big = np.abs(z[at]) > L1
            w = np.where(big, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(squares[at])) / ALPHA + L2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - labels[i]) * x
            sigma = (np.sqrt(squares[at] + g * g) - np.sqrt(squares[at])) / ALPHA
            z[at] += g - sigma * w
            squares[at] += g * g
    big = np.abs(z) > L1
    weights[big] = -(z[big] - np.sign(z[big]) * L1) / ((BETA + np.sqrt(squares[big])) / ALPHA + L2)
    return weights


def train(docs: DataFrame, labels: DataFrame, held_out: Column) -> np.ndarray:
    """Weights from (doc_id, text) and (doc_id, label); without labelled rows all weights are zero."""
    taken = F.broadcast(sample_ids(labels, held_out, MOST_DOCUMENTS, SEED))

    def run(batches):
        rows = [r for b in batches for r in zip(b.column("o").to_pylist(), b.column("text").to_pylist(),
                                                b.column("label").to_pylist())]
        rows.sort(key=lambda r: (r[0], r[1] or "", r[2]))
        weights = fit([r[1] or "" for r in rows], np.array([float(r[2]) for r in rows])) if rows else np.zeros(
            PLACES + EXTRA + 1)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights[at])], names=["place", "weight"])
    # At most MOST_DOCUMENTS rows come to the one task that fits; the scan and the join before it keep their tasks.
    sample = docs.join(taken, "doc_id").select(
        F.xxhash64("doc_id", F.lit(SEED)).alias("o"), "text", "label").repartition(1)
    found = sample.mapInArrow(run, "place long, weight double").toArrow()
    weights = np.zeros(PLACES + EXTRA + 1)
    weights[found.column("place").to_numpy()] = found.column("weight").to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) per row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            texts = X.as_texts(batch.column("text"))
            for lo, hi in X.slices(texts):
                places, owners, extra, n = features(texts.slice(lo, hi - lo))
                dot = np.bincount(owners, weights=w[places], minlength=hi - lo) / np.maximum(n, 1)
                logit = SCALE * (dot + extra @ w[PLACES:PLACES + EXTRA]) + w[-1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))],
                    names=["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = digest_bucket("doc_id", 4) == 2
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return score(docs, train(docs, labels, held_out)).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
