"""Regression trees for several targets at once: second-order boosting and a joint forest on shared histograms.

Features are cut into at most ``bins`` quantile bins once, and the binned rows are written to the shared folder. A level
of trees is one pass: every partition adds up its rows per (tree, node, feature, bin), the partial histograms are summed,
and the best cut of each node is found from the sums alone, so what leaves a task does not grow with the rows. All trees
that can grow side by side share the pass: the trees of all targets in boosting, a group of trees in a forest.

Squared loss has Hessian 1, so with S the weighted sum of residuals and W the sum of weights the score of a node is
sum over its targets of S^2 / (W + penalty), a leaf says S / (W + penalty), and a cut's gain is the score of its sides less
that of the node. A joint tree sums the scores over the targets: with penalty 0 that is the fall in summed variance.
Rows and columns are drawn by hashes of the row's key and of the tree's number, the same for any partitioning.

Up to ``TOGETHER`` times ``MOST_ROWS`` rows the levels of ``CUT`` rounds run inside one barrier job, whose tasks keep
their rows and exchange each level's sums; every task grows the same trees from them. A lost executor costs the rounds
of that job. Beyond that, each level is a job, so any number of tasks takes part; margins are then an RDD that every
round derives from the last and that is checkpointed every ``CUT`` rounds. Per-partition arrays between rounds are what
DataFrames cannot hold without going through a table every round. Both ways grow the same trees.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, BarrierTaskContext, StorageLevel, keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcast.session import ensure_checkpoint_dir, materialize

#: Rounds after which the margins' lineage is cut.
CUT = 40
#: Histogram cells a pass may send from one task (8 bytes each).
MOST_CELLS = 4_000_000
#: Partial histograms up to this many partitions are summed by the driver, more of them in a tree.
DIRECT = 64
#: Rows of one block.
BLOCK_ROWS = 1 << 16
#: Tasks of a barrier job, and the rows that one of them takes.
TOGETHER = 16
MOST_ROWS = 4_000_000
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Settings:
    """``joint``: every tree has all targets and is one of a forest, grown on a bootstrap sample unless ``bootstrap`` is
    off; else one tree per target and round."""

    rounds: int
    depth: int
    rate: float = 1.0
    penalty: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    min_weight: float = 1.0
    joint: bool = False
    bootstrap: bool = True
    bins: int = 64
    seed: int = 42


#: Trees and a level -> the sums (tree, weight and targets, node, feature, bin) over all rows.
Sums = Callable[["list[Tree]", int], np.ndarray]


@dataclass
class Tree:
    """Nodes in heap order from 1: cut feature (-1: leaf) and bin, value per target, gain of the cut."""

    number: int
    targets: list[int]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def start(number: int, targets: list[int], depth: int) -> Tree:
        n = 2 << depth
        return Tree(number, targets, np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros((n, len(targets))), np.zeros(n))

    def place(self, codes: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels, or the leaf above."""
        node, rows = np.ones(len(codes), dtype=np.int64), np.arange(len(codes))
        for _ in range(levels):
            f = self.feature[node]
            inner = f >= 0
            node = np.where(inner, 2 * node + (codes[rows, np.maximum(f, 0)] > self.cut[node]), node)
        return node


def _mixed(h: np.ndarray, number: int) -> np.ndarray:
    """A uniform number per row and tree, from the row's hash."""
    with np.errstate(over="ignore"):
        h = h ^ np.uint64((number * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (h ^ (h >> np.uint64(31))).astype(np.float64) / 2.0**64


#: Chances of up to so many copies of a row in a bootstrap sample, added up.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.append(1.0, np.arange(1.0, 12.0))))


def row_weights(keys: np.ndarray, number: int, settings: Settings) -> np.ndarray:
    """Copies of each row in a tree's sample: Poisson(1) in a forest, else 0 or 1."""
    if settings.joint and settings.bootstrap:
        return np.searchsorted(_POISSON, _mixed(keys, settings.seed * 1_000_003 + number)).astype(np.float64)
    if settings.row_share >= 1:
        return np.ones(len(keys))
    return (_mixed(keys, settings.seed * 1_000_003 + number) < settings.row_share).astype(np.float64)


def columns_of(number: int, n: int, settings: Settings) -> np.ndarray:
    """Which columns a tree may cut: a share of them, one at least."""
    drawn = np.zeros(n, dtype=bool)
    order = np.argsort(_mixed(np.arange(n, dtype=np.uint64), settings.seed * 7_000_003 + number), kind="stable")
    drawn[order[:max(1, int(settings.column_share * n))]] = True
    return drawn


def _histograms(part: Iterator[Block], trees: list[Tree], level: int, settings: Settings) -> Iterator[np.ndarray]:
    """One partition's sums (tree, weight and targets, node, feature, bin)."""
    total = None
    for codes, y, keys, margin in part:
        n_features = codes.shape[1]
        width = n_features * settings.bins
        if total is None:
            total = np.zeros((len(trees), 1 + len(trees[0].targets), 1 << level, n_features, settings.bins))
        cells = codes + np.arange(n_features) * settings.bins
        for k, tree in enumerate(trees):
            w = row_weights(keys, tree.number, settings)
            node = tree.place(codes, level) - (1 << level)
            rows = np.flatnonzero((node >= 0) & (w > 0))
            at = (cells[rows] + node[rows, None] * width).ravel()
            for s, column in enumerate([None, *tree.targets]):
                of = w[rows] if column is None else w[rows] * (y[rows, column] - margin[rows, column])
                total[k, s] += np.bincount(at, np.repeat(of, n_features), (1 << level) * width).reshape(total.shape[2:])
    if total is not None:
        yield total


def _summed(blocks: RDD, settings: Settings) -> Sums:
    """The sums of a level as a job of its own."""
    def sums(trees: list[Tree], level: int) -> np.ndarray:
        parts = blocks.mapPartitions(lambda part: _histograms(part, trees, level, settings))
        if blocks.getNumPartitions() > DIRECT:
            return parts.treeReduce(np.add, 2)
        return np.sum(parts.collect(), axis=0)
    return sums


def _gathered(part: list[Block], settings: Settings) -> Sums:
    """The sums of a level inside a barrier task: its own rows' and what the other tasks send."""
    context = BarrierTaskContext.get()
    alone = len(context.getTaskInfos()) == 1

    def sums(trees: list[Tree], level: int) -> np.ndarray:
        own = next(_histograms(iter(part), trees, level, settings), None)
        if alone:
            return own
        sent = "" if own is None else base64.b64encode(zlib.compress(own.tobytes(), 1)).decode()
        # In the order of the tasks, so that every one of them adds up the same and grows the same trees.
        parts = [np.frombuffer(zlib.decompress(base64.b64decode(m))) for m in context.allGather(sent) if m]
        return sum(parts).reshape(len(trees), 1 + len(trees[0].targets), 1 << level, -1, settings.bins)
    return sums


def best_cuts(sums: np.ndarray, columns: np.ndarray, penalty: float, min_weight: float) -> tuple[np.ndarray, ...]:
    """Per node of one tree: (feature, bin, gain, sums of the left side, sums of the node); gain 0 where none helps.

    Of cuts that gain the same (to nine digits) the first feature and bin is taken.
    """
    below = sums.cumsum(axis=-1)
    # Every feature's bins hold the same rows.
    whole = below[:, :, 0, -1]
    left = below[..., :-1]
    right = whole[:, :, None, None] - left

    def score(s: np.ndarray) -> np.ndarray:
        return (s[1:] ** 2).sum(axis=0) / np.maximum(s[0] + penalty, 1e-12)
    gain = score(left) + score(right) - score(whole)[:, None, None]
    gain[(left[0] < min_weight) | (right[0] < min_weight)] = -np.inf
    gain[:, ~columns] = -np.inf
    flat = gain.reshape(len(gain), -1)
    most = flat.max(axis=1)
    found = (flat >= (most - 1e-9 * np.abs(most))[:, None]).argmax(axis=1)
    feature, cut = np.divmod(found, gain.shape[2])
    node = np.arange(len(gain))
    # Less than rounding could make is no gain.
    least = 1e-10 * (1 + np.abs(score(whole)))
    return feature, cut, np.where(most > least, most, 0.0), left[:, node, feature, cut], whole


def grow(sums: Sums, trees: list[Tree], settings: Settings, n_features: int) -> None:
    """Grow trees level by level, one pass a level for all of them."""
    for level in range(settings.depth):
        going = False
        for tree, own in zip(trees, sums(trees, level)):
            feature, cut, gain, left, whole = best_cuts(own, columns_of(tree.number, n_features, settings),
                                                        settings.penalty, settings.min_weight)
            for i in range(1 << level):
                at = (1 << level) + i
                if level == 0:
                    tree.value[at] = whole[1:, i] / max(whole[0, i] + settings.penalty, 1e-12)
                if gain[i] <= 0:
                    continue
                going = True
                tree.feature[at], tree.cut[at], tree.gain[at] = feature[i], cut[i], gain[i]
                for side, s in ((2 * at, left[:, i]), (2 * at + 1, whole[:, i] - left[:, i])):
                    tree.value[side] = s[1:] / max(s[0] + settings.penalty, 1e-12)
        if not going:
            break


def _moved(part: Iterator[Block], trees: list[Tree], settings: Settings) -> Iterator[Block]:
    for codes, y, keys, margin in part:
        margin = margin.copy()
        for tree in trees:
            margin[:, tree.targets] += settings.rate * tree.value[tree.place(codes, settings.depth)]
        yield codes, y, keys, margin


def _rounds(settings: Settings, n_features: int, n_targets: int, first: int, last: int) -> Iterator[list[Tree]]:
    """New trees that grow side by side: a group of a forest's, or a round's one per target."""
    if settings.joint:
        cells = (1 << settings.depth - 1) * n_features * settings.bins * (1 + n_targets)
        group = max(1, MOST_CELLS // cells)
        for a in range(first, last, group):
            yield [Tree.start(k, list(range(n_targets)), settings.depth) for k in range(a, min(a + group, last))]
        return
    for r in range(first, last):
        yield [Tree.start(r * n_targets + k, [k], settings.depth) for k in range(n_targets)]


def _grown_in_passes(blocks: RDD, settings: Settings, n_features: int, n_targets: int) -> list[Tree]:
    """One job per level; any number of partitions."""
    trees: list[Tree] = []
    before: list[RDD] = []
    for r, some in enumerate(_rounds(settings, n_features, n_targets, 0, settings.rounds)):
        grow(_summed(blocks, settings), some, settings, n_features)
        trees += some
        if settings.joint:
            continue
        before.append(blocks)
        blocks = blocks.mapPartitions(lambda part, some=some: _moved(part, some, settings)).persist(StorageLevel.MEMORY_AND_DISK)
        if r % CUT == CUT - 1:
            blocks.checkpoint()
        while len(before) > 2:
            before.pop(0).unpersist()
    for b in [*before, blocks]:
        b.unpersist()
    return trees


def _grown_together(blocks: RDD, settings: Settings, n_features: int, n_targets: int) -> list[Tree]:
    """One barrier job per ``CUT`` rounds: its tasks keep their rows and exchange each level's sums."""
    trees: list[Tree] = []
    for first in range(0, settings.rounds, CUT):
        last = min(first + CUT, settings.rounds)

        def run(part: Iterator[Block], known=trees, first=first, last=last) -> Iterator[list[Tree]]:
            part = [b for b in part if len(b[0])]
            if not settings.joint:
                part = list(_moved(iter(part), known, settings))
            new = []
            for some in _rounds(settings, n_features, n_targets, first, last):
                grow(_gathered(part, settings), some, settings, n_features)
                if not settings.joint:
                    part = list(_moved(iter(part), some, settings))
                new += some
            if BarrierTaskContext.get().partitionId() == 0:
                yield new
        trees = trees + blocks.barrier().mapPartitions(run).collect()[0]
    return trees


def quantile_cuts(train: DataFrame, bins: int) -> list[list[float]]:
    """Per feature at most bins - 1 values, rows up to a value lie below its cut. All features in one aggregate."""
    first = train.select("features").first()
    if first is None:
        raise ValueError("no rows to learn from")
    shares = ", ".join(repr(i / bins) for i in range(1, bins))
    found = train.select(vector_to_array("features").alias("x")).selectExpr(*[
        f"percentile_approx(x[{i}], array({shares}), 10000)" for i in range(len(first["features"]))]).first()
    return [sorted(set(values)) for values in found]


def _binned(train: DataFrame, cuts: list[list[float]], targets: list[str], keys: list[str]) -> DataFrame:
    """Blocks of rows: bin numbers, targets and key hashes as bytes, one row of the table per block."""
    n = len(cuts)
    edges = [np.array(c) for c in cuts]
    rows = train.select(vector_to_array("features").alias("x"), F.xxhash64(*keys).alias("key"),
                        *(F.col(t).cast("double").alias(f"y{i}") for i, t in enumerate(targets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            codes, y, key = (np.concatenate(c) for c in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (codes, y, key)],
                                              names=["codes", "y", "key"])
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, n)
            codes = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], axis=1).astype(np.uint8)
            y = np.stack([np.asarray(batch.column(f"y{i}")) for i in range(len(targets))], axis=1)
            held.append((codes, y, np.asarray(batch.column("key")).view(np.uint64)))
            if sum(len(h[0]) for h in held) >= BLOCK_ROWS:
                yield block()
        if held:
            yield block()
    return rows.mapInArrow(run, "codes binary, y binary, key binary")


@dataclass(frozen=True)
class Learner:
    """Fits one model per target, all from the same passes over the rows."""

    settings: Settings
    #: Importance of a feature: "total" gain per tree, or "average" gain of its cuts.
    importance: str = "total"
    name: str = field(default="trees")

    def fit(self, train: DataFrame, targets: list[str], predictions: list[str], keys: list[str]) -> list[TreeModel]:
        """``train`` has the vector column features, the targets, and keys that tell rows apart."""
        s, spark = self.settings, train.sparkSession
        if not 2 <= s.bins <= 256:
            raise ValueError("bins are 2 to 256")
        ensure_checkpoint_dir(spark)
        cuts = quantile_cuts(train, s.bins)
        n, k = len(cuts), len(targets)
        table = materialize(_binned(train, cuts, targets, keys))
        base = [float(v) for v in train.agg(*[F.avg(t) for t in targets]).first()]
        def unpacked(r) -> Block:
            y = np.frombuffer(r["y"]).reshape(-1, k)
            codes = np.frombuffer(r["codes"], dtype=np.uint8).reshape(-1, n)
            return codes, y, np.frombuffer(r["key"], dtype=np.uint64), np.tile(base, (len(y), 1))
        blocks = table.rdd.map(unpacked)
        slots = spark.sparkContext.defaultParallelism
        rows = table.select(F.sum(F.octet_length("key") / 8)).first()[0]
        together = min(TOGETHER, slots, blocks.getNumPartitions())
        # Barrier jobs need all their tasks at once, which dynamic allocation does not promise.
        if rows <= together * MOST_ROWS and spark.conf.get("spark.dynamicAllocation.enabled", "false") != "true":
            trees = _grown_together(blocks.coalesce(together), s, n, k)
        else:
            blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
            try:
                trees = _grown_in_passes(blocks, s, n, k)
            finally:
                blocks.unpersist()
        return [TreeModel.of(trees, cuts, i, base[i], 1 / s.rounds if s.joint else s.rate, p, self.importance)
                for i, p in enumerate(predictions)]


class TreeModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Trees that predict one target from the vector column ``features``; saved and loaded as MLlib's models are."""

    trees = Param(Params._dummy(), "trees", "nodes, cuts and values as JSON", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "name of the prediction", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees: str | None = None, predictionCol: str = "prediction"):
        super().__init__()
        self._setDefault(predictionCol="prediction")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @staticmethod
    def of(trees: list[Tree], cuts: list[list[float]], target: int, base: float, rate: float, prediction: str,
           importance: str) -> TreeModel:
        mine = [t for t in trees if target in t.targets]
        column = [t.targets.index(target) for t in mine]
        gains = np.zeros((len(mine), len(cuts)))
        uses = np.zeros(len(cuts))
        for row, t in zip(gains, mine):
            inner = np.flatnonzero(t.feature >= 0)
            np.add.at(row, t.feature[inner], t.gain[inner])
            np.add.at(uses, t.feature[inner], 1)
        if importance == "average":
            weight = gains.sum(axis=0) / np.maximum(uses, 1)
        else:
            # A tree without a cut says nothing about features.
            weight = (gains / np.maximum(gains.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0)
        total = weight.sum()
        content = {"base": base, "rate": rate, "importance": (weight / total if total else weight).tolist(), "trees": [
            {"feature": t.feature.tolist(),
             "cut": [cuts[f][c] if f >= 0 else 0.0 for f, c in zip(t.feature.tolist(), t.cut.tolist())],
             "value": t.value[:, c].tolist()} for t, c in zip(mine, column)]}
        return TreeModel(trees=json.dumps(content), predictionCol=prediction)

    @property
    def content(self) -> dict:
        return json.loads(self.getOrDefault("trees"))

    @property
    def featureImportances(self) -> list[float]:
        return self.content["importance"]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return _predicted(_arrays(self.content), x)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast(_arrays(self.content))

        @F.pandas_udf("double")
        def predicted(features: pd.Series) -> pd.Series:
            return pd.Series(_predicted(shared.value, np.stack(features.to_numpy())) if len(features) else [])
        return dataset.withColumn(self.getOrDefault("predictionCol"), predicted(vector_to_array("features")))


def _arrays(content: dict) -> tuple:
    return content["base"], content["rate"], [
        (np.array(t["feature"]), np.array(t["cut"]), np.array(t["value"])) for t in content["trees"]]


def _predicted(model: tuple, x: np.ndarray) -> np.ndarray:
    base, rate, trees = model
    out, rows = np.full(len(x), base), np.arange(len(x))
    for feature, cut, value in trees:
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(len(feature).bit_length() - 2):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + (x[rows, np.maximum(f, 0)] > cut[node]), node)
        out += rate * value[node]
    return out
