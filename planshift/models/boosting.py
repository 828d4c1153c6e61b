"""Boosted trees by summed histograms: Spark's own algorithm and model, with one job per tree where it can be.

Spark's trainer goes over boxed rows once per tree level and once more per round.  Here the binned
rows lie in chunks, tasks sum residuals per tree node, feature and bin, Spark collects one partial
sum per task, and the driver picks the splits.  Successive trees are much alike, so a job sums for the
splits that are likeliest below the root too; where a guess was wrong, the true split is summed by a
further job.  The trees do not hang on the guesses.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planshift.models.network import summed
from planshift.session import work_path

ROWS_PER_CHUNK = 1 << 14
# Rounds after which the rows' margins are stored anew; in between tasks add the newest trees themselves.
ROUNDS_PER_STATE = 32
# Cells (ends of the known tree by sides of the guessed splits) that a job sums apart, as long as the ends are fewer.
CELLS = 32
# Roots, by their gain in the tree before, that are guessed first.
ROOTS = 2
# Gains closer than this share of the mean square are equal: their difference is rounding.
ROUNDING = 1e-12
STATE = "part int, place int, bins binary, y binary, w binary, margin binary"
NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
    "gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, "
    "leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)
TREE_PARAMS = {
    "cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth",
    "maxMemoryInMB", "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed",
}
# A node's place: 1 is the root, 2k and 2k + 1 are the children of k.  A split is (feature, last bin to the left).
Splits = Mapping[int, tuple[int, int]]


@dataclass
class Tree:
    """Splits and gains by place, and of every node its sums (rows, weight, residual, square) and impurity."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    gains: dict[int, float] = field(default_factory=dict)
    sums: dict[int, np.ndarray] = field(default_factory=dict)
    impurities: dict[int, float] = field(default_factory=dict)

    def value(self, node: int) -> float:
        _, weight, total, _ = self.sums[node]
        return float(total / weight) if weight else 0.0

    def prune(self) -> None:
        """Leaves of one parent that say the same become one."""
        for node in sorted(self.splits, reverse=True):
            below = (2 * node, 2 * node + 1)
            if not any(n in self.splits for n in below) and self.value(below[0]) == self.value(below[1]):
                del self.splits[node]


def ends(splits: Splits, node: int = 1) -> list[int]:
    """Nodes without a split, from left to right."""
    return [*ends(splits, 2 * node), *ends(splits, 2 * node + 1)] if node in splits else [node]


def end_of_rows(bins: np.ndarray, splits: Splits) -> np.ndarray:
    """For each row the number of its end in the order of ``ends``."""
    number = {n: i for i, n in enumerate(ends(splits))}

    kind = np.uint8 if len(number) <= 256 else np.uint32

    def below(node: int) -> np.ndarray:
        if node not in splits:
            return kind(number[node])
        feature, last = splits[node]
        left, right = below(2 * node), below(2 * node + 1)
        # all bits set where the row goes right
        away = np.negative((bins[feature] > last).astype(kind))
        return left ^ ((left ^ right) & away)

    return np.broadcast_to(below(1), bins.shape[1])


def with_trees(margin: np.ndarray, bins: np.ndarray, trees: Sequence[tuple[Splits, np.ndarray]]) -> np.ndarray:
    for splits, values in trees:
        margin = margin + values.take(end_of_rows(bins, splits))
    return margin


def histogram(
    bins: np.ndarray, cell: np.ndarray, n_cells: int, n_bins: int, w: np.ndarray | None, r: np.ndarray
) -> np.ndarray:
    """Per cell: rows, weight (if there is any), residual and squared residual by feature and bin."""
    weights = [None, *([] if w is None else [w]), wr := r if w is None else w * r, wr * r]
    out = np.empty((n_cells, len(weights), len(bins), n_bins))
    start = cell.astype(np.int64) * n_bins
    for i, column in enumerate(bins):
        at = start + column
        for k, each in enumerate(weights):
            out[:, k, i] = np.bincount(at, each, n_cells * n_bins).reshape(n_cells, n_bins)
    return out


def cut_points(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Candidate splits between sorted distinct values, as Spark takes them: all midpoints, or ``most`` of even weight."""
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) <= most:
        return middles
    stride = weights.sum() / (most + 1)
    found, target, running = [], stride, np.cumsum(weights)
    for i in range(1, len(values)):
        if abs(running[i - 1] - target) < abs(running[i] - target):
            found.append(middles[i - 1])
            target += stride
    return np.array(found)


def impurity(sums: np.ndarray) -> np.ndarray:
    """Variance from (rows, weight, residual, square) along the first axis; 0 without weight."""
    _, weight, total, square = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(weight == 0, 0.0, (square - total * total / weight) / weight)


def split_gains(sums: np.ndarray, cuts: Sequence[np.ndarray], least: int, least_gain: float) -> np.ndarray:
    """Gain of every (feature, last bin to the left); minus infinity where the split is not valid."""
    left = np.cumsum(sums, axis=2)
    whole = left[:, :, -1:]
    left = left[:, :, :-1]
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        share = left[1] / whole[1]
    gain = impurity(whole) - share * impurity(left) - (1 - share) * impurity(right)
    there = np.arange(left.shape[2]) < np.array([len(c) for c in cuts])[:, None]
    valid = there & (left[0] >= least) & (right[0] >= least) & (gain >= least_gain - ROUNDING * mean_square(sums))
    return np.where(valid, gain, -np.inf)


def mean_square(sums: np.ndarray) -> float:
    """Of the residuals in one node's histogram."""
    _, weight, _, square = sums[:, 0].sum(axis=1)
    return float(square / weight) if weight else 0.0


def best_split(gains: np.ndarray, sums: np.ndarray) -> tuple[tuple[int, int], float] | None:
    """First split (by feature, then bin) of the highest gain."""
    highest = gains.max(initial=-np.inf)
    if highest == -np.inf:
        return None
    feature, last = np.argwhere(gains >= highest - ROUNDING * mean_square(sums))[0]
    return (int(feature), int(last)), float(gains[feature, last])


class _Rows:
    """Binned training rows in chunks, with the margins after some tree."""

    def __init__(self, chunks: DataFrame, parts: int, n_features: int, n_bins: int, weighed: bool):
        self.chunks, self.parts, self.n_features, self.n_bins, self.weighed = chunks, parts, n_features, n_bins, weighed
        self.state, self.trees = chunks, []
        self.stored = 0

    def add(self, tree: tuple[Splits, np.ndarray]) -> None:
        self.trees.append(tree)
        if len(self.trees) - self.stored < ROUNDS_PER_STATE:
            return
        n_features, trees = self.n_features, list(self.trees)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    bins = _numbers(row, "bins", np.uint8).reshape(n_features, -1)
                    margin = with_trees(np.zeros(bins.shape[1]), bins, trees)
                    yield row.set_column(5, "margin", pa.array([margin.tobytes()], pa.binary()))

        self.release()
        # from the chunks again: the plan does not grow with the rounds
        self.state = self.chunks.mapInArrow(work, STATE).persist(StorageLevel.MEMORY_AND_DISK)
        self.stored = len(self.trees)

    def release(self) -> None:
        if self.state is not self.chunks:
            self.state.unpersist()

    def measure(self, known: Splits, guesses: Sequence[tuple[int, int]]) -> dict[int, np.ndarray]:
        """Per end of the known tree its histogram, by the sides of each guessed split (first axes); one job."""
        newest, first = self.trees[self.stored :], not self.trees
        known, n_features, n_bins = dict(known), self.n_features, self.n_bins
        n_ends = len(ends(known))
        n_cells, n_sums = n_ends << len(guesses), 4 if self.weighed else 3

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n_cells, n_sums, n_features, n_bins))
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    bins = _numbers(row, "bins", np.uint8).reshape(n_features, -1)
                    y, w, margin = _numbers(row, "y", np.int8), _numbers(row, "w"), _numbers(row, "margin")
                    margin = with_trees(margin if len(margin) else np.zeros(len(y)), bins, newest)
                    with np.errstate(over="ignore"):
                        r = y.astype(float) if first else 4.0 * y / (1.0 + np.exp(2.0 * y * margin))
                    cell = end_of_rows(bins, known).astype(np.int64)
                    for feature, last in guesses:
                        cell = 2 * cell + (bins[feature] > last)
                    total += histogram(bins, cell, n_cells, n_bins, w if len(w) else None, r)
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["part"])

        whole = summed(self.state.mapInArrow(work, "part binary"), self.parts)
        by_cell = whole.reshape(n_cells, n_sums, n_features, n_bins)
        if not self.weighed:
            by_cell = by_cell[:, [0, 0, 1, 2]]
        by_end = by_cell.reshape(n_ends, *[2] * len(guesses), 4, n_features, n_bins)
        return dict(zip(ends(known), by_end))


def _numbers(row: pa.RecordBatch, name: str, kind=np.float64) -> np.ndarray:
    return np.frombuffer(row.column(name)[0].as_buffer(), kind)


class _Guesses:
    """Splits likely to have nodes below them that can be split: the best roots of the tree before, then those used last."""

    def __init__(self, depth: int):
        self.depth, self.roots, self.used, self.last = depth, [], [], {}

    def below(self, known: Splits, node: int, way: tuple) -> list[tuple[int, int]]:
        """The known split or the one last found here, then those below it."""
        split = known.get(node, self.last.get(way))
        if split is None or node.bit_length() >= self.depth:
            return []
        sides = [self.below(known, 2 * node + side, (*way, (split, side))) for side in (0, 1)]
        return [split, *sides[0], *sides[1]]

    def choose(self, known: Splits) -> list[tuple[int, int]]:
        if self.depth < 2:
            return []
        starts = [known] if known else [{1: root} for root in self.roots]
        likely = [split for start in starts for split in self.below(start, 1, ())] + self.used
        most = max(0, int(math.log2(CELLS / len(ends(known)))))
        return [split for split in dict.fromkeys(likely) if split not in known.values()][:most]

    def learn(self, tree: Tree, root_gains: np.ndarray) -> None:
        best = root_gains.max(axis=1, initial=-np.inf)
        order = [int(f) for f in np.argsort(-best, kind="stable")[:ROOTS] if best[f] > 0]
        self.roots = [(f, int(root_gains[f].argmax())) for f in order]
        now = [split for node, split in sorted(tree.splits.items()) if node.bit_length() < self.depth]
        self.used = [*dict.fromkeys([*now, *self.used])][:CELLS]

        def note(node: int, way: tuple) -> None:
            if node in tree.splits:
                split = self.last[way] = tree.splits[node]
                note(2 * node, (*way, (split, 0)))
                note(2 * node + 1, (*way, (split, 1)))

        note(1, ())


class BoostedTrees(GBTClassifier):
    """``GBTClassifier`` with another trainer; parameters and the fitted model are Spark's.

    Categorical features, row samples, validation columns and more than 256 bins go to Spark's trainer.
    """

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        attributes = dataset.schema[self.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
        other = (
            "nominal" in attributes or "binary" in attributes or self.getSubsamplingRate() < 1 or self.getMaxBins() > 256
            or self.isSet(self.validationIndicatorCol) or self.getFeatureSubsetStrategy() != "all"
            or self.getMinWeightFractionPerNode() > 0 or self.getMaxIter() < 1
        )
        if other:
            return super()._fit(dataset)
        weight = self.getWeightCol() if self.isSet(self.weightCol) and self.getWeightCol() else None
        weighed = F.col(weight).cast("double") if weight else F.lit(1.0)
        rows = dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"), weighed.alias("w")
        )
        checks = rows.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("y").isin(0.0, 1.0)).alias("labels"),
            F.count_if(F.col("w") >= 0).alias("weights"),
            F.first(F.size("x")).alias("features"),
        ).first()
        n = checks["n"]
        if not n:
            raise ValueError("no rows to fit on")
        if checks["labels"] < n or checks["weights"] < n:
            raise ValueError("labels must be 0 or 1, and weights at least 0")
        cuts = self._cuts(rows, n, checks["features"])
        parts = max(1, min(dataset.sparkSession.sparkContext.defaultParallelism, math.ceil(n / ROWS_PER_CHUNK)))
        chunks = _chunked(rows, cuts, weight is not None, parts).persist(StorageLevel.MEMORY_AND_DISK)
        binned = _Rows(chunks, parts, len(cuts), max(len(c) for c in cuts) + 1, weight is not None)
        try:
            trees = self._trees(binned, cuts)
        finally:
            binned.release()
            chunks.unpersist()
        return self._model(trees, cuts, dataset.sparkSession)

    def _cuts(self, rows: DataFrame, n: int, n_features: int) -> list[np.ndarray]:
        """Candidate splits per feature, from as many rows as Spark takes for it."""
        share = max(self.getMaxBins() ** 2, 10_000) / n
        seed = self.getSeed() if self.isSet(self.seed) else 1
        seen = rows.sample(False, share, seed) if share < 1 else rows
        long = seen.select(F.posexplode("x").alias("feature", "value"), "w")
        counted = long.groupBy("feature", "value").agg(F.sum("w").alias("w")).orderBy("feature", "value").collect()
        cuts = []
        for i in range(n_features):
            mine = [(r["value"], r["w"]) for r in counted if r["feature"] == i]
            values, weights = (np.array(x, dtype=float) for x in zip(*mine)) if mine else (np.zeros(1), np.ones(1))
            cuts.append(cut_points(values, weights, min(self.getMaxBins(), n) - 1))
        return cuts

    def _trees(self, rows: _Rows, cuts: Sequence[np.ndarray]) -> list[Tree]:
        guesses, trees = _Guesses(self.getMaxDepth()), []
        while len(trees) < self.getMaxIter():
            tree, pending = Tree(), {1}
            while pending:
                # the splits at the last level have no node below them that is still to be summed
                known = {n: split for n, split in tree.splits.items() if n.bit_length() < self.getMaxDepth()}
                guessed = guesses.choose(known)
                for end, cells in rows.measure(known, guessed).items():
                    reached = [(end, cells, guessed)] if end in pending else []
                    while reached:
                        node, cells, left = reached.pop()
                        pending.remove(node)
                        gains = self._decide(tree, node, cells.sum(axis=tuple(range(len(left)))), cuts, pending)
                        if node == 1:
                            root_gains = gains
                        if (split := tree.splits.get(node)) in left:
                            at = left.index(split)
                            further = [*left[:at], *left[at + 1 :]]
                            sides = [(2 * node + side, cells.take(side, axis=at), further) for side in (0, 1)]
                            reached += [x for x in sides if x[0] in pending]
            guesses.learn(tree, root_gains)
            tree.prune()
            shrink = self.getStepSize() if trees else 1.0
            rows.add((tree.splits, np.array([tree.value(e) * shrink for e in ends(tree.splits)])))
            trees.append(tree)
        return trees

    def _decide(
        self, tree: Tree, node: int, sums: np.ndarray, cuts: Sequence[np.ndarray], pending: set[int]
    ) -> np.ndarray:
        """Split the node or leave it a leaf; children that may be split in their turn become pending."""
        if node == 1:
            tree.sums[1] = sums[:, 0].sum(axis=1)
        gains = split_gains(sums, cuts, self.getMinInstancesPerNode(), self.getMinInfoGain())
        tree.impurities[node] = float(impurity(tree.sums[node])) if np.isfinite(gains).any() else -1.0
        best = best_split(gains, sums)
        if best is None or best[1] <= ROUNDING * mean_square(sums) or node.bit_length() > self.getMaxDepth():
            return gains
        tree.splits[node], tree.gains[node] = best
        feature, last = best[0]
        for child, part in ((2 * node, sums[:, feature, : last + 1]), (2 * node + 1, sums[:, feature, last + 1 :])):
            tree.sums[child] = part.sum(axis=1)
            tree.impurities[child] = float(impurity(tree.sums[child]))
            if child.bit_length() <= self.getMaxDepth() and abs(tree.impurities[child]) >= np.finfo(float).eps:
                pending.add(child)
        return gains

    def _model(self, trees: Sequence[Tree], cuts: Sequence[np.ndarray], spark: SparkSession) -> GBTClassificationModel:
        """The trees in the files that Spark keeps such a model in, read as its own model."""
        path, nodes = work_path(spark, "boosted"), []
        for number, tree in enumerate(trees):

            def add(node: int) -> int:
                at = len(listed)
                listed.append(None)
                left = right = -1
                split, gain = (-1, [], -1), -1.0
                if node in tree.splits:
                    feature, last = tree.splits[node]
                    split, gain = (feature, [float(cuts[feature][last])], -1), tree.gains[node]
                    left, right = add(2 * node), add(2 * node + 1)
                rows, *sums = tree.sums[node].tolist()
                listed[at] = (number, (at, tree.value(node), tree.impurities[node], sums, int(rows), gain, left, right, split))
                return at

            listed: list = []
            add(1)
            nodes += listed
        given = {p.name: v for p, v in self._paramMap.items()}
        defaults = {p.name: v for p, v in self._defaultParamMap.items()}

        def described(kind: str, uid: str, names: Callable[[str], bool], **more) -> str:
            maps = [{n: v for n, v in m.items() if names(n)} for m in (given, defaults)]
            about = {"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
            return json.dumps(about | {"uid": uid, "paramMap": maps[0], "defaultParamMap": maps[1]} | more)

        head = described(
            "classification.GBTClassificationModel", self.uid, lambda n: True, numFeatures=len(cuts), numTrees=len(trees)
        )
        each = [
            (i, described("regression.DecisionTreeRegressionModel", f"dtr_{self.uid}_{i}", TREE_PARAMS.__contains__),
             self.getStepSize() if i else 1.0)
            for i in range(len(trees))
        ]
        spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/metadata")
        spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        spark.createDataFrame(nodes, NODES).coalesce(1).write.parquet(f"{path}/data")
        return GBTClassificationModel.load(path)


def _chunked(rows: DataFrame, cuts: Sequence[np.ndarray], weighed: bool, parts: int) -> DataFrame:
    """Rows as chunks of binned columns, spread evenly; a bin tells how many cuts lie below the value."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, held, count = TaskContext.get().partitionId(), 0, [], 0

        def chunk() -> pa.RecordBatch:
            bins, y, w = (np.concatenate(x, axis=-1) for x in zip(*held))
            arrays = [pa.array([part], pa.int32()), pa.array([place], pa.int32())]
            arrays += [pa.array([x.tobytes()], pa.binary()) for x in (bins, y, w if weighed else w[:0])]
            return pa.record_batch([*arrays, pa.array([b""], pa.binary())], names=["part", "place", "bins", "y", "w", "margin"])

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_CHUNK):
                some = batch.slice(start, ROWS_PER_CHUNK)
                x = some.column(0).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, len(cuts))
                y, w = (some.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                bins = np.stack([np.searchsorted(c, x[:, i]).astype(np.uint8) for i, c in enumerate(cuts)])
                held.append((bins, np.where(y == 1, 1, -1).astype(np.int8), w.astype(float)))
                count += some.num_rows
                if count >= ROWS_PER_CHUNK:
                    yield chunk()
                    place, held, count = place + 1, [], 0
        if held:
            yield chunk()

    return rows.mapInArrow(work, STATE).repartition(parts).sortWithinPartitions("part", "place")
