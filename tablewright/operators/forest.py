"""Random forests, as an estimator and a model of Spark ML, on the cells of boosted trees.

Rows with the same bins of all features and the same label are one cell with a count. A tree's bootstrap takes a row a Poisson number of times, of mean 1,
and so the n rows of a cell a Poisson number of mean n: cells are drawn as their rows would be, and no row has a counter for each tree. All trees grow
together, level by level: tasks sum the drawn rows and their labels by node, feature and bin, the sums of a node meet in one shuffle, and its best split among its own
random features comes back. Splits minimise the variance, which for labels 0 and 1 is half of the Gini impurity. Sums are whole numbers, which depend on no order.

Draws are made anew in each pass, from the seed, the partition and the place of a batch in it, as kept cells are sorted within partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import CELLS, MISSING, TASK_CELLS, UNITS, BoostedTreesModel, Growing, Tree, _binner, _BoostingParams, _cuts, _cuts_of, _frozen, _matrix, _values, best_splits

#: Cells that draw at once, and nodes whose splits one task chooses, about.
DRAW_CELLS, TASK_NODES = 4096, 512
#: Most bins of a feature, as Spark's forests have by default.
BINS = 32


class ForestModel(BoostedTreesModel):
    """Adds the prediction (squared: the mean of the trees; logistic: 1.0 if more than half of their mean is for it) and, if a column is named for it, the probability."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.of("objective") != "logistic":
            return super()._transform(dataset)
        name = self.of("probabilityCol") or "_probability"
        shares = self._copyValues(ForestModel(self.trees, self.bins))._set(objective="squared", predictionCol=name)
        out = shares.transform(dataset).withColumn(self.of("predictionCol"), (F.col(name) > 0.5).cast("double"))
        return out if self.of("probabilityCol") else out.drop(name)


class Forest(Estimator, _BoostingParams):
    """``rounds`` trees. Rows without a label are left out; NaN and null in the features are missing values. Classes other than 0 and 1 are left to Spark's classifier."""

    def __init__(self, **params):
        super().__init__()
        self._defaults()
        self._set(**({"maxBins": BINS} | params))

    def _fit(self, dataset: DataFrame):
        logistic, seed, trees = self.of("objective") == "logistic", self.of("seed"), self.of("rounds")
        rows = dataset.select(_values(dataset, self.of("featuresCol")).alias("x"), F.col(self.of("labelCol")).cast("double").alias("y")).filter("y is not null")
        one = rows.select(F.size("x")).first()
        if one is None:
            return self._copyValues(ForestModel([], []))
        width = one[0]
        seen = rows.agg(F.avg("y").alias("mean"), F.max(F.abs("y")).alias("most"), F.count_if(~F.col("y").isin(0.0, 1.0)).alias("other"), *_cuts_of(width, self.of("maxBins"))).first()
        if logistic and seen["other"]:
            return RandomForestClassifier(numTrees=trees, maxDepth=self.of("maxDepth"), seed=seed, labelCol=self.of("labelCol"), featuresCol=self.of("featuresCol"), predictionCol=self.of("predictionCol")).fit(dataset)
        cuts = _cuts(seen[-width:] if width else [], self.of("maxBins"))
        subset = int(np.ceil(np.sqrt(width) if logistic else width / 3))
        unit = UNITS / max(seen["most"], 1e-300)
        grouped = rows.mapInArrow(_binner(cuts), "bins binary, y double").groupBy("bins", "y").agg(F.count("*").alias("n")).persist()
        tasks = min(-(-grouped.count() // TASK_CELLS), 2 * dataset.sparkSession.sparkContext.defaultParallelism)
        cells = grouped.repartition(max(tasks, 1), "bins", "y").sortWithinPartitions("bins", "y").persist()
        try:
            grown = self._grown(cells, cuts, trees, subset, unit, seed, float(seen["mean"]))
        finally:
            cells.unpersist()
            grouped.unpersist()
        return self._copyValues(ForestModel([_frozen(nodes, cuts, 1.0 / trees, 0.0) for nodes in grown], [len(c) for c in cuts]))

    def _grown(self, cells: DataFrame, cuts: list[np.ndarray], trees: int, subset: int, unit: float, seed: int, mean: float) -> list[list[Growing]]:
        grown = [[Growing(-mean, 1.0)] for _ in range(trees)]
        open_ = [(t, 0) for t in range(trees)]
        bins = sum(len(c) + 2 for c in cuts)
        for level in range(self.of("maxDepth")):
            most, following = max(CELLS // max(bins, 1), 1), []
            for at in range(0, len(open_), most):  # so that a task's sums have a bound
                part = open_[at : at + most]
                for k, g, h, split in _splits(cells, [_frozen(nodes, cuts, 0.0, 0.0) for nodes in grown], part, cuts, subset, unit, seed):
                    t, node = part[k]
                    nodes = grown[t]
                    if level == 0:
                        nodes[0].g, nodes[0].h = g, h
                    if split is None:
                        continue
                    gain, feature, cut, missing_left, gl, hl = split
                    nodes[node].split, nodes[node].left = (gain, feature, cut, missing_left), len(nodes)
                    following += [(t, len(nodes)), (t, len(nodes) + 1)]
                    nodes += [Growing(gl, hl), Growing(g - gl, h - hl)]
            if not (open_ := sorted(following)):
                break
        return grown


def _splits(cells: DataFrame, trees: list[Tree], open_: list[tuple[int, int]], cuts: list[np.ndarray], subset: int, unit: float, seed: int) -> list[tuple]:
    """Of each open node (tree, node), by its place: the sums of its rows and the best split, if it has one. A label counts as a gradient below zero."""
    width, sizes = len(cuts), np.array([len(c) + 2 for c in cuts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    bins, count = int(starts[-1]), len(trees)
    places: dict[int, np.ndarray] = {}
    for k, (t, node) in enumerate(open_):
        places.setdefault(t, np.full(len(trees[t].left), -1, np.int64))[node] = k

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(open_), bins), np.int64)
        met, number = np.zeros(len(open_), bool), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, DRAW_CELLS):
                some = batch.slice(lo, DRAW_CELLS)
                x = _matrix(some, width)
                slots = np.where(x == MISSING, (sizes - 1)[None, :], x) + starts[:-1][None, :]
                n, y = (some.column(c).to_numpy(zero_copy_only=False) for c in ("n", "y"))
                y = np.rint(y * unit)
                drawn = np.random.default_rng([seed, TaskContext.get().partitionId(), number]).poisson(n[:, None], (len(n), count))
                number += 1
                for t, place in places.items():
                    at = place[trees[t].leaves(x, True)]
                    use = np.flatnonzero((at >= 0) & (drawn[:, t] > 0))
                    if not len(use):
                        continue
                    first, last = int(at[use].min()), int(at[use].max()) + 1  # nodes of a tree stand together
                    key = ((at[use] - first) * bins)[:, None] + slots[use]
                    weight = drawn[use, t].astype(np.float64)
                    for side, v in zip(total, (weight, weight * y[use]), strict=True):
                        side[first:last] += np.bincount(key.ravel(), np.repeat(v, width), (last - first) * bins).astype(np.int64).reshape(last - first, bins)
                    met[at[use]] = True
        for lo in range(0, len(found := np.flatnonzero(met)), TASK_NODES):
            some = found[lo : lo + TASK_NODES]
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array([r.tobytes() for r in side[some]], pa.binary()) for side in total)], names=["node", "n", "s"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n, s in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "s")), strict=True):
                sums_ = np.stack([np.frombuffer(v, np.int64) for v in (n, s)])
                held[k] = held[k] + sums_ if k in held else sums_
        out = []
        for k, (n, s) in held.items():
            h, g = n.astype(np.float64), -s / unit
            best, all_ = None, slice(starts[0], starts[1])
            for f in sorted(np.random.default_rng([seed, *open_[k]]).choice(width, min(subset, width), replace=False).tolist()):
                here = slice(starts[f], starts[f + 1])
                gain, at, missing_left, gl, hl = (v[0].item() for v in best_splits(g[None, here], h[None, here], 0.0, 1.0))
                if not np.isnan(gain) and (best is None or gain > best[0]):
                    best = (gain, f, at, missing_left, gl, hl)
            out.append((k, g[all_].sum(), h[all_].sum(), *(best or (None,) * 6)))
        types = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=["node", "g", "h", "gain", "feature", "bin", "missing_left", "left_g", "left_h"])

    summed = cells.mapInArrow(sums, "node long, n binary, s binary").repartition(1 + len(open_) // TASK_NODES, "node")
    found = summed.mapInArrow(choose, "node long, g double, h double, gain double, feature long, bin long, missing_left boolean, left_g double, left_h double").toArrow()
    rows = zip(*(found.column(n).to_pylist() for n in found.column_names), strict=True)
    return [(k, g, h, None if gain is None else (gain, *rest)) for k, g, h, gain, *rest in sorted(rows, key=lambda r: r[0])] if width else []
