"""Gradient-boosted trees of second order, as an estimator and a model of Spark ML.

Rows that fall into the same bins of all features go the same way through every tree, so they are one cell: its bins, its number of rows and the mean
of their labels. Where labels take LABELS values or fewer, a cell's rows have one label, so that every row's gradient is rounded by itself. A tree grows level by level. Each level is one pass over the cells: tasks sum gradients and hessians by node, feature and bin (a bin of
its own for missing values), the sums meet in one shuffle by node and feature, and the best split of each node comes back: one row for each node and feature.
Below the first level, once a node has SUBTREE cells or fewer, they meet in one task, which grows all below it: so a tree of a small table is two passes. The splits are the same.
Splits maximise GL^2/(HL+lambda) + GR^2/(HR+lambda) - G^2/(H+lambda); missing values go to the side where that is greater; both sides
need a hessian of ``minChildWeight``. Splits whose gain is below ``gamma`` are taken back from the leaves up. Sums are in whole
numbers of a small unit, so that they depend on no order.

Cells are kept as one byte a feature. Margins are brought up to date every REFRESH trees from the cells themselves, so a lost executor costs
one pass, and nothing but trees and best splits comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bin of a missing value, and the most bins of others.
MISSING, MOST_BINS = 255, 255
#: Trees after which margins are written into the cells again.
REFRESH = 10
#: Units of the whole numbers in which gradients and hessians are summed, for the greatest of the first gradients.
UNITS = 1 << 24
#: Hessians, which are 1 at most, have so many units at least, however great the gradients are.
LEAST_UNITS = 1 << 20
#: Distinct labels, about, up to which they are told apart within the same bins.
LABELS = 1000
#: A unit of gradients is so many units of labels.
FINER = 1 << 20
#: Cells of a task, about, and nodes and features whose splits one task chooses.
TASK_CELLS, TASK_SPLITS = 20_000, 1024
#: A task sums in one array up to so many cells, and batch by batch beyond that.
CELLS = 1 << 22
#: Cells of a node, at most, below which a task grows all levels by itself.
SUBTREE = 1 << 19
#: Gains of no more than this are no gains.
EPSILON = 1e-6


@dataclass
class Tree:
    """Nodes as arrays; -1 as the left child marks a leaf. Children stand next to each other."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    value: np.ndarray

    COLUMNS = ("feature", "bin", "threshold", "missing_left", "left", "value")

    def leaves(self, x: np.ndarray, binned: bool) -> np.ndarray:
        """The node at which each row ends; rows are bytes of bins or numbers with NaN as missing."""
        if not (x == MISSING if binned else np.isnan(x)).any():
            return self._known_leaves(x, self.bin if binned else self.threshold)
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows := rows[self.left[at[rows]] >= 0]):
            node = at[rows]
            value = x[rows, self.feature[node]]
            gone = value == MISSING if binned else np.isnan(value)
            low = value <= (self.bin if binned else self.threshold)[node]
            at[rows] = self.left[node] + ~np.where(gone, self.missing_left[node], low)
        return at

    def _known_leaves(self, x: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The same for rows without missing values: a leaf leads to itself."""
        inner, at = self.left >= 0, np.zeros(len(x), np.int64)
        left, ends = np.where(inner, self.left, np.arange(len(inner))), np.where(inner, ends, np.inf)
        flat, rows = x.ravel(), np.arange(len(x)) * x.shape[1]
        while inner[at].any():
            at = left.take(at) + (flat.take(rows + self.feature.take(at)) > ends.take(at))
        return at

    def of(self, x: np.ndarray, binned: bool) -> np.ndarray:
        return self.value[self.leaves(x, binned)]


@dataclass
class Growing:
    """A node while its tree grows: gradient and hessian, and its split if it has one."""

    g: float
    h: float
    split: tuple | None = None  #: gain, feature, bin, whether missing values go left
    left: int = -1


# --- statistics of a level ------------------------------------------------------------------------


def best_splits(g: np.ndarray, h: np.ndarray, reg_lambda: float, min_child: float) -> tuple[np.ndarray, ...]:
    """Of sums by bin (the last: missing), a row each: gain (NaN without a split), bin, whether missing values go left, and the sums of the left side; ties go to the smaller bin, then to the right."""
    total_g, total_h = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
    at, sides = np.arange(len(g)), []
    for left in (False, True):
        gl, hl = np.cumsum(g[:, :-1], 1) + left * g[:, -1:], np.cumsum(h[:, :-1], 1) + left * h[:, -1:]
        gr, hr = total_g - gl, total_h - hl
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = gl * gl / (hl + reg_lambda) + gr * gr / (hr + reg_lambda) - total_g * total_g / (total_h + reg_lambda)
        ok = (hl >= min_child) & (hr >= min_child) & (hl > 0) & (hr > 0)
        gain = np.where(ok, gain, -np.inf)
        k = gain.argmax(1)
        sides.append((gain[at, k], k, gl[at, k], hl[at, k]))
    (gain, k, *_), (left_gain, left_k, *_) = sides
    missing_left = (left_gain > gain) | ((left_gain == gain) & (left_k < k))
    gain, k, gl, hl = (np.where(missing_left, y, x) for x, y in zip(*sides, strict=True))
    return np.where(gain > EPSILON, gain, np.nan), k, missing_left, gl, hl


def gradients(margin: np.ndarray, y: np.ndarray, logistic: bool) -> tuple[np.ndarray, np.ndarray]:
    if not logistic:
        return margin - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-margin))
    return p - y, np.maximum(p * (1 - p), 1e-16)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, width)


def _level(cells: DataFrame, recent: list[Tree], growing: Tree, open_: list[int], features: list[int], width: int, logistic: bool, unit: float, reg_lambda: float, min_child: float) -> dict[int, tuple[float, float, tuple | None]]:
    """Of each open node the sums of its rows and the best split, if it has one: gain, feature, bin, missing to the left, sums of the left side."""
    place = np.full(len(growing.left), -1, np.int64)
    place[open_] = np.arange(len(open_))
    bins, pairs = MISSING + 1, len(open_) * len(features)
    chosen, both = np.array(features), (unit, max(unit, LEAST_UNITS))

    def out(keys: np.ndarray, g: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        feature, rest = np.divmod(keys, len(open_) * bins)
        arrays = [rest // bins, feature, rest % bins, g, h]
        return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in arrays], names=["node", "feature", "bin", "g", "h"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = [np.zeros((len(features), len(open_) * bins), np.int64) for _ in range(2)] if pairs * bins <= CELLS else None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, width)
            margin, n, y = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("margin", "n", "y"))
            for tree in recent:
                margin += tree.of(x, True)
            node = place[growing.leaves(x, True)]
            some = np.flatnonzero(node >= 0)
            g, h = (n[some] * np.rint(v * units).astype(np.int64) for v, units in zip(gradients(margin[some], y[some], logistic), both, strict=True))
            key = node[some, None] * bins + x[some][:, chosen]
            if dense is not None:
                for total, v in zip(dense, (g, h), strict=True):
                    for k in range(len(features)):
                        _add(total[k], key[:, k], v)
            else:
                keys, *totals = _merged((key + np.arange(len(features)) * (len(open_) * bins)).T.ravel(), np.tile(g, len(features)), np.tile(h, len(features)))
                yield out(keys, *totals)
        if dense is not None and len(at := np.flatnonzero((dense[0] != 0) | (dense[1] != 0))):
            yield out(at, dense[0].ravel()[at], dense[1].ravel()[at])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            node, feature, at, g, h = (batch.column(c).to_numpy() for c in ("node", "feature", "bin", "g", "h"))
            parts.append(((feature * len(open_) + node) * bins + at, g, h))
            held += len(g)
            if held > CELLS:
                parts, held = [_merged(*map(np.concatenate, zip(*parts, strict=True)))], 0
        if not parts:
            return
        keys, *sums = _merged(*map(np.concatenate, zip(*parts, strict=True)))
        pair, at = np.divmod(keys, bins)
        known, row = np.unique(pair, return_inverse=True)
        for lo in range(0, len(known), TASK_SPLITS):
            here = (row >= lo) & (row < lo + TASK_SPLITS)
            g, h = (np.zeros((len(known[lo : lo + TASK_SPLITS]), bins)) for _ in range(2))
            for total, v, units in zip((g, h), sums, both, strict=True):
                total[row[here] - lo, at[here]] = v[here] / units
            gain, k, missing_left, left_g, left_h = best_splits(g, h, reg_lambda, min_child)
            feature, node = np.divmod(known[lo : lo + TASK_SPLITS], len(open_))
            arrays = [pa.array(node), pa.array(feature), pa.array(gain, from_pandas=True), *(pa.array(v) for v in (k, missing_left, left_g, left_h, g.sum(1), h.sum(1)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "feature", "gain", "bin", "missing_left", "left_g", "left_h", "g", "h"])

    summed = cells.mapInArrow(sums, "node long, feature long, bin long, g long, h long").repartition(1 + pairs // TASK_SPLITS, "node", "feature")
    found = summed.mapInArrow(choose, "node long, feature long, gain double, bin long, missing_left boolean, left_g double, left_h double, g double, h double").toArrow()
    best: dict[int, tuple] = {}
    rows = zip(*(found.column(n).to_pylist() for n in found.column_names), strict=True)
    for node, feature, gain, at, missing_left, left_g, left_h, g, h in sorted(rows, key=lambda r: (r[0], -(r[2] or 0.0), r[1])):
        best.setdefault(open_[node], (g, h, None if gain is None else (gain, features[feature], at, missing_left, left_g, left_h)))
    return best


def grown(x: np.ndarray, g: np.ndarray, h: np.ndarray, both: tuple[float, float], depth: int, features: list[int], reg_lambda: float, min_child: float) -> list[tuple]:
    """All splits below a node of which these are the cells, level by level: place (children have the next two), gain, feature, bin, missing to the left, sums of the left side."""
    bins, place, open_, taken, out = MISSING + 1, np.zeros(len(x), np.int64), [0], 1, []
    for _ in range(depth):
        pairs = len(features) * len(open_)
        sums = [np.zeros((len(features), len(open_) * bins), np.int64) for _ in range(2)]
        for k, f in enumerate(features):
            key = place * bins + x[:, f]
            for total, v in zip(sums, (g, h), strict=True):
                _add(total[k], key, v)
        parts = []
        for lo in range(0, pairs, TASK_SPLITS):
            some = [total.reshape(pairs, bins)[lo : lo + TASK_SPLITS] / units for total, units in zip(sums, both, strict=True)]
            parts.append(best_splits(*some, reg_lambda, min_child))
        gain, at, missing_left, *rest = (np.concatenate(v).reshape(len(features), len(open_)) for v in zip(*parts, strict=True))
        best, column = np.where(np.isnan(gain), -np.inf, gain).argmax(0), np.arange(len(open_))
        split = ~np.isnan(gain[best, column])
        chosen = np.array(features)[best]
        for k in np.flatnonzero(split):
            out.append((open_[k], float(gain[best[k], k]), int(chosen[k]), int(at[best[k], k]), bool(missing_left[best[k], k]), *(float(v[best[k], k]) for v in rest)))
        open_, taken = list(range(taken, taken + 2 * int(split.sum()))), taken + 2 * int(split.sum())
        if not open_:
            break
        keep = np.flatnonzero(split[place])
        x, g, h, place = x[keep], g[keep], h[keep], place[keep]
        value = x[np.arange(len(x)), chosen[place]]
        low = np.where(value == MISSING, missing_left[best, column][place], value <= at[best, column][place])
        place = 2 * (np.cumsum(split) - 1)[place] + ~low
    return out


def _subtrees(cells: DataFrame, recent: list[Tree], growing: Tree, small: dict[int, int], sizes: list[float], features: list[int], width: int, logistic: bool, unit: float, reg_lambda: float, min_child: float) -> dict[int, list[tuple]]:
    """Of each small node, with the levels that are left for it, all splits below it as ``grown`` gives them."""
    place = np.full(len(growing.left), -1, np.int64)
    place[list(small)] = list(small)
    both = (unit, max(unit, LEAST_UNITS))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, width)
            margin, n, y = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("margin", "n", "y"))
            for tree in recent:
                margin += tree.of(x, True)
            node = place[growing.leaves(x, True)]
            g, h = (n * np.rint(v * units).astype(np.int64) for v, units in zip(gradients(margin, y, logistic), both, strict=True))
            order = np.argsort(node, kind="stable")
            order = order[np.searchsorted(node[order], 0) :]
            if len(order):
                rows = np.split(order, np.flatnonzero(np.diff(node[order])) + 1)
                arrays = [pa.array([int(node[r[0]]) for r in rows], pa.int64()), *(pa.array([v[r].tobytes() for r in rows], pa.binary()) for v in (x, g, h))]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "bins", "g", "h"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for node, *row in zip(*(batch.column(n).to_pylist() for n in ("node", "bins", "g", "h")), strict=True):
                held.setdefault(node, []).append(tuple(row))
        for node in sorted(held):
            x, g, h = (np.frombuffer(b"".join(v), kind) for v, kind in zip(zip(*held.pop(node), strict=True), (np.uint8, np.int64, np.int64), strict=True))
            splits = grown(x.reshape(len(g), width), g, h, both, small[node], features, reg_lambda, min_child)
            if splits:
                at, *columns = (list(v) for v in zip(*splits, strict=True))
                kinds = [pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64()]
                arrays = [pa.array([node] * len(at), pa.int64()), pa.array(at, pa.int64()), *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "at", "gain", "feature", "bin", "missing_left", "left_g", "left_h"])

    tasks = min(len(small), 1 + int(4 * sum(sizes) / SUBTREE))
    found = cells.mapInArrow(dealt, "node long, bins binary, g binary, h binary").repartition(tasks, "node")
    rows = found.mapInArrow(grow, "node long, at long, gain double, feature long, bin long, missing_left boolean, left_g double, left_h double").toArrow()
    out: dict[int, list[tuple]] = {}
    for node, *split in sorted(zip(*(rows.column(n).to_pylist() for n in rows.column_names), strict=True), key=lambda r: r[:2]):
        out.setdefault(node, []).append(tuple(split))
    return out


def _add(total: np.ndarray, key: np.ndarray, values: np.ndarray) -> None:
    """Add whole numbers at their keys: by doubles while these hold them exactly."""
    if len(key) < 64 or np.abs(values.astype(np.float64)).sum() >= 2.0**52:
        np.add.at(total, key, values)
    else:
        total += np.bincount(key, weights=values, minlength=len(total)).astype(np.int64)


def _merged(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


def _frozen(nodes: list[Growing], cuts: list[np.ndarray], eta: float, reg_lambda: float) -> Tree:
    split = [n.split or (0.0, 0, 0, False) for n in nodes]
    # Beyond the last cut there are no known values on the right, only missing ones.
    threshold = [float(cuts[s[1]][s[2]]) if s[2] < len(cuts[s[1]]) else float("inf") for s in split]
    value = [0.0 if n.left >= 0 or n.h + reg_lambda <= 0 else -eta * n.g / (n.h + reg_lambda) for n in nodes]
    return Tree(np.array([s[1] for s in split]), np.array([s[2] for s in split]), np.array(threshold), np.array([s[3] for s in split], bool), np.array([n.left for n in nodes]), np.array(value))


def pruned(nodes: list[Growing], gamma: float) -> list[Growing]:
    """Take back splits into two leaves that gain less than gamma, until none is left; nodes that are cut off go."""
    for n in reversed(nodes):  # children come after their parents
        if n.left >= 0 and nodes[n.left].left < 0 and nodes[n.left + 1].left < 0 and n.split[0] < gamma:
            n.split, n.left = None, -1
    out, at = [], [0]
    for k in at:
        out.append(nodes[k])
        if nodes[k].left >= 0:
            at += [nodes[k].left, nodes[k].left + 1]
    place = {k: i for i, k in enumerate(at)}
    for k, n in zip(at, out, strict=True):
        n.left = place[n.left] if n.left >= 0 else -1
    return out


# --- the estimator ----------------------------------------------------------------------------------


class _BoostingParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasSeed):
    objective = Param(Params._dummy(), "objective", "squared or logistic", TypeConverters.toString)
    rounds = Param(Params._dummy(), "rounds", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits of a tree", TypeConverters.toInt)
    eta = Param(Params._dummy(), "eta", "what a tree's values are multiplied with", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "added to hessians", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "least gain of a split", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least hessian of a side of a split", TypeConverters.toFloat)
    colsample = Param(Params._dummy(), "colsample", "share of the features that a tree may use", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "most bins of a feature, up to 255", TypeConverters.toInt)
    base = Param(Params._dummy(), "base", "the margin before all trees", TypeConverters.toFloat)

    def _defaults(self) -> None:
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="", seed=42, objective="squared", rounds=100, maxDepth=6, eta=0.3, regLambda=1.0, gamma=0.0, minChildWeight=1.0, colsample=1.0, maxBins=255, base=0.0)

    def of(self, name: str):
        return self.getOrDefault(name)


def _values(df: DataFrame, features: str):
    """The features as an array of doubles; null and NaN in it are missing values."""
    return F.col(features).cast("array<double>") if df.schema[features].dataType.typeName() == "array" else vector_to_array(features)


def bin_cuts(rows: DataFrame, width: int, most: int) -> list[np.ndarray]:
    """Upper ends of the bins of each feature but for the last bin: quantiles, and the least value."""
    return _cuts(rows.agg(*_cuts_of(width, most)).first(), most)


def _cuts_of(width: int, most: int) -> list[Column]:
    shares = [k / most for k in range(1, most)]
    x = lambda i: F.when(~F.isnan(F.col("x")[i]), F.col("x")[i])
    return [F.concat(F.array(F.min(x(i))), F.coalesce(F.percentile_approx(x(i), shares, 100 * most), F.array().cast("array<double>"))).alias(f"c{i}") for i in range(width)]


def _cuts(found: Iterable[list[float]], most: int) -> list[np.ndarray]:
    return [np.unique(np.array([v for v in c if v is not None], np.float64))[: most - 1] for c in found]


class BoostedTrees(Estimator, _BoostingParams):
    """Rows without a label are left out; NaN and null in the features are missing values."""

    def __init__(self, **params):
        super().__init__()
        self._defaults()
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        if self.of("objective") not in ("squared", "logistic"):
            raise ValueError(f"unknown objective: {self.of('objective')}")
        if not 2 <= self.of("maxBins") <= MOST_BINS:
            raise ValueError(f"maxBins must be 2 to {MOST_BINS}")
        logistic, rng = self.of("objective") == "logistic", np.random.default_rng(self.of("seed"))
        label = F.col(self.of("labelCol")).cast("double")
        rows = dataset.select(_values(dataset, self.of("featuresCol")).alias("x"), label.alias("y")).filter("y is not null")
        one = rows.select(F.size("x")).first()
        if one is None:
            return self._copyValues(BoostedTreesModel([], []))
        width = one[0]
        seen = rows.agg(F.avg("y").alias("mean"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.approx_count_distinct("y").alias("labels"), *_cuts_of(width, self.of("maxBins"))).first()
        mean, cuts = seen["mean"], _cuts(seen[-width:] if width else [], self.of("maxBins"))
        base = float(np.log(min(max(mean, 1e-6), 1 - 1e-6) / (1 - min(max(mean, 1e-6), 1 - 1e-6)))) if logistic else mean
        unit = UNITS / max(1.0, 1.0 if logistic else max(seen["hi"] - base, base - seen["lo"]))
        binned = rows.mapInArrow(_binner(cuts), "bins binary, y double")
        # Labels are summed in whole numbers, which depend on no order.
        fine = unit * FINER
        total = F.sum(F.rint((F.col("y") - mean) * fine).cast("decimal(20,0)"))
        label = F.when(F.lit(seen["labels"] <= LABELS), F.col("y"))
        every = binned.groupBy("bins", label.alias("label")).agg(F.count("*").alias("n"), total.alias("total"))
        every = every.select("bins", "n", F.coalesce("label", F.col("total").cast("double") / F.col("n") / fine + mean).alias("y"), F.lit(float(base)).alias("margin")).persist()
        count = every.count()
        cells = every.coalesce(-(-count // TASK_CELLS))  # small tables in few tasks
        now, trees, done = cells, [], 0
        try:
            for _ in range(self.of("rounds")):
                if len(trees) - done == REFRESH:
                    fresh = cells.mapInArrow(_refresher(trees, width), cells.schema).persist()
                    if now is not cells:
                        now.unpersist()
                    now, done = fresh, len(trees)
                features = sorted(rng.choice(width, max(1, int(self.of("colsample") * width)), replace=False).tolist())
                trees.append(self._tree(now, count, trees[done:], features, cuts, width, logistic, unit))
                if trees[-1].left[0] < 0 and self.of("colsample") == 1:
                    break  # all later trees would be alike
        finally:
            if now is not cells:
                now.unpersist()
            every.unpersist()
        return self._copyValues(BoostedTreesModel(trees, [len(c) for c in cuts]))._set(base=base)

    def _tree(self, cells: DataFrame, count: int, recent: list[Tree], features: list[int], cuts: list[np.ndarray], width: int, logistic: bool, unit: float) -> Tree:
        reg_lambda, nodes, open_, small, sizes = self.of("regLambda"), [Growing(0.0, 0.0)], [0], {}, []
        asked = (features, width, logistic, unit, reg_lambda, self.of("minChildWeight"))

        def split(k: int, gain: float, feature: int, at: int, missing_left: bool, g: float, h: float) -> list[int]:
            nodes[k].split, nodes[k].left = (gain, feature, at, missing_left), len(nodes)
            nodes.extend([Growing(g, h), Growing(nodes[k].g - g, nodes[k].h - h)])
            return [len(nodes) - 2, len(nodes) - 1]

        for level in range(self.of("maxDepth")):
            for k in open_ if level else []:
                most = count if logistic else min(count, nodes[k].h)  # a row's hessian is 1 if squares are summed
                if most <= SUBTREE:
                    small[k] = self.of("maxDepth") - level
                    sizes.append(most)
            open_ = [k for k in open_ if k not in small]
            if not open_:
                break
            best = _level(cells, recent, _frozen(nodes, cuts, 0.0, reg_lambda), open_, *asked)
            following = []
            for k in sorted(best):
                if level == 0:
                    nodes[0].g, nodes[0].h = best[k][:2]
                if best[k][2] is not None:
                    following += split(k, *best[k][2])
            open_ = following
        if small:
            for k, rows in _subtrees(cells, recent, _frozen(nodes, cuts, 0.0, reg_lambda), small, sizes, *asked).items():
                below = [k]
                for at, *found in rows:
                    below += split(below[at], *found)
        return _frozen(pruned(nodes, self.of("gamma")), cuts, self.of("eta"), reg_lambda)


def _binner(cuts: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _array(batch.column("x"), len(cuts))
            out = np.full(x.shape, MISSING, np.uint8)
            for k, c in enumerate(cuts):
                known = ~np.isnan(x[:, k])
                out[known, k] = np.searchsorted(c, x[known, k], side="left")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in out], pa.binary()), batch.column("y")], names=["bins", "y"])

    return run


def _array(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width) if width else np.zeros((len(column), 0))


def _refresher(trees: list[Tree], width: int):
    trees = list(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = batch.column("margin").to_numpy(zero_copy_only=False).copy()
            x = _matrix(batch, width)
            for tree in trees:
                margin += tree.of(x, True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bins", "n", "y")), pa.array(margin)], names=["bins", "n", "y", "margin"])

    return run


class BoostedTreesModel(Model, _BoostingParams, MLWritable, MLReadable):
    """Adds the prediction (squared: the margin; logistic: 1.0 from a probability of one half on) and, if a column is named for it, the probability."""

    def __init__(self, trees: list[Tree] | None = None, bins: list[int] | None = None):
        super().__init__()
        self._defaults()
        self.trees, self.bins = trees or [], bins or []

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, base, logistic = list(self.trees), self.of("base"), self.of("objective") == "logistic"

        @F.arrow_udf("double")
        def margin(values: pa.Array) -> pa.Array:
            x = _array(values, len(values.flatten()) // max(len(values), 1))
            return pa.array(base + sum((t.of(x, False) for t in trees), np.zeros(len(values))))

        x = _values(dataset, self.of("featuresCol"))
        if not logistic:
            return dataset.withColumn(self.of("predictionCol"), margin(x))
        name = self.of("probabilityCol") or "_probability"
        out = dataset.withColumn(name, 1 / (1 + F.exp(-margin(x)))).withColumn(self.of("predictionCol"), (F.col(name) >= 0.5).cast("double"))
        return out if self.of("probabilityCol") else out.drop(name)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    """Parameters as Spark ML has them, and the nodes of all trees as a table."""

    def __init__(self, model: BoostedTreesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        nodes = [(t, k, *(getattr(tree, n)[k].item() for n in Tree.COLUMNS)) for t, tree in enumerate(self.model.trees) for k in range(len(tree.left))]
        self.sparkSession.createDataFrame(nodes, "tree int, node int, feature int, bin int, threshold double, missing_left boolean, left int, value double").coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> BoostedTreesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        nodes = self.sparkSession.read.parquet(f"{path}/trees").orderBy("tree", "node").toPandas()
        trees = [Tree(*[t[n].to_numpy() for n in Tree.COLUMNS]) for _, t in nodes.groupby("tree")]
        model = self.cls(trees)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
