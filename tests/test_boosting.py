"""Boosted trees against a plain version that tries every split of every node."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablewright.operators import boosting as B


def plain(x, y, cuts, rounds, depth, eta, reg_lambda, gamma, min_child, logistic, features_of, unit, base):
    """Trees as nested tuples (feature, threshold, missing left, left, right) with numbers as leaves, and the margins after them."""
    margin, trees = np.full(len(y), base), []

    def grow(rows, g, h, level, features):
        G, H = g[rows].sum() / unit, h[rows].sum() / unit
        leaf = -eta * G / (H + reg_lambda)
        best = None
        if level < depth:
            for f in features:
                for left in (False, True):
                    for b, c in enumerate([*cuts[f], np.inf]):
                        v = x[rows, f]
                        low = np.where(np.isnan(v), left, v <= c)
                        GL, HL = g[rows[low]].sum() / unit, h[rows[low]].sum() / unit
                        if HL < min_child or H - HL < min_child or HL <= 0 or H - HL <= 0:
                            continue
                        gain = GL**2 / (HL + reg_lambda) + (G - GL) ** 2 / (H - HL + reg_lambda) - G**2 / (H + reg_lambda)
                        if gain > B.EPSILON and (best is None or (round(gain, 9), -f, -b, not left) > (round(best[0], 9), -best[1], -best[2], not best[3])):
                            best = (gain, f, b, left, low)
        if best is None:
            return leaf
        gain, f, b, left, low = best
        one, two = grow(rows[low], g, h, level + 1, features), grow(rows[~low], g, h, level + 1, features)
        if gain < gamma and not isinstance(one, tuple) and not isinstance(two, tuple):
            return leaf
        return (f, [*cuts[f], np.inf][b], left, one, two)

    def at(tree, row):
        while isinstance(tree, tuple):
            v = row[tree[0]]
            tree = tree[3 if (tree[2] if np.isnan(v) else v <= tree[1]) else 4]
        return tree

    for k in range(rounds):
        g, h = (np.rint(v * unit) for v in B.gradients(margin, y, logistic))
        trees.append(grow(np.arange(len(y)), g, h, 0, features_of[k]))
        margin = margin + np.array([at(trees[-1], r) for r in x])
    return trees, margin


def nested(tree, k=0):
    if tree.left[k] < 0:
        return tree.value[k]
    return (tree.feature[k], tree.threshold[k], bool(tree.missing_left[k]), nested(tree, tree.left[k]), nested(tree, tree.left[k] + 1))


def same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    return a == pytest.approx(b, abs=1e-9) if not isinstance(a, tuple) else (a[0], a[2]) == (b[0], b[2]) and a[1] == pytest.approx(b[1]) and same(a[3], b[3]) and same(a[4], b[4])


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(160, 4)).round(2)
    x[:, 2] = rng.integers(0, 3, 160)
    x[rng.random(160) < 0.25, 1] = np.nan
    y = (2 * x[:, 0] + np.where(np.isnan(x[:, 1]), 3, x[:, 1]) * (x[:, 2] == 1) + rng.normal(scale=0.2, size=160)).round(3)
    rows = [(k, *[float(v) if not np.isnan(v) else None for v in x[k]], float(y[k])) for k in range(160)]
    table = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, y double").withColumn("x", F.array("a", "b", "c", "d"))
    return table.repartition(5).persist(), x, y


CASES = [
    {"rounds": 3, "maxDepth": 3, "regLambda": 1.0, "gamma": 0.0, "minChildWeight": 1.0, "colsample": 1.0},
    {"rounds": 12, "maxDepth": 2, "regLambda": 0.0, "gamma": 5.0, "minChildWeight": 6.0, "colsample": 0.5},
    {"rounds": 3, "maxDepth": 4, "regLambda": 0.4, "gamma": 1.5, "minChildWeight": 2.0, "colsample": 0.98, "objective": "logistic"},
]


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("cells", [B.CELLS, 1])
def test_split_by_split(spark, data, case, cells, monkeypatch):
    table, x, y = data
    monkeypatch.setattr(B, "CELLS", cells)
    logistic = case.get("objective") == "logistic"
    if logistic:
        table, y = table.withColumn("y", (F.col("y") > 0).cast("double")), (y > 0).astype(float)
    model = B.BoostedTrees(featuresCol="x", labelCol="y", seed=3, maxBins=16, **case).fit(table)
    cuts = B.bin_cuts(table.select(F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan")))).alias("x")), 4, 16)
    rng = np.random.default_rng(3)
    features = [sorted(rng.choice(4, max(1, int(case["colsample"] * 4)), replace=False).tolist()) for _ in range(case["rounds"])]
    base = np.log(y.mean() / (1 - y.mean())) if logistic else y.mean()
    unit = B.UNITS / max(1.0, 1.0 if logistic else max(y.max() - base, base - y.min()))
    trees, margin = plain(x, y, cuts, case["rounds"], case["maxDepth"], 0.3, case["regLambda"], case["gamma"], case["minChildWeight"], logistic, features, unit, base)
    assert len(model.trees) == len(trees) and all(same(nested(a), b) for a, b in zip(model.trees, trees, strict=True))
    got = {r["id"]: r["prediction"] for r in model.transform(table).collect()}
    want = (margin >= 0).astype(float) if logistic else margin
    assert [got[k] for k in range(160)] == pytest.approx(want, abs=1e-6)
    assert any(t.missing_left.any() for t in model.trees) or logistic


def test_round_trip(spark, data, tmp_path):
    table, _, y = data
    fitted = B.BoostedTrees(labelCol="y", rounds=4, maxDepth=3, probabilityCol="p", objective="logistic").fit(VectorAssembler(inputCols=["a", "b"], outputCol="features", handleInvalid="keep").transform(table.withColumn("y", (F.col("y") > 0).cast("double"))))
    pipeline = PipelineModel([VectorAssembler(inputCols=["a", "b"], outputCol="features", handleInvalid="keep"), fitted])
    pipeline.write().overwrite().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m")
    assert sorted(map(str, again.transform(table).select("id", "p", "prediction").collect())) == sorted(map(str, pipeline.transform(table).select("id", "p", "prediction").collect()))


def test_missing_against_known(spark):
    rows = spark.createDataFrame([([float(k % 3)], 0.0) for k in range(30)] + [([None], 9.0)] * 10, "x array<double>, y double")
    model = B.BoostedTrees(featuresCol="x", labelCol="y", rounds=1, maxDepth=3, eta=1.0, regLambda=0.0).fit(rows)
    assert {(r["x"][0] is None, round(r["prediction"], 4) + 0.0) for r in model.transform(rows).collect()} == {(True, 9.0), (False, 0.0)}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "x array<double>, y double")
    assert B.BoostedTrees(featuresCol="x", labelCol="y", rounds=2).fit(empty).trees == []
    rows = spark.createDataFrame([([1.0, None], 2.0), ([1.0, None], 4.0), ([1.0, None], None)], "x array<double>, y double")
    model = B.BoostedTrees(featuresCol="x", labelCol="y", rounds=5).fit(rows)
    assert [r["prediction"] for r in model.transform(rows).collect()] == [3.0, 3.0, 3.0] and len(model.trees) == 1
    with pytest.raises(ValueError, match="unknown objective"):
        B.BoostedTrees(featuresCol="x", labelCol="y", objective="none").fit(rows)


def test_rows_in_the_same_bins_are_one_cell(spark, monkeypatch):
    """What a level reads does not grow with the copies of rows, and the trees stay as they are."""
    read, level = [], B._level
    monkeypatch.setattr(B, "_level", lambda cells, *rest: (read.append(cells.count()), level(cells, *rest))[1])
    rows = spark.range(60).select(F.array((F.col("id") % 6).cast("double"), (F.col("id") % 5).cast("double")).alias("x"), (F.col("id") % 6 * (F.col("id") % 6) * 3 + F.col("id") % 5).cast("double").alias("y"))
    fit = lambda df: B.BoostedTrees(featuresCol="x", labelCol="y", rounds=2, maxDepth=2, regLambda=0.0, minChildWeight=0.0).fit(df)
    one, many = fit(rows), fit(rows.crossJoin(spark.range(20).select("id")))
    assert max(read) <= 30
    got, want = ([r["prediction"] for r in m.transform(rows).orderBy("x", "y").collect()] for m in (many, one))
    assert got == pytest.approx(want, abs=1e-5)


def test_wide_labels(spark):
    """Hessians keep their digits however far the labels lie apart."""
    rows = spark.createDataFrame([([float(k % 2)], 1e9 * (k % 2)) for k in range(40)], "x array<double>, y double")
    tree = B.BoostedTrees(featuresCol="x", labelCol="y", rounds=1, maxDepth=1, eta=1.0, regLambda=0.0).fit(rows).trees[0]
    assert sorted(tree.value[1:]) == pytest.approx([-5e8, 5e8], rel=1e-6)
