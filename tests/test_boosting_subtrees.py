"""Small nodes are grown in one task, with the splits that level by level gives."""

import numpy as np
import pytest

from tablewright.operators import boosting


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(900, 4)), 1)
    x[rng.random(x.shape) < 0.1] = np.nan
    y = np.nan_to_num(x[:, 0] * x[:, 1]) + (x[:, 2] > 0) + rng.normal(scale=0.3, size=900)
    data = [([None if np.isnan(v) else float(v) for v in r], float(t), float(t > 0.5)) for r, t in zip(x, y, strict=True)]
    frame = spark.createDataFrame(data, "features array<double>, target double, hit double").persist()
    yield frame
    frame.unpersist()


def same(a, b):
    return len(a.trees) == len(b.trees) and all(np.array_equal(getattr(s, n), getattr(t, n)) for s, t in zip(a.trees, b.trees, strict=True) for n in boosting.Tree.COLUMNS)


@pytest.mark.parametrize("objective", ["squared", "logistic"])
def test_the_trees_are_those_of_level_by_level(rows, monkeypatch, objective):
    made = lambda: boosting.BoostedTrees(objective=objective, labelCol="target" if objective == "squared" else "hit", rounds=3, maxDepth=5, gamma=0.05, colsample=0.8, minChildWeight=2.0).fit(rows)
    monkeypatch.setattr(boosting, "SUBTREE", 0)
    want = made()
    assert max(len(t.left) for t in want.trees) > 9
    for most in (60, 300, 1 << 19):
        monkeypatch.setattr(boosting, "SUBTREE", most)
        assert same(made(), want)


def test_a_tree_of_a_small_table_is_two_passes(spark, rows):
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    begun = store.executionsCount()
    model = boosting.BoostedTrees(labelCol="target", rounds=5, maxDepth=6).fit(rows)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert len(model.trees) == 5 and store.executionsCount() - begun <= 15  # one for each level: more than 30


def test_leaves_and_empty_tasks(spark):
    flat = spark.createDataFrame([([float(k)], 1.0) for k in range(20)], "features array<double>, target double")
    model = boosting.BoostedTrees(labelCol="target", rounds=2, maxDepth=3).fit(flat)
    assert [t.left.tolist() for t in model.trees] == [[-1]] and model.transform(flat).select("prediction").distinct().count() == 1
