"""Nearest neighbours against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions import metrics as M
from tablewright.operators import models as E
from tablewright.operators import neighbours as N


def brute(q, t, itself):
    out = {}
    for k, x in q:
        best = min(((sum((a - b) ** 2 for a, b in zip(x, z, strict=True)), kt) for kt, z in t if itself or kt != k), default=None)
        if best is not None:
            out[k] = best[1]
    return out


def cases():
    rng = np.random.default_rng(4)
    spread = rng.normal(size=(500, 3)).round(3)
    lumps = np.concatenate([rng.normal(loc=c, scale=0.01, size=(120, 2)) for c in ((0, 0), (5, 5), (5, 5.1), (-40, 3))])
    return {"spread": spread, "lumps": lumps, "grid": rng.integers(0, 5, (400, 2)).astype(float), "one place": np.ones((300, 2)), "line": np.arange(300.0)[:, None] ** 2}


@pytest.mark.parametrize("name", list(cases()))
@pytest.mark.parametrize("itself", [False, True])
def test_all_pairs(spark, name, itself, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 20)
    x = cases()[name]
    columns = [f"c{n}" for n in range(x.shape[1])]
    df = spark.createDataFrame([(k, *map(float, v), f"y{k}") for k, v in enumerate(x)] + [(9000, *[None] * x.shape[1], "none")], f"k int, {', '.join(f'{c} double' for c in columns)}, y string")
    queries, train = (df.filter("k % 3 = 0 or k = 9000"), df) if not itself else (df.filter("k % 3 = 0"), df.filter("k % 3 <> 0"))
    work = spark.sparkContext.accumulator(0)
    rows = [(k, tuple(map(float, v))) for k, v in enumerate(x)]
    got = N.nearest_neighbour(queries, train, "k", columns, "y", itself, work).collect()
    want = brute([r for r in rows if r[0] % 3 == 0], [r for r in rows if not itself or r[0] % 3], itself)
    assert {r["query_key"]: r["neighbour_key"] for r in got} == want and len(got) == len(want) and all(r["neighbour_target"] == f"y{r['neighbour_key']}" for r in got)
    assert work.value < 0.7 * len(want) * len(rows)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 5.0, 2.0)], "k string, x double, y double")
    assert {r["query_key"]: r["neighbour_key"] for r in N.nearest_neighbour(df, df, "k", ["x"], "y").collect()} == {"a": "b", "b": "a"}
    one = df.filter("k = 'a'")
    assert N.nearest_neighbour(one, one, "k", ["x"], "y").count() == 0 and N.nearest_neighbour(one, one.limit(0), "k", ["x"], "y").count() == 0
    assert N.nearest_neighbour(one.limit(0), df, "k", ["x"], "y").count() == 0


def test_no_cross_join(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), F.rand(1).alias("x"), F.lit(1).alias("y"))
    plan = N.nearest_neighbour(df, df, "k", ["x"], "y")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_every_row_has_a_prediction_or_null(spark):
    train = spark.createDataFrame([(k, float(k), float(k % 2)) for k in range(40)], "k int, x double, target double")
    test = spark.createDataFrame([(100 + k, k + 0.1 if k else None, float(k % 2)) for k in range(8)], "k int, x double, target double")
    out = E.NearestNeighbour("nearest", "k", ("x",), "skip").fit(train).transform(test)
    assert {r["k"]: r["prediction"] for r in out.collect()} == {100 + k: float(k % 2) if k else None for k in range(8)}
    assert M.evaluate(out, (M.accuracy(),), "target", "prediction").first()[0] == pytest.approx(7 / 8)


def test_missing_labels_count(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", None), ("b", None), (None, "b"), (None, None)], "y string, p string")
    assert M.evaluate(rows, (M.accuracy(),), "y", "p").first()[0] == pytest.approx(2 / 5)
    cells = {(r["truth"], r["prediction"]): r["n"] for r in M.confusion_matrix(rows, "y", "p").collect()}
    assert len(cells) == 9 and {c: n for c, n in cells.items() if n} == {("a", "a"): 1, ("a", None): 1, ("b", None): 1, (None, "b"): 1, (None, None): 1}
    report = {r["label"]: r for r in M.classification_report(rows, "y", "p").collect()}
    assert report["accuracy"]["f1"] == pytest.approx(2 / 5) and report[None]["support"] == 2 and report["macro avg"]["support"] == 5
