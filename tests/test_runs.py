"""Folds in time, work side by side, the run store, and encodings on a stream."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tablewright.functions import metrics as M
from tablewright.operators import dataset as D
from tablewright.operators import experiment as R
from tablewright.operators import features as X
from tablewright.operators import learners as L
from tablewright.operators import models as E
from tablewright.operators.run_store import RunStore
from tablewright.operators.side_by_side import SideBySide, kept
from tablewright.operators.time_folds import rolling_origin, time_folds
from tablewright.streaming.encoding import encode_stream


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, k // 2, float(k)) for k in range(100)] + [(500, None, 1.0)], "k int, t int, y double").repartition(3)


def constant(value):
    return lambda train: lambda test: test.withColumn("prediction", train.agg(value).first()[0] + F.lit(0.0))


def test_time_folds(rows):
    got = {r["k"]: r["fold"] for r in time_folds(rows, "t", "k", 3).collect()}
    assert got == {k: min(k // 25, 3) for k in range(100)} | {500: None}
    few = time_folds(rows.filter("k < 2"), "t", "k", 3).collect()
    assert {r["k"]: r["fold"] for r in few} == {0: 1, 1: 3}
    assert time_folds(rows.limit(0), "t", "k", 2).count() == 0
    with pytest.raises(ValueError, match="must be a fold"):
        time_folds(rows, "t", "k", 0)


def test_nothing_of_the_future_is_seen(spark, rows):
    seen = []

    def spy(train):
        seen.append(("fit", train.agg(F.max("t")).first()[0], train.count()))
        inner = constant(F.max("y"))(train)

        def predict(test):
            seen.append(("test", test.agg(F.min("t")).first()[0], test.count()))
            return inner(test)

        return predict

    out = rolling_origin(rows, "t", "k", {"latest": spy, "mean": constant(F.avg("y"))}, (M.mae(), M.rmse()), "y", folds=3, threads=1).collect()
    assert [(r["fold"], r["n_train"], r["n_test"], r["model"]) for r in out] == [(1, 25, 25, "latest"), (2, 50, 25, "latest"), (3, 75, 25, "latest")]
    assert [r["MAE"] for r in out] == pytest.approx([13.0] * 3)
    for fit, test in zip(seen[::2], seen[1::2], strict=True):
        assert fit[0] == "fit" and test[0] == "test" and fit[1] <= test[1]
    assert [x[2] for x in seen] == [17, 8, 25, 25, 35, 15, 50, 25, 52, 23, 75, 25]
    again = rolling_origin(rows, "t", "k", {"bad": constant(F.col("none")), "mean": constant(F.avg("y"))}, (M.mae(),), "y", folds=3).collect()
    assert [r["model"] for r in again] == ["mean"] * 3


def test_side_by_side_is_one_by_one(spark, rows):
    data = spark.range(1000)
    work = {f"w{k}": (lambda k=k: data.filter(F.col("id") % (k + 2) == 0).count()) for k in range(7)} | {"bad": lambda: 1 // 0, "worse": lambda: data.selectExpr("nothing").count()}
    out = SideBySide(spark, 3)(work)
    assert [x.name for x in out] == list(work) and [x.value for x in out[:7]] == [work[f"w{k}"]() for k in range(7)]
    assert out[7].error.startswith("ZeroDivisionError") and "nothing" in out[8].error and out[7].value is None
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    models = {"mean": constant(F.avg("y")), "max": constant(F.max("y"))}
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = [tuple(r) for r in E.compare(models | {"bad": lambda train: 1 // 0}, rows, rows, (M.mae(), M.r2()), "y", errors=True).collect()]
    assert [r[0] for r in got] == ["mean", "max", "bad"] and got[2][1] is None and "ZeroDivisionError" in got[2][3]
    assert got[0][1:3] == pytest.approx(tuple(M.evaluate(models["mean"](rows)(rows), (M.mae(), M.r2()), "y", "prediction").first()), abs=1e-9)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    with pytest.raises(RuntimeError, match="bad: ZeroDivisionError"):
        E.compare({"bad": lambda train: 1 // 0}, rows, rows, (M.mae(),), "y")
    with pytest.raises(KeyError), kept(rows) as (held,):
        assert held.is_cached
        raise KeyError
    assert not rows.is_cached


def test_a_cancelled_run_stops_its_jobs(spark):
    run = SideBySide(spark, 2)
    slow = spark.range(40).repartition(40).mapInPandas(lambda it: (time.sleep(1) or x for x in it), "id long")
    began, out = time.monotonic(), []
    worker = threading.Thread(target=lambda: out.extend(run({f"slow{k}": slow.count for k in range(4)})))
    worker.start()
    while not any(spark.sparkContext.statusTracker().getJobIdsForGroup(run.group(f"slow{k}")) for k in range(2)):
        time.sleep(0.05)
    run.cancel()
    worker.join(60)
    assert [x.error for x in out] == ["cancelled"] * 4 and time.monotonic() - began < 60
    groups = [run.group(f"slow{k}") for k in range(4)]
    assert not {j for g in groups for j in spark.sparkContext.statusTracker().getJobIdsForGroup(g)} & set(spark.sparkContext.statusTracker().getActiveJobsIds())


def test_run_store(spark, tmp_path):
    store = RunStore(spark, f"{tmp_path}/runs")
    assert store.runs.count() == 0 and store.best("songs", M.mae()).count() == 0
    for _ in range(2):  # written twice, there once
        with store.run("songs", "1", {"depth": 3}, "first") as run:
            for fold, v in enumerate((1.0, 2.0, 6.0)):
                run.metrics("tree", {"MAE": v}, fold)
            run.metrics("linear", {"MAE": 2.5, "R2": None})
            run.log("begun")
            run.log("done")
    with store.run("songs", "2", {"depth": 4}) as run:
        run.table(spark.createDataFrame([("tree", 0, 1.0), ("tree", 1, 1.5)], "model string, fold int, MAE double"), fold="fold")
    with store.run("other", "1"):
        pass
    with pytest.raises(ZeroDivisionError), store.run("songs", "3") as run:
        run.metrics("tree", {"MAE": 0.0})
        1 / 0
    assert store.values.count() == 8 and store.runs.count() == 4
    assert {(r["run_id"], r["model"]): (r["folds"], round(r["mean"], 6)) for r in store.means("songs").filter("metric = 'MAE' and run_id < '3'").collect()} == {("1", "tree"): (3, 3.0), ("1", "linear"): (0, 2.5), ("2", "tree"): (2, 1.25)}
    best = store.best("songs", M.mae()).first()
    assert (best["run_id"], best["model"], best["parameters"]) == ("2", "tree", {"depth": "4"})
    one = store.runs.filter("experiment = 'songs' and run_id = '1'").first()
    assert (one["log"], one["description"], one["failed"]) == ("begun\ndone", "first", None)
    assert store.runs.filter("run_id = '3'").first()["failed"].startswith("ZeroDivisionError")


def test_encodings_on_a_stream(spark, tmp_path):
    put = lambda k, groups: spark.createDataFrame([(k * 10 + i, g) for i, g in enumerate(groups)], "k int, g string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    encoding = lambda values: spark.createDataFrame(values, "g string, m double").write.mode("overwrite").parquet(f"{tmp_path}/encoding")
    run = lambda: encode_stream(spark, f"{tmp_path}/in", "k int, g string", {"m": ("g", f"{tmp_path}/encoding")}, f"{tmp_path}/out", f"{tmp_path}/check", {"m": 0.5})
    encoding([("a", 1.0), ("b", 2.0)])
    put(0, ["a", "b", "z", None])
    run()
    encoding([("a", 7.0), ("z", 9.0)])
    put(1, ["a", "b", "z"])
    for _ in range(2):  # the second run finds nothing new
        run()
    got = {r["k"]: (r["m"], r["m_missing"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: (1.0, 0), 1: (2.0, 0), 2: (0.5, 1), 3: (0.5, 1), 10: (7.0, 0), 11: (0.5, 1), 12: (9.0, 0)} and spark.read.parquet(f"{tmp_path}/out").count() == 7


def test_experiments_are_tracked(spark, tmp_path):
    rows = spark.createDataFrame([(k, float(k % 10), "abc"[k % 3], float(3 * (k % 10) + k % 3)) for k in range(150)], "k int, x double, g string, target double")
    units = (X.FeatureSpec(("x",), rule="standardise"),)
    linear = lambda name, *encoders: E.Learner(name, E.REGRESSORS["linear_regression"], units, encoders)
    learners = [linear("plain"), linear("encoded", X.TargetEncoder("g", F.col("target"), "g_mean"))]
    store, data = RunStore(spark, f"{tmp_path}/runs"), D.Dataset("k", "target", threshold=15)
    for _ in range(2):
        R.track_experiment(store, data, "songs", rows, learners, run="1", models=f"{tmp_path}/models")
        cv = R.track_experiment(store, data, "songs", rows, learners, run="1", cross_validated=True)
    single, folded = D.experiment_name("songs", data), D.experiment_name("songs", data, True)
    assert store.runs.count() == 2 and store.values.filter(F.col("experiment") == single).count() == 12 and store.values.filter(F.col("experiment") == folded).count() == 36
    best = store.best(single, M.r2()).first()
    stored = L.load_learner(spark, f"{tmp_path}/models/{data.tag}/best_model")
    assert stored.name == store.best(single, M.mae()).first()["model"] and "FeatureSpec" in best["parameters"]["model.plain"]
    assert "plain" in store.runs.filter(F.col("experiment") == single).first()["log"]
    means = {r["model"]: r["mean"] for r in store.means(folded).filter("metric = 'MAE'").collect()}
    assert means == pytest.approx({r["model"]: r["MAE"] for r in cv.collect()})
