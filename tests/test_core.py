"""Literal frames, published metrics, round trips of sources and sinks, learners and searches."""

import json
import logging
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import metrics as M
from tablewright.operators import dataset as D
from tablewright.operators import experiment as R
from tablewright.operators import features as X
from tablewright.operators import models as E
from tablewright.operators import profile as P
from tablewright.sources import io
from tablewright.streaming.scoring import score_stream

#: Published confusion matrices (rows: truth) and the figures printed with them.
GOLDEN = [
    (("low", "popular"), [[284506, 6], [15891, 9]], 0.947082673128903, (0.60, 0.00, 0.00)),
    (("low", "popular"), [[270730, 13782], [13181, 2719]], 0.910246594676644, (0.16, 0.17, 0.17)),
    (("low", "popular"), [[284320, 192], [15618, 282]], 0.947372275408439, (0.59, 0.02, 0.03)),
    (("low", "popular"), [[284512, 0], [15900, 0]], 0.9470726868434018, (0.0, 0.0, 0.0)),
    (("popular", "unpopular"), [[12, 123], [134, 2731]], 0.9143333333333333, (0.08, 0.09, 0.09)),
]


@pytest.mark.parametrize("labels,matrix,accuracy,popular", GOLDEN)
def test_published_metrics(spark, labels, matrix, accuracy, popular):
    cells = [(t, p, matrix[i][j]) for i, t in enumerate(labels) for j, p in enumerate(labels) if matrix[i][j]]
    rows = spark.createDataFrame(cells, "y string, p string, n long").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("y", "p")
    got = M.evaluate(rows, M.classification("popular"), "y", "p").first()
    assert got["accuracy"] == pytest.approx(accuracy, abs=1e-12)
    assert tuple(round(got[n], 2) for n in ("precision", "recall", "F1")) == popular
    counts = {(r["truth"], r["prediction"]): r["n"] for r in M.confusion_matrix(rows, "y", "p").collect()}
    assert all(counts.get((t, p), 0) == matrix[i][j] for i, t in enumerate(labels) for j, p in enumerate(labels))
    report = {r["label"]: r for r in M.classification_report(rows, "y", "p").collect()}
    assert (round(report["popular"]["precision"], 2), round(report["popular"]["recall"], 2)) == popular[:2] and report["accuracy"]["f1"] == pytest.approx(accuracy)


def test_metric_identities(spark):
    rows = spark.createDataFrame([(float(k), float(k + (-1) ** k * (k % 3))) for k in range(50)] , "y double, p double")
    got = M.evaluate(rows, M.REGRESSION, "y", "p").first()
    assert got["RRSE"] == pytest.approx((1 - got["R2"]) ** 0.5) and got["RMSE"] == pytest.approx(got["MSE"] ** 0.5)
    within = M.evaluate(spark.createDataFrame([(0.0, 9.0), (0.0, 10.0), (0.0, 11.0)], "y double, p double"), (M.rel_freq_within(10),), "y", "p").first()[0]
    assert within == pytest.approx(2 / 3)
    assert 2 * 0.710075 * 0.297486 / (0.710075 + 0.297486) == pytest.approx(0.419305, abs=1e-6)


def test_leave_one_out(spark):
    train = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, "a", 1), (4, "b", 1), (5, None, 1), (6, None, 0)], "id int, grp string, y int")
    got = {r["id"]: r["loo"] for r in X.leave_one_out(train, "grp", F.col("y"), "loo").collect()}
    assert got == {1: 0.5, 2: 1.0, 3: 0.5, 4: None, 5: 0.0, 6: 1.0}
    encoding = X.TargetEncoder("grp", F.col("y"), "loo").fit(train)
    assert {r["id"]: r["loo"] for r in encoding.transform_train(train).collect()} == got
    new = {r["id"]: r["loo"] for r in encoding.transform(spark.createDataFrame([(5, "a"), (6, "z")], "id int, grp string")).collect()}
    assert new[5] == pytest.approx(2 / 3) and new[6] is None


def test_cleaning(spark):
    rows = spark.createDataFrame([(1.0, "x"), (None, "x"), (float("nan"), "x"), (1.0, None)], "a double, s string")
    assert [tuple(r) for r in D.drop_missing(rows).collect()] == [(1.0, "x")]
    marks = spark.createDataFrame([(49,), (50,), (51,)], "v int").select(D.label("v", 50).alias("x")).collect()
    assert [r["x"] for r in marks] == ["unpopular", "popular", "popular"]
    with pytest.raises(ValueError, match="missing columns: b"):
        D.require_columns(rows, "a", "b")
    assert D.numeric_columns(rows) == ["a"]


def test_dataset(spark):
    rows = spark.createDataFrame([(k, k % 3) for k in range(30)], "k int, y int")
    data = D.Dataset("k", "y", num_samples=10, drop_zero=True, threshold=2, seed=23)
    out = data.load(rows)
    assert out.count() == 10 and out.filter("y = 0").count() == 0 and out.filter("(y >= 2) <> (popularity_class = 'popular')").count() == 0
    assert D.Dataset("k", "y", num_samples=10000, seed=23).tag == "numSamples10000-seed23" and D.Dataset("k", "y").tag == "full"
    assert D.experiment_name("songs", D.Dataset("k", "y"), True) == "songs_full_CV" and "num_samples=10" in repr(data)


@pytest.mark.parametrize("n", [0, 1, 3, 7, 12, 17, 20, 40])
def test_samples_and_splits_are_exact(spark, n):
    rows = [(k, "x%d" % k) for k in range(6)] + [(None, "n%d" % k) for k in range(4)] + [(5, "again%d" % k) for k in range(4)] + [(9, "same")] * 6
    df = spark.createDataFrame(rows, "key int, v string")
    assert D.sample_exact(df, "key", n).count() == min(n, 20)
    flagged = D.first_by_hash(df, "key", n, 42, "f").collect()
    assert sorted(map(str, ((r["key"], r["v"]) for r in flagged))) == sorted(map(str, rows)) and sum(r["f"] for r in flagged) == min(n, 20)
    split = D.split_train_test(df, "key", "0.25").collect()
    assert len(split) == 20 and sum(r["is_test"] for r in split) == 5
    assert df.withColumn("fold", D.fold_of("key", 3)).filter("fold is null").count() == 0


def test_split_size_is_rounded_up(spark):
    got = D.split_train_test(spark.range(10).toDF("k"), "k", "0.25").collect()
    assert sum(r["is_test"] for r in got) == 3 and len(got) == 10
    timed = D.split_by_time(spark.createDataFrame([(1, 5), (2, 5), (3, 9), (4, None)], "k int, t int"), "t", "k", "0.5").collect()
    assert {r["k"]: r["is_test"] for r in timed} == {1: False, 2: True, 3: True, 4: False}


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (3.0, 3.0), (4.0, 3.0)], "x double, c double")
    assert X.scales(df, {"x": "standardise"})["x"] == (2.5, pytest.approx(1.118033988749895))
    fitted = X.scales(df, {"c": "standardise", "x": "minmax"})
    out = df.select(*X.scaled(fitted)).collect()
    assert [r["c"] for r in out] == [0.0] * 4 and [r["x"] for r in out] == pytest.approx([0, 1 / 3, 2 / 3, 1])
    hot = spark.createDataFrame([("a",), ("c",), (None,)], "k string").select(*X.one_hot("k", ["a", "b"])).collect()
    assert [tuple(r) for r in hot] == [(1, 0), (0, 0), (0, 0)]
    filled = X.impute_mean(spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double"), ["x"]).collect()
    assert [(r["x"], r["x_missing"]) for r in filled] == [(1.0, 0), (3.0, 0), (2.0, 1)]


def test_profiles(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2).cast("double").alias("y"))
    bins = {r["bin"]: r["n"] for r in P.histogram(df, "x").collect()}
    assert max(bins) == 49 and bins[49] == 3 and sum(bins.values()) == 101
    assert P.strong_pairs(P.correlations(df, ["x", "y"])).filter("a <> b and r = 1").count() == 0
    assert P.scatter(df, "x", "y").count() == 101 and P.scatter(df, "x", "y", most=20).count() <= 20
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=500), rng.integers(0, 4, 300).astype(float), np.full(7, 3.0), np.array([1.0, 1e12, -5.0])):
        got = P.describe(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double"), ["v"]).first()
        assert (got["q1"], got["median"], got["q3"]) == pytest.approx(tuple(np.quantile(values, [0.25, 0.5, 0.75]))) and got["n"] == len(values)
    empty = P.describe(spark.createDataFrame([(None,)], "v double"), ["v"]).first()
    assert empty["n"] == 0 and empty["median"] is None


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("b,a,c\n1,x,2.5\nbad,y,3\n,z,\n")
    schema = T.StructType.fromDDL("a string, b int, c double")
    assert [tuple(r) for r in io.load_data(spark, f"{tmp_path}/a.csv", schema).collect()] == [("x", 1, 2.5), ("y", None, 3.0), ("z", None, None)]
    assert dict(io.load_data(spark, f"{tmp_path}/a.csv").dtypes)["c"] == "double"
    (tmp_path / "a.json").write_text(json.dumps([{"a": "x", "b": 1}, {"a": "y"}]))
    assert [(r["a"], r["b"]) for r in io.load_data(spark, f"{tmp_path}/a.json").collect()] == [("x", 1), ("y", None)]
    (tmp_path / "columns.json").write_text(json.dumps({"a": {"0": "x", "1": "y"}, "b": {"0": 1}}))
    assert sorted(tuple(r) for r in io.load_columns(spark, f"{tmp_path}/columns.json", T.StructType.fromDDL("a string, b int")).collect()) == [("x", 1), ("y", None)]
    spark.range(3).write.parquet(f"{tmp_path}/a.parquet")
    assert io.load_data(spark, f"{tmp_path}/a.parquet").count() == 3
    with pytest.raises(ValueError, match="Unsupported file format!"):
        io.load_data(spark, "a.xls")
    (tmp_path / "data").mkdir()
    (tmp_path / "one/two").mkdir(parents=True)
    assert io.find_data_dir(f"{tmp_path}/one/two").endswith("data")
    with pytest.raises(FileNotFoundError):
        io.find_data_dir(f"{tmp_path}/one/two/three/four")


def test_records(spark, tmp_path):
    one = {f.name: {"string": "s", "int": 1, "bigint": 2, "double": 0.5}[f.dataType.simpleString()] for f in io.REQUEST}
    (tmp_path / "sample.json").write_text(json.dumps(one))
    df = io.records(spark, [io.sample_record(f"{tmp_path}/sample.json")], io.REQUEST)
    assert io.to_records(df) == [one] and "popularity" not in df.columns
    with pytest.raises(ValueError, match="missing fields: artist_name"):
        io.records(spark, [{k: v for k, v in one.items() if k != "artist_name"}], io.REQUEST)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    level = {g: 10.0 * k for k, g in enumerate("abcd")}
    out = [(k, g, float(x), float(level[g] + 3 * x + rng.normal())) for k, (g, x) in enumerate(zip(rng.choice(list("abcd"), 400), rng.normal(size=400), strict=True))]
    return spark.createDataFrame(out, "k int, g string, x double, target double").persist()


UNITS = (X.FeatureSpec(("x",), rule="standardise"),)


def test_learners_beat_the_mean(spark, rows, tmp_path):
    encoder = X.TargetEncoder("g", F.col("target"), "g_mean")
    learners = [E.Learner(n, f, UNITS, (encoder,)) for n, f in E.REGRESSORS.items()] + [E.NearestNeighbour("nearest", "k", ("x",)), E.Learner("plain", E.REGRESSORS["linear_regression"], UNITS, max_abs=True)]
    got = {r["model"]: r for r in R.evaluate_learners(rows, "k", learners, sink=(f"{tmp_path}/results", "songs")).collect()}
    assert len(got) == len(learners) and all(r["R2"] > 0 for n, r in got.items() if n not in ("nearest", "plain"))
    assert got["linear_regression"]["R2"] > 0.97 > got["plain"]["R2"] and got["nearest"]["MAE"] < 20
    assert spark.read.parquet(f"{tmp_path}/results").filter("experiment = 'songs'").count() == len(learners)
    cv = R.cross_validate_learner(rows, "k", learners[0]).first()
    assert cv["mean[R2]"] > 0.97 and cv["std[R2]"] < 0.02


def test_classifiers_beat_the_majority(spark, rows):
    marked = rows.withColumn("target", (F.col("target") > 15).cast("double"))
    split = D.split_train_test(marked, "k")
    units = (*UNITS, X.FeatureSpec(("g",), categorical=True))
    for name, f in E.CLASSIFIERS.items():
        got = M.evaluate(E.Learner(name, f, units).fit(split.filter("not is_test")).transform(split.filter("is_test")), M.classification(1.0), "target", "prediction").first()
        assert got["balancedAccuracy"] > 0.8
    params = R.EvaluationParams(positive=1.0)
    assert [m.name for m in params.metrics] == ["accuracy", "balancedAccuracy", "precision", "recall", "F1"]


def test_scales_come_from_the_training_rows(spark, rows):
    train = rows.filter("k < 200")
    fitted = E.Learner("linear", E.REGRESSORS["linear_regression"], UNITS).fit(train)
    far = rows.withColumn("x", F.col("x") + 1000)
    a, b = (fitted.transform(df).filter("k = 300").first()["prediction"] for df in (rows.filter("k >= 200"), rows.filter("k >= 200").unionAll(far.filter("k < 200"))))
    assert a == b


def test_models_are_kept(spark, rows, tmp_path, monkeypatch):
    fitted = E.Learner("linear", E.REGRESSORS["linear_regression"], (*UNITS, X.FeatureSpec(("g",), categorical=True))).fit(rows)
    path = io.model_path(f"{tmp_path}/models", D.Dataset("k", "target").tag, "linear")
    assert io.load_model(spark, path) is None
    io.save_model(fitted.model, path)
    io.save_model(fitted.model, path)
    monkeypatch.setenv("MODEL_PATH", path)
    again = io.load_model(spark)
    unseen = rows.limit(5).unionAll(spark.createDataFrame([(900, "unseen", 0.0, 0.0)], rows.schema))
    left, right = ({r["k"]: r["prediction"] for r in E.score(m, unseen).collect()} for m in (fitted.model, again))
    assert left == right and len(left) == 6 and "LinearRegressionModel" in E.describe(again)
    rows.drop("target").repartition(2).write.parquet(f"{tmp_path}/stream")
    for _ in range(2):  # the second run finds nothing new
        score_stream(spark, f"{tmp_path}/stream", rows.drop("target").schema, again, ["k", "prediction"], f"{tmp_path}/scored", f"{tmp_path}/check")
    want = {r["k"]: r["prediction"] for r in E.score(again, rows).collect()}
    scored = spark.read.parquet(f"{tmp_path}/scored").collect()
    assert len(scored) == 400 and {r["k"]: r["prediction"] for r in scored} == want


def test_one_model_for_each_group(spark, rows):
    lines = {r["g"]: r for r in E.per_group(rows, "g", "x", "target").collect()}
    models = E.train_models(rows, "g", lambda: E.Learner("linear", lambda n: E.REGRESSORS["linear_regression"](n).setRegParam(0.0), (X.FeatureSpec(("x",)),)))
    assert sorted(models) == list("abcd") == sorted(lines)
    for g, m in models.items():
        assert m.model.stages[-1].coefficients[0] == pytest.approx(lines[g]["slope"]) and m.model.stages[-1].intercept == pytest.approx(lines[g]["intercept"])
    assert E.per_group(rows.limit(0), "g", "x", "target").count() == 0


def test_nearest_neighbour(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (90, 2)).astype(float)
    df = spark.createDataFrame([(k, *map(float, v), float(k)) for k, v in enumerate(x)] + [(500, None, 1.0, 0.0)], "k int, a double, b double, target double")
    got = {r["query_key"]: r["neighbour_key"] for r in E.nearest_neighbour(df.filter("k % 9 = 0 or k = 500"), df, "k", ["a", "b"], "target").collect()}
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    assert got == {k: int(d2[k].argmin()) for k in range(0, 90, 9)}


def test_search(spark, rows, tmp_path):
    args = ("gradient_boosting", rows.filter("k < 300"), rows.filter("k >= 300"), ["x"], ["g"])
    trials = E.search(*args, trials=2, first={"maxDepth": 3, "minInstancesPerNode": 5}, sink=f"{tmp_path}/trials", maxIter=2)
    assert len(trials) == 2 and trials[0]["RRSE"] <= trials[1]["RRSE"]
    assert E.load_trials(spark, f"{tmp_path}/trials", "gradient_boosting") and not E.load_trials(spark, f"{tmp_path}/none", "gradient_boosting")
    assert E.search(*args, trials=2, first={"maxDepth": 3, "minInstancesPerNode": 5}, sink=f"{tmp_path}/trials", maxIter=2) == trials
    assert len(E.search(*args, trials=5, seconds=0.0, maxIter=1)) == 1
    with pytest.raises(ValueError, match="unknown model"):
        E.search("other", *args[1:], trials=1)


def test_registry_and_conversion(spark):
    registry = X.Registry()
    registry.register("size", lambda: X.FeatureSpec(("a", "b"), rule="maxabs"))
    registry.register("kind", lambda: X.FeatureSpec(("c",), categorical=True))
    assert [f.columns for f in registry.collect("kind", "size")] == [("c",), ("a", "b")]
    rows = spark.createDataFrame([(9.0,), (10.0,)], "p double").select(*E.regressor_as_classifier("p", 10, "high", "low")).collect()
    assert [tuple(r) for r in rows] == [("low", 0.0, 1.0), ("high", 1.0, 0.0)]


def test_running(tmp_path, spark):
    assert R.run_id(datetime(2024, 1, 2, 3, 4, 5, tzinfo=UTC)) == "20240102-030405"
    assert R.run_main(lambda: R.log_table(spark.range(2)), f"{tmp_path}/log.txt") == "id\n0\n1"
    with pytest.raises(ZeroDivisionError):
        R.run_main(lambda: 1 / 0, f"{tmp_path}/log.txt")
    text = (tmp_path / "log.txt").read_text()
    assert "id\n0\n1" in text and "the run failed" in text and not logging.getLogger("tablewright").handlers
