"""Learners that are stored with their encodings, and what is made of them."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators import boosting as B
from tablewright.operators import dataset as D
from tablewright.operators import features as X
from tablewright.operators import learners as L
from tablewright.operators import models as E
from tablewright.operators import search as S
from tablewright.streaming.scoring import score_stream

RAW = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("g", T.StringType()), T.StructField("c", T.StringType()), T.StructField("x", T.DoubleType())])


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    level = {g: 10.0 * k for k, g in enumerate("abcd")} | {None: 5.0}
    groups = [*rng.choice(list("abcd"), 260), *[None] * 40]
    out = [(k, g, "uv"[k % 2], float(x), float(level[g] + 3 * x + k % 2 + rng.normal())) for k, (g, x) in enumerate(zip(groups, rng.normal(size=300), strict=True))]
    out += [(900, "alone", "u", 0.0, 500.0)]
    return spark.createDataFrame(out, "k int, g string, c string, x double, target double").persist()


UNITS = (X.FeatureSpec(("x",), rule="standardise"), X.FeatureSpec(("c",), categorical=True))


def encoders():
    return (X.TargetEncoder("g", F.col("target"), "g_mean"), X.TargetEncoder("c", (F.col("target") > 10).cast("int"), "c_share"))


NEW = [{"k": 1, "g": "a", "c": "u", "x": 0.5}, {"k": 2, "g": "never seen", "c": "w", "x": 0.5}, {"k": 3, "g": None, "c": "v", "x": -1.0}, {"k": 4, "g": "alone", "c": "u", "x": 0.0}]
def learner(name):
    if name == "linear":
        return E.Learner("linear", E.REGRESSORS["linear_regression"], UNITS, encoders())
    return E.Learner("boosted", lambda n: B.BoostedTrees(rounds=4, maxDepth=3, labelCol="target"), UNITS, encoders(), missing=True)


@pytest.mark.parametrize("name", ["linear", "boosted"])
def test_round_trip(spark, rows, tmp_path, name):
    fitted = learner(name).fit(rows)
    data = D.Dataset("k", "target", threshold=15)
    assert L.load_learner(spark, f"{tmp_path}/none") is None and L.classifier_from_best(spark, f"{tmp_path}/models", data) is None
    path = L.save_best(fitted, f"{tmp_path}/models", data)
    assert L.save_best(fitted, f"{tmp_path}/models", data) == path  # in place of the first
    again = L.load_learner(spark, path)
    assert isinstance(again, L.FittedLearner) and again.name == name and (again.means == {} if name == "boosted" else len(again.means) == 2)
    left, right = (L.predict(spark, m, NEW, RAW, ("k", "g_mean", "c_share", "prediction")) for m in (fitted, again))
    assert left == right and [r["k"] for r in right] == [1, 2, 3, 4]
    seen = {r["g"]: r["m"] for r in rows.groupBy("g").agg(F.avg("target").alias("m")).collect()}
    unknown = None if name == "boosted" else pytest.approx(again.means.get("g_mean"))
    # Joins by the group: a null is no group that could be known.
    assert [r["g_mean"] for r in right] == [pytest.approx(seen["a"]), unknown, unknown, pytest.approx(500.0)]
    with pytest.raises(ValueError, match="missing fields: g"):
        L.predict(spark, again, [{"k": 1, "c": "u", "x": 0.5}], RAW)

    classifier = L.classifier_from_best(spark, f"{tmp_path}/models", data)
    assert classifier.name == f"FromRegressor[{name}]"
    classifier.write().overwrite().save(f"{tmp_path}/classifier")
    third = L.load_learner(spark, f"{tmp_path}/classifier")
    got = L.predict(spark, third, NEW, RAW, ("prediction", "predicted_class", "p_popular", "p_unpopular"))
    assert got == L.predict(spark, classifier, NEW, RAW, ("prediction", "predicted_class", "p_popular", "p_unpopular"))
    assert all((r["predicted_class"] == "popular") == (r["prediction"] >= 15) == (r["p_popular"] == 1.0) == (r["p_unpopular"] == 0.0) for r in got)

    nested = PipelineModel([again])  # a stage like any other
    nested.write().overwrite().save(f"{tmp_path}/nested")
    assert L.predict(spark, PipelineModel.load(f"{tmp_path}/nested"), NEW, RAW) == [{"prediction": r["prediction"]} for r in right]


def test_streams_take_stored_learners(spark, rows, tmp_path):
    model = learner("boosted").fit(rows)
    model.write().overwrite().save(f"{tmp_path}/m")
    raw = rows.select("k", "g", "c", "x")
    raw.write.parquet(f"{tmp_path}/in")
    score_stream(spark, f"{tmp_path}/in", raw.schema, L.load_learner(spark, f"{tmp_path}/m"), ["k", "prediction"], f"{tmp_path}/out", f"{tmp_path}/check")
    want = {r["k"]: r["prediction"] for r in model.transform(raw).collect()}
    assert {r["k"]: r["prediction"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want and len(want) == 301


def test_tuned_parameters_and_search(spark, rows, tmp_path):
    estimator = E.REGRESSORS["gradient_boosting_tuned"](10)
    assert {n: estimator.getOrDefault(n) for n in E.TUNED} == E.TUNED and set(E.TUNED) == set(S.BOOSTING)
    make = lambda p: E.Learner("boosted", lambda n: B.BoostedTrees(rounds=2, labelCol="target", **p), UNITS, encoders()[:1], missing=True)
    sink = S.TrialSink(spark, f"{tmp_path}/trials", S.BOOSTING)
    options = {"trials": 2, "first": [S.BOOSTING_FIRST], "sink": sink}
    trials = S.search_learner(make, rows.filter("k < 200"), rows.filter("k >= 200"), **options)
    assert len(trials) == 2 and trials[0].point == S.BOOSTING_FIRST and 0 < S.best(trials).loss < 2
    assert S.search_learner(make, rows.filter("k < 200"), rows.filter("k >= 200"), **options) == trials


def test_whole_numbers_as_classes(spark, tmp_path):
    rows = spark.createDataFrame([(k, float(k % 4), float(10 * (k % 4) - 5)) for k in range(120)], "k int, x double, target double")
    fitted = E.Learner("multinomial", lambda n: E.MultinomialRegression(), (X.FeatureSpec(("x",)),)).fit(rows)
    assert fitted.transform(rows).filter("prediction <> target").count() == 0
    fitted.write().overwrite().save(f"{tmp_path}/m")
    assert L.load_learner(spark, f"{tmp_path}/m").transform(rows).filter("prediction <> target").count() == 0
    with pytest.raises(ValueError, match="whole numbers"):
        E.Learner("multinomial", lambda n: E.MultinomialRegression(), (X.FeatureSpec(("x",)),)).fit(rows.withColumn("target", F.col("target") + 0.5))
