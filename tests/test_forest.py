"""Random forests on cells."""

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tablewright.operators import forest
from tablewright.operators.models import CLASSIFIERS, REGRESSORS, pipeline


def rows(spark, n=6000):
    r = np.random.default_rng(3)
    a, b, c = r.integers(0, 12, n), r.integers(0, 9, n), r.integers(0, 3, n)
    y = np.round(a * 2 + (b > 4) * 5 * (c == 1) + r.normal(0, 2, n))
    return spark.createDataFrame([tuple(map(float, t)) for t in zip(a, b, c, y)], "a double, b double, c double, target double")


def error(model, df):
    return model.transform(df).agg(F.sqrt(F.avg((F.col("target") - F.col("prediction")) ** 2))).first()[0]


def test_forest_is_as_good_as_sparks(spark, tmp_path):
    df = rows(spark)
    train, test = df.limit(4000).persist(), df.persist()
    own = pipeline(REGRESSORS["random_forest"](1), ["a", "b", "c"], []).fit(train)
    other = pipeline(RandomForestRegressor(numTrees=100, maxDepth=8, seed=42, labelCol="target"), ["a", "b", "c"], []).fit(train)
    assert abs(error(own, test) - error(other, test)) < 0.1 * error(other, test)
    model = own.stages[-1]
    assert isinstance(model, forest.ForestModel) and len(model.trees) == 100  # Spark's keeps a counter of each tree for each row
    model.write().save(f"{tmp_path}/m")
    again = forest.ForestModel.load(f"{tmp_path}/m")
    assert all(np.array_equal(x.value, y.value) for x, y in zip(model.trees, again.trees, strict=True))


def test_a_cell_is_drawn_as_its_rows_would_be(spark):
    # Without splits a tree is the mean of its draws; over trees these means spread as those of single rows do.
    df = spark.range(400).select(F.lit(1.0).alias("a"), (F.col("id") % 2).cast("double").alias("target"))
    model = pipeline(forest.Forest(rounds=400, maxDepth=1, labelCol="target"), ["a"], []).fit(df).stages[-1]
    means = np.array([t.value[0] * 400 for t in model.trees])
    assert abs(means.mean() - 0.5) < 0.01 and 0.7 < means.std() / np.sqrt(0.25 / 400) < 1.3


def test_classes(spark):
    df = rows(spark).withColumn("target", (F.col("target") > 12).cast("double"))
    model = pipeline(CLASSIFIERS["random_forest"](1), ["a", "b", "c"], []).fit(df)
    assert model.transform(df).filter("target = prediction").count() > 0.85 * df.count()
    many = pipeline(CLASSIFIERS["random_forest"](1), ["a", "b", "c"], []).fit(df.withColumn("target", F.col("c")))
    assert isinstance(many.stages[-1], RandomForestClassificationModel)
