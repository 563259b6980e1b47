"""Models as pipelines of Spark ML, model evaluation, search and serving."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import MaxAbsScaler, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import Metric, evaluate, rrse
from .boosting import BoostedTrees
from .dataset import fold_of
from .features import FeatureSpec, TargetEncoder, imputed, scales
from .forest import Forest
from .learners import FittedLearner, NumbersFromClasses
from .neighbours import nearest_neighbour
from .side_by_side import SideBySide, kept

#: Of each tree of a forest. Deeper trees can be asked for by a factory of one's own.
FOREST_DEPTH = 8
#: Trees of the boosted models below; a factory of one's own can have more.
ROUNDS = 20
#: The parameters that a search over boosted trees has found best.
TUNED = {"colsample": 0.9869550725977663, "gamma": 8.022497033174522, "maxDepth": 10, "minChildWeight": 48.0, "regLambda": 0.3984639652186364}
#: Estimators by name: factories, so that each use is unfitted.
CLASSIFIERS: dict[str, Callable] = {
    "logistic_regression": lambda rows: LogisticRegression(maxIter=1000, regParam=1.0 / max(rows, 1), standardization=False, labelCol="target"),
    "random_forest": lambda rows: Forest(objective="logistic", rounds=100, maxDepth=FOREST_DEPTH, labelCol="target"),
    "decision_tree": lambda rows: DecisionTreeClassifier(maxDepth=2, seed=42, labelCol="target"),
    "gradient_boosting": lambda rows: BoostedTrees(objective="logistic", rounds=ROUNDS, labelCol="target"),
}
REGRESSORS: dict[str, Callable] = {
    "linear_regression": lambda rows: LinearRegression(solver="normal", regParam=1e-6, labelCol="target"),
    "random_forest": lambda rows: Forest(rounds=100, maxDepth=FOREST_DEPTH, labelCol="target"),
    "decision_tree": lambda rows: DecisionTreeRegressor(maxDepth=2, seed=42, labelCol="target"),
    "gradient_boosting": lambda rows: BoostedTrees(rounds=ROUNDS, labelCol="target"),
    "gradient_boosting_tuned": lambda rows: BoostedTrees(rounds=ROUNDS, labelCol="target", **TUNED),
}


#: Whole numbers that may be classes.
CLASSES = 1000


class MultinomialRegression(Estimator):
    """Logistic regression scored as a regressor: each whole number that the target takes is a class, and the most likely one is the prediction."""

    def __init__(self, label: str = "target", iterations: int = 100):
        super().__init__()
        self.label, self.iterations = label, iterations

    def _fit(self, dataset: DataFrame) -> NumbersFromClasses:
        y = F.col(self.label)
        rows = dataset.filter(y.isNotNull())
        values = [r[0] for r in rows.select(y.cast("double").alias("y")).distinct().orderBy("y").limit(CLASSES + 1).collect()]
        if len(values) > CLASSES or any(v != int(v) for v in values):
            raise ValueError(f"the target must take {CLASSES} whole numbers at most")
        classes = dataset.sparkSession.createDataFrame([(v, float(k)) for k, v in enumerate(values)], "_value double, _class double")
        known = rows.join(F.broadcast(classes), y.cast("double") == F.col("_value"))  # CLASSES rows at most
        return NumbersFromClasses(LogisticRegression(family="multinomial", maxIter=self.iterations, labelCol="_class").fit(known), values)


def pipeline(estimator, numeric: list[str], categorical: list[str], max_abs: bool = False, scaling: dict[str, tuple[float, float]] | None = None, missing: bool = False) -> Pipeline:
    """Scaled numbers and categories, one column a value (unknown ones: zeros), all into one vector, then the estimator.

    ``scaling`` has (center, scale) of columns as fitted on the training rows, see ``features.scales``. With ``missing``, nulls
    reach the estimator as NaN; else they are an error.
    """
    scaling = scaling or {}
    stages = [SQLTransformer(statement="SELECT *, " + ", ".join(f"(`{n}` - {c!r}D) / {s!r}D AS `{n}_scaled`" for n, (c, s) in scaling.items()) + " FROM __THIS__")] if scaling else []
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=[f"{n}_index" for n in categorical], stringOrderType="alphabetAsc", handleInvalid="keep"), OneHotEncoder(inputCols=[f"{n}_index" for n in categorical], outputCols=[f"{n}_hot" for n in categorical], dropLast=True)]
    stages.append(VectorAssembler(inputCols=[*[f"{n}_scaled" if n in scaling else n for n in numeric], *[f"{n}_hot" for n in categorical]], outputCol="raw" if max_abs else "features", handleInvalid="keep" if missing else "error"))
    if max_abs:
        stages.append(MaxAbsScaler(inputCol="raw", outputCol="features"))
    return Pipeline(stages=[*stages, estimator])


@dataclass(frozen=True)
class Learner:
    """A model by its parts: feature units, optional target encoders, and a factory of the estimator by the number of training rows.

    Scales, categories, encodings and the means for missing encodings are all fitted on the training rows. With ``missing`` the estimator takes
    missing values itself, so that nothing is filled in.
    """

    name: str
    estimator: Callable
    features: tuple[FeatureSpec, ...]
    encoders: tuple[TargetEncoder, ...] = ()
    max_abs: bool = False
    missing: bool = False

    def fit(self, train: DataFrame) -> FittedLearner:
        encodings = [e.fit(train) for e in self.encoders]
        rows = train
        for e in encodings:
            rows = e.transform_train(rows)
        encoded = rows.persist() if encodings else None  # all passes over them share one shuffle
        names = [e.name for e in self.encoders]
        means = {}
        if names and not self.missing:
            means = {n: m if m is not None else 0.0 for n, m in rows.agg(*[F.avg(n).alias(n) for n in names]).first().asDict().items()}
            rows = imputed(rows, means)
        numeric = [n for f in self.features if not f.categorical for n in f.columns] + [x for n in names for x in ((n,) if self.missing else (n, f"{n}_missing"))]
        rules = {n: f.rule for f in self.features if not f.categorical and f.rule != "skip" for n in f.columns} | ({} if self.missing else dict.fromkeys(names, "maxabs"))
        categorical = [n for f in self.features if f.categorical for n in f.columns]
        try:
            fitted = pipeline(self.estimator(rows.count()), numeric, categorical, self.max_abs, scales(rows, rules) if rules else None, self.missing).fit(rows)
        finally:
            if encoded is not None:
                encoded.unpersist()
        return FittedLearner(self.name, fitted, encodings, means)


@dataclass(frozen=True)
class NearestNeighbour:
    """1-NN as a model: the target of the nearest training row, by columns scaled as fitted on the training rows."""

    name: str
    key: str
    columns: tuple[str, ...]
    rule: str = "standardise"

    def fit(self, train: DataFrame) -> FittedNeighbour:
        return FittedNeighbour(self, train, scales(train, dict.fromkeys(self.columns, self.rule)))


@dataclass(frozen=True)
class FittedNeighbour:
    learner: NearestNeighbour
    train: DataFrame
    scaling: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, which is null for rows that are near nothing. The key is unique."""
        key, columns = self.learner.key, list(self.learner.columns)
        queries, known = (x.withColumns({n: (F.col(n) - c) / s for n, (c, s) in self.scaling.items()}) for x in (df, self.train))
        near = nearest_neighbour(queries, known, key, columns, "target", itself=True)
        return df.join(near.select(F.col("query_key").alias(key), F.col("neighbour_target").alias("prediction")), key, "left")


def regressor_as_classifier(prediction: str, threshold: float, positive: str, negative: str) -> list[Column]:
    """The class and hard probabilities that a regression's prediction stands for; the threshold is positive."""
    hit = F.col(prediction) >= threshold
    return [F.when(hit, positive).otherwise(negative).alias("predicted_class"), F.when(hit, 1.0).otherwise(0.0).alias(f"p_{positive}"), F.when(hit, 0.0).otherwise(1.0).alias(f"p_{negative}")]


def per_group(df: DataFrame, group: str, x: str, y: str, minimum: int = 2) -> DataFrame:
    """One least-squares line for each group, all in one aggregation: the group, n, slope, intercept. Groups with fewer rows have none."""
    return df.groupBy(group).agg(F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept")).filter(F.col("n") >= minimum)


def train_models(df: DataFrame, group: str, make: Callable[[], Learner], values: list | None = None) -> dict:
    """A model of any kind for each of a few groups (regions), each fitted on its group only."""
    values = [r[0] for r in df.select(group).distinct().orderBy(group).limit(101).collect()] if values is None else values
    if len(values) > 100:
        raise ValueError("more than 100 groups: name those that need a model, or use per_group")
    return {v: make().fit(df.filter(F.col(group).eqNullSafe(F.lit(v)))) for v in values}


def compare(models: dict[str, Callable[[DataFrame], Callable[[DataFrame], DataFrame]]], train: DataFrame, test: DataFrame, metrics: tuple[Metric, ...], truth: str, prediction: str = "prediction", errors: bool = False) -> DataFrame:
    """One row a model: fit on train, predict test, all metrics; best first by the first metric.

    Models are fitted side by side on data that is kept meanwhile. With ``errors`` a model that fails is a row with its error and no metrics; else
    it is an error, once the others are through.
    """
    spark = train.sparkSession
    with kept(train, test) as (known, asked):
        done = SideBySide(spark)({name: (lambda fit=fit: tuple(evaluate(fit(known)(asked), metrics, truth, prediction).first())) for name, fit in models.items()})
    if not errors and (failed := [x for x in done if x.error]):
        raise RuntimeError(f"{failed[0].name}: {failed[0].error}")
    rows = [(x.name, *([None] * len(metrics) if x.error else [None if v is None else float(v) for v in x.value]), *([x.error] if errors else [])) for x in done]
    return leaderboard(spark.createDataFrame(rows, ", ".join(["model string", *[f"`{m.name}` double" for m in metrics], *["error string"] * errors])), metrics[0])


def leaderboard(results: DataFrame, metric: Metric) -> DataFrame:
    best = F.desc_nulls_last(metric.name) if metric.larger_is_better else F.asc_nulls_last(metric.name)
    return results.orderBy(best, "model")


def fold_metrics(df: DataFrame, key: str, k: int, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], metrics: tuple[Metric, ...], truth: str, prediction: str = "prediction") -> DataFrame:
    """fold and each metric, a row a fold; folds are evaluated side by side, and everything is fitted anew in each."""
    with kept(df.withColumn("fold", fold_of(key, k))) as (folded,):
        one = lambda i: tuple(evaluate(fit(folded.filter(F.col("fold") != i))(folded.filter(F.col("fold") == i)), metrics, truth, prediction).first())
        done = SideBySide(df.sparkSession)({str(i): (lambda i=i: one(i)) for i in range(k)})
    if failed := [x for x in done if x.error]:
        raise RuntimeError(f"fold {failed[0].name}: {failed[0].error}")
    return df.sparkSession.createDataFrame([(int(x.name), *(None if v is None else float(v) for v in x.value)) for x in done], "fold int, " + ", ".join(f"`{m.name}` double" for m in metrics))


def cross_validate(df: DataFrame, key: str, k: int, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], metrics: tuple[Metric, ...], truth: str, prediction: str = "prediction") -> DataFrame:
    """Mean and standard deviation (of the population) of each metric over k folds."""
    rows = fold_metrics(df, key, k, fit, metrics, truth, prediction)
    return rows.agg(*[f(m.name).alias(f"{n}[{m.name}]") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


#: The search space: bounds of each parameter, whole numbers for int.
SPACE = {"maxDepth": (int, 3, 10), "minInstancesPerNode": (int, 1, 100)}


def search(model: str, train: DataFrame, test: DataFrame, numeric: list[str], categorical: list[str], trials: int, seed: int = 21, first: dict | None = None, seconds: float | None = None, sink: str | None = None, **fixed) -> list[dict]:
    """Seeded random search with a given first point; trials with their RRSE, best first.

    It ends after ``trials`` or, between trials, after ``seconds``. With ``sink`` each trial is appended to a
    Parquet table as soon as it is known, and trials that are there already are not fitted again.
    """
    if model not in ("gradient_boosting", "random_forest"):
        raise ValueError(f"unknown model: {model}")
    spark, began = train.sparkSession, time.monotonic()
    kind, rng = {"gradient_boosting": GBTRegressor, "random_forest": RandomForestRegressor}[model], random.Random(seed)
    points = [first] * (first is not None) + [{n: rng.randint(a, b) for n, (_, a, b) in SPACE.items()} for _ in range(trials - (first is not None))]
    out = load_trials(spark, sink, model) if sink else []
    for p in points:
        if any(all(t[n] == v for n, v in p.items()) for t in out):
            continue
        if seconds is not None and out and time.monotonic() - began > seconds:
            break
        fitted = pipeline(kind(labelCol="target", seed=42, **p, **fixed), numeric, categorical).fit(train)
        out.append(p | {"RRSE": evaluate(fitted.transform(test), (rrse(),), "target", "prediction").first()[0]})
        if sink:
            spark.createDataFrame([(model, *[out[-1][n] for n in SPACE], out[-1]["RRSE"])], TRIAL).write.mode("append").parquet(sink)
    return sorted(out, key=lambda t: t["RRSE"])


TRIAL = "model string, " + ", ".join(f"{n} int" for n in SPACE) + ", RRSE double"


def load_trials(spark: SparkSession, sink: str, model: str) -> list[dict]:
    """The trials of a model in a sink, none if there is no sink yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(sink)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    return [{n: r[n] for n in (*SPACE, "RRSE")} for r in spark.read.schema(TRIAL).parquet(sink).filter(F.col("model") == model).collect()]


def score(model: PipelineModel, records: DataFrame) -> DataFrame:
    """Predictions for a batch or a stream of raw records; all transforms are in the model."""
    return model.transform(records)


def describe(model: PipelineModel) -> str:
    return "; ".join(f"{type(s).__name__}({s.uid})" for s in model.stages)
