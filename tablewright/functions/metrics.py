"""Metrics as aggregate columns with a name and a direction."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    name: str
    larger_is_better: bool
    of: Callable[[Column, Column], Column]  #: of truth and prediction


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def mae() -> Metric:
    return Metric("MAE", False, lambda y, p: F.avg(F.abs(y - p)))


def mse() -> Metric:
    return Metric("MSE", False, lambda y, p: F.avg((y - p) * (y - p)))


def rmse() -> Metric:
    return Metric("RMSE", False, lambda y, p: F.sqrt(F.avg((y - p) * (y - p))))


def r2() -> Metric:
    return Metric("R2", True, lambda y, p: 1 - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y)))


def rrse() -> Metric:
    return Metric("RRSE", False, lambda y, p: F.sqrt(F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y))))


def std_dev_ae() -> Metric:
    """Standard deviation (of the population) of the absolute error."""
    return Metric("StdDevAE", False, lambda y, p: F.stddev_pop(F.abs(y - p)))


def rel_freq_within(e: float) -> Metric:
    """Share of rows whose absolute error is at most e."""
    return Metric(f"RelFreqErrWithin[{e:g}]", True, lambda y, p: F.avg((F.abs(y - p) <= e).cast("int")))


def accuracy() -> Metric:
    """The share of rows whose prediction is their truth; a prediction that is missing is wrong, and a row without truth counts if it has none either."""
    return Metric("accuracy", True, lambda y, p: F.avg(y.eqNullSafe(p).cast("int")))


def precision(positive) -> Metric:
    return Metric("precision", True, lambda y, p: _ratio(F.count_if((y == positive) & (p == positive)), F.count_if(p == positive)))


def recall(positive) -> Metric:
    return Metric("recall", True, lambda y, p: _ratio(F.count_if((y == positive) & (p == positive)), F.count_if(y == positive)))


def f1(positive) -> Metric:
    return Metric("F1", True, lambda y, p: _ratio(2 * F.count_if((y == positive) & (p == positive)), F.count_if(y == positive) + F.count_if(p == positive)))


def balanced_accuracy(positive) -> Metric:
    return Metric("balancedAccuracy", True, lambda y, p: (recall(positive).of(y, p) + _ratio(F.count_if((y != positive) & (p != positive)), F.count_if(y != positive))) / 2)


REGRESSION = (mae(), mse(), r2(), rmse(), rrse(), std_dev_ae())


def classification(positive) -> tuple[Metric, ...]:
    return accuracy(), balanced_accuracy(positive), precision(positive), recall(positive), f1(positive)


def evaluate(df: DataFrame, metrics: tuple[Metric, ...], truth: str, prediction: str, by: tuple[str, ...] = ()) -> DataFrame:
    """All metrics in one aggregation."""
    y, p = F.col(truth), F.col(prediction)
    return df.groupBy(*by).agg(*[m.of(y, p).alias(m.name) for m in metrics])


def confusion_matrix(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """truth, prediction, n for every pair of labels, zeros kept."""
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))
    labels = counts.select(F.explode(F.array("truth", "prediction")).alias("label")).distinct()
    pairs = labels.select(F.col("label").alias("truth")).crossJoin(labels.select(F.col("label").alias("prediction")))  # labels of the target: few
    known = counts.select(F.col("truth").alias("t"), F.col("prediction").alias("p"), "n")
    same = F.col("truth").eqNullSafe(F.col("t")) & F.col("prediction").eqNullSafe(F.col("p"))  # a missing one is a label too
    return pairs.join(known, same, "left").select("truth", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def classification_report(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """label, precision, recall, f1, support by label, and rows for accuracy, macro and weighted averages; 0/0 is 0."""
    m = confusion_matrix(df, truth, prediction)
    sides = m.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("h")), F.struct(F.col("prediction").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.when(F.col("truth").eqNullSafe(F.col("prediction")), F.col("n")).otherwise(F.lit(0)).alias("h")))).alias("s")).select("s.*")
    by = sides.groupBy("label").agg(F.sum("h").alias("h"), F.sum("t").alias("support"), F.sum("p").alias("p"))
    one = by.select(F.col("label").cast("string").alias("label"), _ratio(F.col("h"), F.col("p")).alias("precision"), _ratio(F.col("h"), F.col("support")).alias("recall"), _ratio(2 * F.col("h"), F.col("p") + F.col("support")).alias("f1"), "support", "h")
    cols = ("precision", "recall", "f1")
    macro = one.agg(*[F.avg(c).alias(c) for c in cols], F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), *cols, "support")
    weighted = one.agg(*[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in cols], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("label"), *cols, "support")
    right = one.agg(_ratio(F.sum("h"), F.sum("support")).alias("f1"), F.sum("support").alias("support")).select(F.lit("accuracy").alias("label"), F.col("f1").alias("precision"), F.col("f1").alias("recall"), "f1", "support")
    return one.select("label", *cols, "support").unionByName(right).unionByName(macro).unionByName(weighted)
