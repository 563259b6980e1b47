"""Feature units, their registry, target encoding and scaling."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FeatureSpec:
    """Columns that belong together, which of them are categories, and how the others are normalised."""

    columns: tuple[str, ...]
    categorical: bool = False
    rule: str = "skip"  #: skip, standardise or maxabs


class Registry:
    """Feature names and the factories of their units."""

    def __init__(self) -> None:
        self.factories: dict[str, Callable[[], FeatureSpec]] = {}

    def register(self, name: str, factory: Callable[[], FeatureSpec]) -> None:
        self.factories[name] = factory

    def collect(self, *names: str) -> list[FeatureSpec]:
        return [self.factories[n]() for n in names]


def leave_one_out(df: DataFrame, group: str, value: Column, name: str) -> DataFrame:
    """The mean of the group's other rows; null for a group of one. Training rows only; null is a group.

    Sums and counts are combined in the tasks and joined back, so that a group with many rows is not brought together.
    """
    rows = df.withColumn("_value", value)
    sums = rows.groupBy(F.col(group).alias("_group")).agg(F.sum("_value").alias("_sum"), F.count("_value").alias("_count"))
    joined = rows.join(sums, F.col(group).eqNullSafe(F.col("_group")))
    mean = F.try_divide((F.col("_sum") - F.coalesce("_value", F.lit(0))).cast("double"), F.col("_count") - F.col("_value").isNotNull().cast("int"))
    return joined.withColumn(name, mean).drop("_value", "_group", "_sum", "_count")


def fit_group_means(train: DataFrame, group: str, value: Column, name: str) -> DataFrame:
    """One row a group: its mean, for rows that were not in the training."""
    return train.groupBy(group).agg((F.sum(value).cast("double") / F.count(value)).alias(name))


def apply_group_means(df: DataFrame, means: DataFrame, group: str) -> DataFrame:
    """Null for unknown groups. Spark broadcasts the means if their size allows."""
    return df.join(means, group, "left")


def scales(df: DataFrame, rules: dict[str, str]) -> dict[str, tuple[float, float]]:
    """(center, scale) of each column by its rule, fitted in one pass; a scale of 0 counts as 1."""
    aggs = []
    for n, rule in rules.items():
        x = F.col(n)
        center, scale = {"standardise": (F.avg(x), F.stddev_pop(x)), "maxabs": (F.lit(0.0), F.max(F.abs(x))), "minmax": (F.min(x), F.max(x) - F.min(x)), "skip": (F.lit(0.0), F.lit(1.0))}[rule]
        aggs.append(F.struct(center.cast("double").alias("c"), scale.cast("double").alias("s")).alias(n))
    row = df.agg(*aggs).first()
    return {n: (row[n]["c"] or 0.0, row[n]["s"] or 1.0) for n in rules}


def scaled(fitted: dict[str, tuple[float, float]]) -> list[Column]:
    return [((F.col(n) - c) / s).alias(n) for n, (c, s) in fitted.items()]


def one_hot(column: str, categories: list) -> list[Column]:
    """One column a category; an unknown value has zeros in all."""
    return [(F.col(column).eqNullSafe(F.lit(v))).cast("int").alias(f"{column}_{v}") for v in categories]


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill nulls with the mean and say where, for models that take no missing values."""
    return imputed(df, {n: m for n, m in df.agg(*[F.avg(n).alias(n) for n in columns]).first().asDict().items()})


def imputed(df: DataFrame, means: dict[str, float]) -> DataFrame:
    """Fill nulls with given means (those of the training) and say where."""
    return df.withColumns({f"{n}_missing": F.col(n).isNull().cast("int") for n in means} | {n: F.coalesce(F.col(n).cast("double"), F.lit(m)) for n, m in means.items()})


@dataclass(frozen=True)
class TargetEncoder:
    """A feature from the target: the mean of ``value`` over the other training rows of the group."""

    group: str
    value: Column
    name: str

    def fit(self, train: DataFrame) -> TargetEncoding:
        return TargetEncoding(self, fit_group_means(train, self.group, self.value, self.name))


@dataclass(frozen=True)
class TargetEncoding:
    """A fitted encoder: training rows leave their own target out, all others take the group's mean."""

    encoder: TargetEncoder
    means: DataFrame

    def transform_train(self, train: DataFrame) -> DataFrame:
        return leave_one_out(train, self.encoder.group, self.encoder.value, self.encoder.name)

    def transform(self, df: DataFrame) -> DataFrame:
        return apply_group_means(df, self.means, self.encoder.group)
