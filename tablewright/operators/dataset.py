"""Declaring a dataset: cleaning, exact samples, labels, splits and folds."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import CUTS, ERRORS, SMALL, Cuts, value_at


def hash_of(key: str, seed: int) -> Column:
    """A seeded hash of a row's key as hexadecimal text; the same on every engine that has md5. A null key has one too."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("\x00"))))


def first_by_hash(df: DataFrame, key: str, n: int, seed: int, flag: str, size: int | None = None) -> DataFrame:
    """Flag exactly n rows (all, if there are fewer): those with the least seeded hashes, without a sort. ``size`` saves counting the rows.

    The n-th hash is found by counting (``ranks``). Rows that share the key at the edge are told apart by a hash of the whole row; of rows that are
    equal in all columns, it does not matter which are flagged, so they are made anew from one of them, however many they are.
    """
    if n <= 0:
        return df.withColumn(flag, F.lit(False))
    size = df.count() if size is None else size
    if n >= size:
        return df.withColumn(flag, F.lit(True))
    key_hash = hash_of(key, seed)
    found = value_at(df, [key_hash.alias("_h")], n, size, first=_cuts_of_hashes(n, size))
    h, take = F.lit(found.value["_h"]), n - found.before
    if take == found.same:  # no key is parted, as with unique keys
        return df.withColumn(flag, key_hash <= h)
    marked = df.withColumns({"_h": key_hash, "_r": F.xxhash64(*[F.struct(F.col(f"`{c}`")) for c in df.columns])})
    found = value_at(marked.filter(F.col("_h") == h), ["_r"], take, found.same)
    r, take = F.lit(found.value["_r"]).cast("long"), take - found.before
    below, tie = (F.col("_h") < h) | ((F.col("_h") == h) & (F.col("_r") < r)), (F.col("_h") == h) & (F.col("_r") == r)
    if take == found.same:
        return marked.withColumn(flag, below | tie).drop("_h", "_r")
    one = marked.filter(tie).select(*df.columns).limit(1)
    equal = df.sparkSession.range(found.same).crossJoin(F.broadcast(one)).withColumn(flag, F.col("id") < take).drop("id")  # one row, as often as it was there
    return marked.filter(~tie).withColumn(flag, below).drop("_h", "_r").unionByName(equal)


def _cuts_of_hashes(n: int, size: int) -> Cuts:
    """First cuts around the n-th of so many hashes: md5 spreads keys evenly, so it is near the n-th part of all hashes, unless some keys have many rows.

    The SMALL rows in the middle are counted by value at once. Where it may lie farther off, there are parts of half as many rows on either side.
    """
    far = ERRORS * math.sqrt(n * (1 - n / size)) + 1  # in rows
    steps = min(CUTS // 2, max(0, math.ceil(2 * far / SMALL) - 1))
    side = [SMALL / 2 + (far - SMALL / 2) * k / steps for k in range(1, steps + 1)]
    near = min(far, SMALL / 2)
    shares = [(n + x) / size for x in [*(-x for x in reversed(side)), -near, near, *side]]
    few = [False] * (steps + 1) + [True] + [False] * (steps + 1)
    known = [i for i, x in enumerate(shares) if 0 < x < 1]
    return Cuts([(f"{int(shares[i] * 2**128):032x}",) for i in known], few[known[0] : known[-1] + 2] if known else [False])


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return first_by_hash(df, key, n, seed, "_take").filter("_take").drop("_take")


def split_train_test(df: DataFrame, key: str, fraction: str = "0.3", seed: int = 42, rows: int | None = None) -> DataFrame:
    """Add is_test: exactly the fraction of rows, rounded up."""
    size = df.count() if rows is None else None
    return first_by_hash(df, key, math.ceil(Decimal(fraction) * (rows if size is None else size)), seed, "is_test", size)


def split_by_time(df: DataFrame, time: str, key: str, fraction: str = "0.3", edge: tuple | None = None) -> DataFrame:
    """Add is_test: the latest rows, the fraction of them rounded up; ties in time go by the key. Null times are training rows.

    ``edge`` is the time and key of the first of the latest rows; where it is known, the rows are not searched.
    """
    timed, at = df.filter(F.col(time).isNotNull()), F.struct(F.col(time).alias("t"), F.col(key).alias("k"))
    if edge is None:
        size = timed.count()
        n = math.ceil(Decimal(fraction) * size)
        if n == 0:
            return df.withColumn("is_test", F.lit(False))
        edge = value_at(timed, [F.col(time).alias("t"), F.col(key).alias("k")], size - n + 1, size).value
    kinds = T.StructType([T.StructField("edge", timed.select(at.alias("x")).schema["x"].dataType)])
    one = df.sparkSession.createDataFrame([(edge,)], kinds).coalesce(1)  # one row
    return df.crossJoin(F.broadcast(one)).withColumn("is_test", F.coalesce(at >= F.col("edge"), F.lit(False)) & F.col(time).isNotNull()).drop("edge")


def fold_of(key: str, k: int, seed: int = 42) -> Column:
    return F.pmod(F.conv(F.substring(hash_of(key, seed), 1, 6), 16, 10).cast("long"), F.lit(k)).cast("int")


def label(value: str, threshold: float, positive: str = "popular", negative: str = "unpopular") -> Column:
    """The threshold itself is positive."""
    return F.when(F.col(value) >= threshold, F.lit(positive)).otherwise(F.lit(negative))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def drop_missing(df: DataFrame) -> DataFrame:
    """Rows without null or NaN in any column."""
    return df.na.drop("any")


def numeric_columns(df: DataFrame) -> list[str]:
    from pyspark.sql.types import NumericType

    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


@dataclass(frozen=True)
class Dataset:
    """What defines the data of an experiment."""

    key: str
    target: str
    num_samples: int | None = None
    drop_zero: bool = False
    threshold: float = 50
    seed: int = 42
    is_classification: bool = True

    @property
    def tag(self) -> str:
        parts = ["full" if self.num_samples is None else f"numSamples{self.num_samples}"]
        parts += ["drop"] * self.drop_zero
        parts += [f"threshold{self.threshold:g}"] * (self.threshold != 50)
        parts += [f"seed{self.seed}"] * (self.seed != 42)
        return "-".join(parts)

    def load(self, df: DataFrame) -> DataFrame:
        """Missing values, zero targets, sample, label: in this order."""
        df = drop_missing(require_columns(df, self.key, self.target))
        if self.drop_zero:
            df = df.filter(F.col(self.target) > 0)
        if self.num_samples is not None:
            df = sample_exact(df, self.key, self.num_samples, self.seed)
        return df.withColumn("popularity_class", label(self.target, self.threshold)) if self.is_classification else df


def experiment_name(base: str, dataset: Dataset, cross_validated: bool = False) -> str:
    return "_".join([base, dataset.tag] + ["CV"] * cross_validated)
