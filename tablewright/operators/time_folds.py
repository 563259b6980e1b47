"""Cross-validation that respects time: expanding training rows, and a choice of model within each fold that sees nothing later."""

from __future__ import annotations

import math
from collections.abc import Callable
from contextlib import ExitStack
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import Metric, evaluate
from .dataset import split_by_time
from .ranks import values_at
from .side_by_side import SideBySide, kept


def time_folds(df: DataFrame, time: str, key: str, folds: int) -> DataFrame:
    """Add ``fold``: 0 for the first rows, which are training rows of all folds, then 1 to ``folds``, each of the rows that follow in time.

    All parts have the same number of rows, but for rounding; ties in time go by the key. Rows without a time have no fold (null).
    Fold i is tested on its own rows, after a training on the rows of all smaller folds.
    """
    if folds < 1:
        raise ValueError("there must be a fold")
    at = F.struct(F.col(time).alias("t"), F.col(key).alias("k"))
    timed = df.filter(F.col(time).isNotNull())
    n = timed.count()
    ends = [n * i // (folds + 1) for i in range(1, folds + 1)]
    rows = timed.select(F.lit(0).alias("g"), at.alias("x"))
    found = values_at(rows, {0: [e for e in ends if e]}, {0: n})
    kinds = T.StructType([T.StructField("fold_ends", T.ArrayType(rows.schema["x"].dataType))])
    edges = df.sparkSession.createDataFrame([([found[0, e].value for e in ends if e],)], kinds)  # one row
    past = F.size(F.filter("fold_ends", lambda e: at > e)) + F.lit(sum(not e for e in ends))
    return df.crossJoin(F.broadcast(edges)).withColumn("fold", F.when(F.col(time).isNotNull(), past).cast("int")).drop("fold_ends")


def rolling_origin(
    df: DataFrame, time: str, key: str, models: dict[str, Callable[[DataFrame], Callable[[DataFrame], DataFrame]]], metrics: tuple[Metric, ...], truth: str, folds: int = 3, inner: str = "0.3", prediction: str = "prediction", threads: int = 4
) -> DataFrame:
    """One row a fold: fold, n_train, n_test, the model that was chosen, and its metrics on the fold's test rows.

    A model is chosen by the first metric on the latest share (``inner``) of the fold's training rows, after a fit on the rows before these;
    it is fitted again on all of them. Nothing of a fold's test rows, or of later ones, is seen before. A fold without
    rows to test or to train on, or whose models all fail, has null metrics.
    """
    best = max if metrics[0].larger_is_better else min

    def score(fit, train: DataFrame, test: DataFrame, names: tuple[Metric, ...]):
        return evaluate(fit(train)(test), names, truth, prediction).first()

    def one(rows: DataFrame, fold: int, n_train: int, n_test: int, edge) -> tuple:
        train, test = rows.filter(F.col("fold") < fold).drop("fold"), rows.filter(F.col("fold") == fold).drop("fold")
        nothing = (fold, n_train, n_test, None, *[None] * len(metrics))
        if not n_train or not n_test:
            return nothing
        parted = split_by_time(train, time, key, inner, edge)
        early, late = parted.filter("not is_test").drop("is_test"), parted.filter("is_test").drop("is_test")
        scores = {}
        for name, fit in models.items():
            try:
                scores[name] = score(fit, early, late, metrics[:1])[0]
            except Exception as error:  # a model that fails is not chosen
                failed[fold, name] = str(error)
        known = {n: v for n, v in scores.items() if v is not None}
        if not known:
            return nothing
        chosen = best(sorted(known), key=known.get)
        return (fold, n_train, n_test, chosen, *score(models[chosen], train, test, metrics))

    failed: dict[tuple[int, str], str] = {}
    level = df.storageLevel
    with ExitStack() as while_used:
        with kept(*[] if level.useMemory or level.useDisk else [df]):  # read once for the folds; what the caller keeps is not released here
            (rows,) = while_used.enter_context(kept(time_folds(df, time, key, folds)))
            sizes = {r["fold"]: r["count"] for r in rows.filter("fold is not null").groupBy("fold").count().collect()}
        trained = {i: sum(n for fold, n in sizes.items() if fold < i) for i in range(1, folds + 1)}
        # The training rows of a fold are the first of all in time, so one search finds where the inner test rows of all folds begin.
        first = {i: n - late + 1 for i, n in trained.items() if (late := math.ceil(Decimal(inner) * n))}
        timed = rows.filter("fold is not null").select(F.lit(0).alias("g"), F.struct(F.col(time).alias("t"), F.col(key).alias("k")).alias("x"))
        found = values_at(timed, {0: list(first.values())}, {0: sum(sizes.values())})
        edges = {i: found[0, rank].value for i, rank in first.items()}
        done = SideBySide(df.sparkSession, threads)({str(i): (lambda i=i: one(rows, i, trained[i], sizes.get(i, 0), edges.get(i))) for i in range(1, folds + 1)})
    if errors := [x.error for x in done if x.error]:
        raise RuntimeError(f"a fold failed: {errors[0]}")
    return df.sparkSession.createDataFrame([tuple(float(v) if i > 3 and v is not None else v for i, v in enumerate(x.value)) for x in done], "fold int, n_train long, n_test long, model string, " + ", ".join(f"`{m.name}` double" for m in metrics))
