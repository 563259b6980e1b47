"""Running experiments: parameters of an evaluation, run ids, logs, and the evaluation of learners."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import REGRESSION, Metric, classification
from ..sources.io import append_results
from .dataset import Dataset, experiment_name, split_train_test
from .learners import save_best
from .models import Learner, NearestNeighbour, compare, cross_validate, fold_metrics, leaderboard
from .run_store import RunStore

log = logging.getLogger("tablewright")


@dataclass(frozen=True)
class EvaluationParams:
    """How models are evaluated: share and seed of the test rows, the positive class (None: regression), folds of a cross-validation."""

    test_fraction: str = "0.3"
    seed: int = 42
    positive: object = None
    folds: int = 3

    @property
    def metrics(self) -> tuple[Metric, ...]:
        return REGRESSION if self.positive is None else classification(self.positive)


def run_id(now: datetime | None = None) -> str:
    """The time of a run, to the second, as text that sorts."""
    return (now or datetime.now(UTC)).strftime("%Y%m%d-%H%M%S")


def evaluate_learners(df: DataFrame, key: str, learners: list[Learner | NearestNeighbour], params: EvaluationParams = EvaluationParams(), sink: tuple[str, str] | None = None) -> DataFrame:
    """One row a learner, best first: all fitted on one split and scored on its test rows. ``sink``: (path, experiment) to append the rows to.

    A learner that fails is a row with its error."""
    rows = split_train_test(df, key, params.test_fraction, params.seed)
    fits = {x.name: (lambda train, x=x: x.fit(train).transform) for x in learners}
    out = compare(fits, rows.filter("not is_test"), rows.filter("is_test"), params.metrics, "target", errors=True)
    if sink:
        append_results(out, *sink, run_id())
    return out


def cross_validate_learner(df: DataFrame, key: str, learner: Learner | NearestNeighbour, params: EvaluationParams = EvaluationParams()) -> DataFrame:
    """Mean and deviation of each metric over the folds; everything is fitted anew in each."""
    return cross_validate(df, key, params.folds, lambda train: learner.fit(train).transform, params.metrics, "target")


def track_experiment(store: RunStore, dataset: Dataset, base: str, df: DataFrame, learners: list[Learner | NearestNeighbour], params: EvaluationParams = EvaluationParams(), cross_validated: bool = False, run: str | None = None, models: str | None = None) -> DataFrame:
    """Evaluate learners on a data set and keep all of it as a run of the experiment that the data set names; returns the results, best first.

    Kept are the parameters of data set, split and learners, the results as text in the log, and the metrics of each learner, with ``cross_validated``
    of each learner and fold. With ``models``, the best regressor is fitted on all rows and kept below that folder as the best of the data set.
    """
    name = experiment_name(base, dataset, cross_validated)
    described = {"dataset": repr(dataset), "params": repr(params)} | {f"model.{x.name}": repr(x) for x in learners}
    with store.run(name, run or run_id(), described, f"{base} on {dataset.tag}") as kept:
        if cross_validated:
            rows = None
            for x in learners:
                folds = fold_metrics(df, dataset.key, params.folds, lambda train, x=x: x.fit(train).transform, params.metrics, "target").select(F.lit(x.name).alias("model"), "*")
                rows = folds if rows is None else rows.unionByName(folds)
            kept.table(rows, fold="fold")
            results = leaderboard(rows.groupBy("model").agg(*[F.avg(m.name).alias(m.name) for m in params.metrics]), params.metrics[0])
        else:
            results = evaluate_learners(df, dataset.key, learners, params)
            kept.table(results)
        kept.log(log_table(results))
        if models and params.positive is None and (best := results.filter(F.col(params.metrics[0].name).isNotNull()).first()):
            chosen = next(x for x in learners if x.name == best["model"])
            if isinstance(chosen, Learner):
                kept.log(f"best: {save_best(chosen.fit(df), models, dataset)}")
    return results


def log_table(df: DataFrame, rows: int = 50) -> str:
    """Log the first rows of a small result as text."""
    text = "\n".join(["\t".join(df.columns), *["\t".join(map(str, r)) for r in df.limit(rows).collect()]])
    log.info("%s", text)
    return text


def run_main(main: Callable[[], object], file: str | None = None) -> object:
    """Run with logs on the console and, if named, in a file; an exception is logged and raised again."""
    handlers = [logging.StreamHandler(), *([logging.FileHandler(file)] if file else [])]
    for h in handlers:
        h.setFormatter(logging.Formatter("%(levelname)s %(asctime)s %(name)s - %(message)s"))
        log.addHandler(h)
    log.setLevel(logging.INFO)
    try:
        return main()
    except Exception:
        log.exception("the run failed")
        raise
    finally:
        for h in handlers:
            log.removeHandler(h)
            h.close()
