"""Runs of experiments as tables: parameters, descriptions and logs of a run, and its metrics by model and fold.

Each run is a folder of each table. A run that is written again replaces itself, and no other run, so a repeated or resumed run is there once.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import Metric

RUNS = "started timestamp, parameters map<string,string>, description string, log string, failed string"
METRICS = "model string, fold int, metric string, value double"


@dataclass
class Run:
    """A run that goes on: what is known of it so far. Rows of a model and fold that are logged again replace the earlier ones."""

    experiment: str
    run_id: str
    parameters: dict[str, str]
    description: str
    started: datetime
    lines: list[str] = field(default_factory=list)
    values: dict[tuple[str, int | None, str], float | None] = field(default_factory=dict)

    def log(self, line: object) -> None:
        self.lines.append(str(line))

    def metrics(self, model: str, values: dict[str, float | None], fold: int | None = None) -> None:
        """Metrics of a model in a fold; without one, of the whole run."""
        self.values.update({(model, fold, n): None if v is None else float(v) for n, v in values.items()})

    def table(self, results: DataFrame, model: str = "model", fold: str | None = None) -> None:
        """Metrics from a small result with a row for each model (and fold): all its numbers."""
        names = [n for n, kind in results.dtypes if n not in (model, fold) and kind in ("double", "float", "int", "bigint")]
        for r in results.collect():
            self.metrics(r[model], {n: r[n] for n in names}, r[fold] if fold else None)


class RunStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @contextmanager
    def run(self, experiment: str, run_id: str, parameters: dict | None = None, description: str = ""):
        """A run as a context: what it has is written at its end, also if it fails; its error is kept and raised again."""
        run = Run(experiment, run_id, {k: str(v) for k, v in (parameters or {}).items()}, description, datetime.now(UTC).replace(tzinfo=None))
        failed = None
        try:
            yield run
        except BaseException as error:
            failed = f"{type(error).__name__}: {error}"
            raise
        finally:
            self._write("runs", run, [(run.started, run.parameters, run.description, "\n".join(run.lines), failed)], RUNS)
            self._write("metrics", run, [(*k, v) for k, v in run.values.items()], METRICS)

    def _write(self, table: str, run: Run, rows: list[tuple], schema: str) -> None:
        # A dynamic overwrite replaces only folders that have new rows; a run without metrics leaves one row that says so.
        rows = rows or [(None,) * len(schema.split(", "))]
        named = self.spark.createDataFrame(rows, schema).withColumns({"experiment": F.lit(run.experiment), "run_id": F.lit(run.run_id)})
        named.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment", "run_id").parquet(f"{self.path}/{table}")

    def _read(self, table: str, schema: str) -> DataFrame:
        whole = f"{schema}, experiment string, run_id string"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(f"{self.path}/{table}")

    @property
    def runs(self) -> DataFrame:
        return self._read("runs", RUNS)

    @property
    def values(self) -> DataFrame:
        return self._read("metrics", METRICS).filter("metric is not null")

    def means(self, experiment: str) -> DataFrame:
        """run_id, model, metric: the mean and standard deviation (of the population) over folds, or the value where there are none."""
        rows = self.values.filter(F.col("experiment") == experiment)
        by = rows.groupBy("run_id", "model", "metric")
        folds, whole = F.when(F.col("fold").isNotNull(), F.col("value")), F.when(F.col("fold").isNull(), F.col("value"))
        return by.agg(F.count(folds).alias("folds"), F.coalesce(F.max(whole), F.avg(folds)).alias("mean"), F.stddev_pop(folds).alias("std"))

    def best(self, experiment: str, metric: Metric) -> DataFrame:
        """The row of the best run and model by a metric, with the run's parameters; failed runs do not count, ties go to the earlier run."""
        good = self.runs.filter(F.col("failed").isNull() & (F.col("experiment") == experiment)).select("run_id", "started", "parameters")
        rows = self.means(experiment).filter((F.col("metric") == metric.name) & F.col("mean").isNotNull()).join(good, "run_id")
        order = F.desc("mean") if metric.larger_is_better else F.asc("mean")
        return rows.orderBy(order, "run_id", "model").limit(1)
