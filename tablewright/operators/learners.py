"""Fitted learners as models of Spark ML: stored with their target encodings, loaded, and served.

A stored learner is a folder: its parameters, the pipeline of its features and estimator, and a table for each target encoding. It needs nothing
of its training rows. What is loaded scores raw records in one call, in batches or streams.
"""

from __future__ import annotations

from pyspark.ml import Model, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import model_path, records, to_records
from .dataset import Dataset
from .features import TargetEncoder, TargetEncoding, imputed

#: Where the best regressor of a dataset is kept, below the folder of its tag.
BEST = "best_model"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class _Writer(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=self.model._extra())
        self.model._save_parts(path)


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls._load_parts(self.sparkSession, path, metadata)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _Stored(MLWritable, MLReadable):
    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class FittedLearner(Model, _Stored):
    """Encodings, means for missing ones (none if the estimator takes missing values itself), and the fitted pipeline; adds ``prediction``.

    A group that the training did not have, and a null group that it did not have, have no encoding: the mean, or a missing value.
    """

    def __init__(self, name: str, model: PipelineModel, encodings: list[TargetEncoding] | tuple = (), means: dict[str, float] | None = None):
        super().__init__()
        self.name, self.model, self.encodings, self.means = name, model, list(encodings), dict(means or {})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for e in self.encodings:
            dataset = e.transform(dataset)
        return self.model.transform(imputed(dataset, self.means) if self.means else dataset)

    def _extra(self) -> dict:
        return {"name": self.name, "means": self.means, "encodings": [[e.encoder.group, e.encoder.name] for e in self.encodings]}

    def _save_parts(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/pipeline")
        for k, e in enumerate(self.encodings):
            e.means.write.mode("overwrite").parquet(f"{path}/encodings/{k}")

    @classmethod
    def _load_parts(cls, spark: SparkSession, path: str, metadata: dict) -> FittedLearner:
        # A loaded encoding applies its means; the target's expression is of no use without training rows.
        encodings = [TargetEncoding(TargetEncoder(group, F.lit(None), name), spark.read.parquet(f"{path}/encodings/{k}")) for k, (group, name) in enumerate(metadata["encodings"])]
        return cls(metadata["name"], PipelineModel.load(f"{path}/pipeline"), encodings, metadata["means"])


class ClassifierFromRegressor(Model, _Stored):
    """The classes that a regressor's predictions stand for: adds ``predicted_class`` and a hard probability of each class; the threshold is positive."""

    threshold = Param(Params._dummy(), "threshold", "least prediction of the positive class", TypeConverters.toFloat)
    positive = Param(Params._dummy(), "positive", "name of the class from the threshold on", TypeConverters.toString)
    negative = Param(Params._dummy(), "negative", "name of the class below the threshold", TypeConverters.toString)

    def __init__(self, regressor: Model, threshold: float = 50.0, positive: str = "popular", negative: str = "unpopular"):
        super().__init__()
        self.regressor = regressor
        self._set(threshold=threshold, positive=positive, negative=negative)

    @property
    def name(self) -> str:
        return f"FromRegressor[{getattr(self.regressor, 'name', type(self.regressor).__name__)}]"

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from .models import regressor_as_classifier

        values = [self.getOrDefault(n) for n in ("threshold", "positive", "negative")]
        return self.regressor.transform(dataset).select("*", *regressor_as_classifier("prediction", *values))

    def _extra(self) -> dict:
        return {}

    def _save_parts(self, path: str) -> None:
        self.regressor.write().overwrite().save(f"{path}/regressor")

    @classmethod
    def _load_parts(cls, spark: SparkSession, path: str, metadata: dict) -> ClassifierFromRegressor:
        return cls(DefaultParamsReader.loadParamsInstance(f"{path}/regressor", spark))


class NumbersFromClasses(Model, _Stored):
    """A classifier whose classes are numbers: its ``prediction``, a place among them, becomes the number."""

    def __init__(self, classifier: Model, values: list[float]):
        super().__init__()
        self.classifier, self.values = classifier, list(values)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        place = (F.col("prediction") + 1).cast("int")
        return self.classifier.transform(dataset).withColumn("prediction", F.element_at(F.array(*map(F.lit, self.values)), place))

    def _extra(self) -> dict:
        return {"values": self.values}

    def _save_parts(self, path: str) -> None:
        self.classifier.write().overwrite().save(f"{path}/classifier")

    @classmethod
    def _load_parts(cls, spark: SparkSession, path: str, metadata: dict) -> NumbersFromClasses:
        return cls(DefaultParamsReader.loadParamsInstance(f"{path}/classifier", spark), metadata["values"])


def save_best(model: Model, folder: str, dataset: Dataset) -> str:
    """Keep a regressor as the best of its dataset, in place of an earlier one; folders are made. Returns the path."""
    path = model_path(folder, dataset.tag, BEST)
    model.write().overwrite().save(path)
    return path


def load_learner(spark: SparkSession, path: str) -> Model | None:
    """Any stored model, or None if there is none."""
    return DefaultParamsReader.loadParamsInstance(path, spark) if exists(spark, path) else None


def classifier_from_best(spark: SparkSession, folder: str, dataset: Dataset, positive: str = "popular", negative: str = "unpopular") -> ClassifierFromRegressor | None:
    """The classifier that the best stored regressor of a dataset is; None without one."""
    regressor = load_learner(spark, model_path(folder, dataset.tag, BEST))
    return None if regressor is None else ClassifierFromRegressor(regressor, dataset.threshold, positive, negative)


def predict(spark: SparkSession, model: Model, rows: list[dict], schema: T.StructType, columns: tuple[str, ...] = ("prediction",)) -> list[dict]:
    """Raw records in, predictions out, in the records' order; a field that is not there is refused."""
    place = T.StructField("_place", T.LongType())
    numbered = records(spark, [r | {"_place": k} for k, r in enumerate(rows)], T.StructType([*schema.fields, place]))
    return to_records(model.transform(numbered).orderBy("_place").select(*columns))
