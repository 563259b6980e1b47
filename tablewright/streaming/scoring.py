"""Scoring a stream of raw records with a saved model, each record once."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import types as T


def score_stream(spark: SparkSession, source: str, schema: T.StructType, model: PipelineModel, columns: list[str], target: str, checkpoint: str) -> None:
    """Score all files that are there and end; run again for those that came since."""
    rows = spark.readStream.schema(schema).parquet(source)
    out = model.transform(rows).select(*columns)
    out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
