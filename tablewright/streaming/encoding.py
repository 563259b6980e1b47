"""Target encodings on a stream: each batch is joined with the encodings as they are when it begins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.features import apply_group_means, imputed


def encode_stream(spark: SparkSession, source: str, schema: T.StructType, encodings: dict[str, tuple[str, str]], target: str, checkpoint: str, means: dict[str, float] | None = None, then: Callable[[DataFrame], DataFrame] | None = None, files: int | None = None) -> None:
    """Encode all rows that are there and end; run again for those that came since.

    ``encodings`` has for each feature its group and the path of a table (group, feature), which may be replaced between batches: a batch sees
    what is there when it begins. Unknown groups have null, or the given mean and a mark. ``then`` goes on with the encoded batch, for instance to
    score it. A batch is a folder of ``target`` by its number, and replaces itself if it is repeated after a failure, so each row is
    written once. ``files`` bounds the files of a batch.
    """
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        for name, (group, path) in encodings.items():
            batch = apply_group_means(batch, batch.sparkSession.read.parquet(path).select(group, name), group)
        batch = imputed(batch, means) if means else batch
        (then(batch) if then else batch).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
