"""Sources and sinks: tables by format, typed records, results, models."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The songs table by name and kind, in the order of the contract; a request has all but the target.
SONGS = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("artist_name", T.StringType()),
            ("track_name", T.StringType()),
            ("track_id", T.StringType()),
            ("year", T.IntegerType()),
            ("genre", T.StringType()),
            ("danceability", T.DoubleType()),
            ("energy", T.DoubleType()),
            ("key", T.IntegerType()),
            ("loudness", T.DoubleType()),
            ("mode", T.IntegerType()),
            ("speechiness", T.DoubleType()),
            ("acousticness", T.DoubleType()),
            ("instrumentalness", T.DoubleType()),
            ("liveness", T.DoubleType()),
            ("valence", T.DoubleType()),
            ("tempo", T.DoubleType()),
            ("duration_ms", T.LongType()),
            ("time_signature", T.IntegerType()),
            ("popularity", T.IntegerType()),
        )
    ]
)
REQUEST = T.StructType([f for f in SONGS if f.name != "popularity"])


def load_data(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV (with header), JSON or Parquet by the name's ending.

    With a schema, columns are picked by name; a CSV cell that is not of its kind is null. Without one, kinds are inferred.
    """
    ending = path.rstrip("/").rpartition(".")[2].lower()
    if ending == "csv":
        header = spark.read.option("header", True).option("inferSchema", schema is None).csv(path)
        return header.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema]) if schema else header
    if ending == "json":
        reader = spark.read.option("multiLine", True)
        return (reader.schema(schema) if schema else reader).json(path)
    if ending == "parquet":
        return spark.read.parquet(path)
    raise ValueError("Unsupported file format!")


def load_columns(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document of columns, {"a": {"0": 1, "1": 2}, "b": {...}}, as one row for each key of the first column (in no order)."""
    whole = T.StructType([T.StructField(f.name, T.MapType(T.StringType(), f.dataType)) for f in schema])
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", whole).alias("d"))
    rows = doc.select("d", F.explode(F.map_keys(f"d.{schema[0].name}")).alias("_at"))
    return rows.select(*[F.try_element_at(F.col(f"d.{f.name}"), F.col("_at")).alias(f.name) for f in schema])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def find_data_dir(start: str = ".") -> str:
    """The first folder ``data`` in the given folder, its parent or that one's parent."""
    for up in (".", "..", "../.."):
        if (at := Path(start, up, "data")).is_dir():
            return str(at)
    raise FileNotFoundError("no folder 'data' here or in the two folders above")


def records(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """A typed frame of records; every field must be there."""
    for r in rows:
        if missing := [f.name for f in schema if f.name not in r]:
            raise ValueError(f"missing fields: {', '.join(missing)}")
    return spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)


def to_records(df: DataFrame) -> list[dict]:
    """Rows of a small result as dicts."""
    return [r.asDict() for r in df.collect()]


def append_results(df: DataFrame, path: str, experiment: str, run_id: str) -> None:
    """Result and trial rows, in a folder for each experiment and run."""
    df.withColumns({"experiment": F.lit(experiment), "run_id": F.lit(run_id)}).write.mode("append").partitionBy("experiment", "run_id").parquet(path)


def model_path(folder: str, tag: str, name: str) -> str:
    """Where the best model of a dataset, by its tag, is kept."""
    return f"{folder.rstrip('/')}/{tag}/{name}"


def save_model(model: PipelineModel, path: str) -> None:
    """Folders above are made; a model that is there is replaced."""
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str | None = None) -> PipelineModel | None:
    """A saved model, or None if there is none; the path may come from MODEL_PATH."""
    path = path or os.environ.get("MODEL_PATH", "models/best")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return PipelineModel.load(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def sample_record(path: str) -> dict:
    return json.loads(Path(path).read_text())
