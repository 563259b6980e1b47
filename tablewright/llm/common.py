"""What the operators of this package share: scratch tables, batches, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where scratch tables go when the session names no spark.checkpoint.dir (single-machine runs and tests only).
LOCAL_SCRATCH = "/tmp/checkpoints"
#: Rows of a batch that a Python worker holds as Python objects at a time.
SLICE_ROWS = 256


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of this application, below spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SCRATCH
    return f"{base.rstrip('/')}/tablewright/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


class Stored:
    """A DataFrame cut from its lineage: written once to the shared folder and read from there; ``plain`` without dictionaries, where few values repeat."""

    def __init__(self, df: DataFrame, label: str, plain: bool = False):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, label)
        df.write.options(**{"parquet.enable.dictionary": "false"} if plain else {}).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only after everything that reads them has been written elsewhere."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    return Stored(df, label).df


#: Spark's setting for the rows of a batch that goes to Python at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored_in_batches(df: DataFrame, label: str, rows: int) -> DataFrame:
    """``stored`` with batches of so many rows at most for Python workers: executor and worker each hold a whole batch, which counts where rows are long."""
    spark = df.sparkSession
    before = spark.conf.get(BATCH)
    if 0 < int(before) <= rows:
        return stored(df, label)
    spark.conf.set(BATCH, rows)
    try:
        return stored(df, label)
    finally:
        spark.conf.set(BATCH, before)


#: Spark's setting for the bytes of such a batch, about.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: str):
    """Batches for Python workers have so many bytes meanwhile, about, or one row: for rows of any length."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


#: Rows of the bit table of ``likely``: 64 bits each, whatever the input.
FILTER_ROWS = 65536


def marked(rows: DataFrame, column: str, wanted: DataFrame, wanted_column: str, mark: str) -> DataFrame:
    """All rows with ``mark``: false only where the value is not in ``wanted`` (or null), so that those can stay out of an exact join.

    The table of bits that is broadcast has FILTER_ROWS rows at most.
    """
    slot = lambda x: F.pmod(F.xxhash64(x), F.lit(FILTER_ROWS))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(F.xxhash64(x), 32), F.lit(64)).cast("int"))
    bits = wanted.filter(F.col(wanted_column).isNotNull()).groupBy(slot(wanted_column).alias("_slot")).agg(F.bit_or(bit(wanted_column)).alias("_bits"))
    joined = rows.withColumn("_slot", slot(column)).join(F.broadcast(bits), "_slot", "left")
    hit = F.col(column).isNotNull() & (F.coalesce("_bits", F.lit(0).cast("long")).bitwiseAND(bit(column)) != 0)
    return joined.withColumn(mark, hit).drop("_slot", "_bits")


def likely(rows: DataFrame, column: str, wanted: DataFrame, wanted_column: str) -> DataFrame:
    """The rows whose value is in ``wanted``, and some more: a cheap filter before an exact join. Null values are dropped."""
    return marked(rows, column, wanted, wanted_column, "_likely").filter("_likely").drop("_likely")


def crc32_of(key: str | Column) -> Column:
    """Unsigned crc32 of a key written as text; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary"))


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def id_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key (as doc_id) and the whole text (as text, null: empty), whatever else the table has."""
    return docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text"))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def add_columns(
    df: DataFrame, column: str, fields: Sequence[T.StructField], make: Callable[[], Callable[[list], list[Sequence]]], drop: bool = False
) -> DataFrame:
    """Append columns computed in Python from one column, without a shuffle.

    ``make()`` runs once a task and returns a function from the list of the
    column's values to one sequence for each field. Existing columns of the
    same names are replaced; ``drop`` leaves the source column out.
    """
    names = [f.name for f in fields]
    keep = [f for f in df.schema.fields if f.name not in names]
    out = [f for f in keep if not (drop and f.name == column)] + list(fields)
    schema = T.StructType(out)
    arrow = {f.name: _arrow_type(f.dataType) for f in fields}
    source = df.select(*[F.col(f"`{f.name}`") for f in keep])
    kept = [f.name for f in out if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for part in slices(batches):
            values = apply(part.column(column).to_pylist())
            arrays = [part.column(n) for n in kept] + [pa.array(v, type=arrow[n]) for n, v in zip(names, values, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=kept + names)

    return source.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    return {
        T.LongType(): pa.int64(),
        T.IntegerType(): pa.int32(),
        T.DoubleType(): pa.float64(),
        T.BooleanType(): pa.bool_(),
        T.StringType(): pa.string(),
        T.BinaryType(): pa.binary(),
        T.ArrayType(T.LongType()): pa.list_(pa.int64()),
        T.ArrayType(T.IntegerType()): pa.list_(pa.int32()),
        T.ArrayType(T.DoubleType()): pa.list_(pa.float64()),
    }[kind]


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
