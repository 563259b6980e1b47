"""Exact nearest neighbours by Euclidean distance, by pivots and the triangle inequality.

Pivots are training points; every point belongs to the cell of its nearest pivot, and a cell is cut into blocks of points at about the same distance
from it. A query first looks at the block of its own cell at its own distance, which bounds how far its neighbour can be. Then it meets only blocks that
can hold a point within that bound: |distance to the pivot - distance of the block's points to it| is at most the bound, and the cell reaches over the plane
between its pivot and the query's. Queries that meet a block are compared with it in groups, so that neither side is repeated for each row of the other.

Equal training points are one point with its two least keys, so that many copies cost no more than one. Pivots are PIVOTS at most (a bounded table in
every task); blocks grow in number with the rows, not in size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: The most pivots; there are as many as the square root of the points otherwise.
PIVOTS = 1024
#: Points of a block, and queries that are compared with it at once, about.
BLOCK_ROWS = 1000
#: Distances are compared with so much to spare, for rounding.
SPARE = 1e-9


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed column by column, so that equal pairs of points give equal bits wherever they are compared."""
    out = np.zeros((len(a), len(b)))
    for n in range(a.shape[1]):
        gap = a[:, n][:, None] - b[:, n][None, :]
        out += gap * gap
    return out


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _placed(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot (``cell``, the first of equally near ones) and the distance to it (``r``) to rows with a point ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            d = np.sqrt(_squares(_matrix(part.column("x"), pivots.shape[1]), pivots))
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(d[np.arange(len(d)), cell])], names=[*part.schema.names, "cell", "r"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("cell", T.LongType()), T.StructField("r", T.DoubleType())]))


def _points(train: DataFrame, itself: bool) -> DataFrame:
    """Distinct points x with their least key and its target (k1, y1), and the next key (k2, y2) if a query may be the first."""
    least = train.groupBy("x").agg(F.min(F.struct("k", "y")).alias("one"))
    if itself:
        return least.select("x", F.col("one.k").alias("k1"), F.col("one.y").alias("y1"), F.lit(None).cast(train.schema["k"].dataType).alias("k2"), F.lit(None).cast(train.schema["y"].dataType).alias("y2"))
    others = train.join(least, "x").filter(F.col("k") != F.col("one.k")).groupBy("x").agg(F.min(F.struct("k", "y")).alias("two"))
    both = least.join(others, "x", "left")
    return both.select("x", *[F.col(f"{s}.{c}").alias(f"{c}{n}") for n, s in ((1, "one"), (2, "two")) for c in ("k", "y")])


def _blocked(points: DataFrame) -> DataFrame:
    """Points with the block they are in: cell, ring of distance, and part of a crowded ring; and the ring's width, as the query needs it."""
    cells = points.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("reach"))
    shaped = cells.select("cell", "reach", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.lit(1)).alias("rings"))
    ringed = points.join(F.broadcast(shaped), "cell").withColumn("ring", _ring(F.col("r")))  # a row a pivot
    crowded = ringed.groupBy("cell", "ring").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.lit(1)).alias("parts"))
    return ringed.join(crowded, ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts"))).drop("parts", "reach", "rings")


def _ring(r) -> object:
    return F.when(F.col("reach") > 0, F.least(F.floor(r / F.col("reach") * F.col("rings")), F.col("rings") - 1)).otherwise(F.lit(0))


BLOCK = ["cell", "ring", "part"]


def nearest_neighbour(queries: DataFrame, train: DataFrame, key: str, columns: list[str], target: str, itself: bool = False, work: Accumulator | None = None) -> DataFrame:
    """query_key, neighbour_key, neighbour_target: exact 1-NN, ties to the least key.

    Rows with a null or NaN in a column, or without a key, are near nothing. Without ``itself`` a row with the query's key is no neighbour of it.
    Keys of queries, and of training rows, are unique. ``work`` counts the pairs that are compared.
    """
    spark, width = train.sparkSession, len(columns)
    point = F.array(*[F.col(n).cast("double") for n in columns]).alias("x")
    some = lambda df, *more: df.dropna(subset=[key, *columns]).select(F.col(key).alias("k"), point, *more)
    known, asked = some(train, F.col(target).alias("y")), some(queries)
    points = _points(known, itself)
    n = known.count()
    chosen = points.orderBy(F.xxhash64("x"), "x").select("x").limit(max(1, min(PIVOTS, int(n**0.5)))).collect()
    pivots = np.array([r["x"] for r in chosen]).reshape(len(chosen), width)
    names = {"query_key": queries.schema[key].dataType, "d2": T.DoubleType(), "neighbour_key": train.schema[key].dataType, "neighbour_target": train.schema[target].dataType}
    if not len(pivots):
        return spark.createDataFrame([], T.StructType([T.StructField(c, t) for c, t in names.items() if c != "d2"]))

    blocked = _blocked(_placed(points, pivots).persist()).persist()  # both are read many times, and each would be placed anew
    packed = blocked.groupBy(*BLOCK).agg(F.collect_list(F.struct("x", "k1", "y1", "k2", "y2")).alias("points"))
    cells = blocked.groupBy("cell").agg(F.max("r").alias("reach"), F.count("*").alias("n")).select("cell", "reach", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.lit(1)).alias("rings"))
    placed = _placed(asked, pivots)
    schema = T.StructType([T.StructField(c, t) for c, t in names.items()])
    near = lambda met: _compared(met, packed, width, itself, schema, work).groupBy("query_key").agg(F.min(F.struct("d2", "neighbour_key", "neighbour_target")).alias("best"))

    own = placed.join(F.broadcast(cells), "cell").withColumn("ring", _ring(F.col("r"))).withColumn("part", F.lit(0).cast("long"))
    first = near(own.select(*BLOCK, "k", "x"))
    bounded = placed.join(first.select(F.col("query_key").alias("k"), F.sqrt("best.d2").alias("bound")), "k", "left")
    reach = {r["cell"]: r["reach"] for r in cells.collect()}  # a row a pivot
    met = _met(bounded, pivots, np.array([reach.get(i, -np.inf) for i in range(len(pivots))]))
    spans = blocked.groupBy(*BLOCK).agg(F.min("r").alias("low"), F.max("r").alias("high"))
    spare = F.col("far") + SPARE * (1 + F.col("far") + F.col("d"))
    candidates = met.join(spans, "cell").filter((F.col("low") <= F.col("d") + spare) & (F.col("high") >= F.col("d") - spare))
    found = near(candidates.select(*BLOCK, "k", "x"))
    return found.select("query_key", F.col("best.neighbour_key").alias("neighbour_key"), F.col("best.neighbour_target").alias("neighbour_target"))


def _met(queries: DataFrame, pivots: np.ndarray, reach: np.ndarray) -> DataFrame:
    """For each query the cells that can hold a point within its bound: k, x, cell, distance d to its pivot, and the bound (``far``; infinite without one)."""
    between = np.sqrt(_squares(pivots, pivots))
    names, kind = ["k", "x", "cell", "d", "far"], queries.schema["k"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            d2 = _squares(_matrix(part.column("x"), pivots.shape[1]), pivots)
            d, own = np.sqrt(d2), part.column("cell").to_numpy(zero_copy_only=False)
            far = part.column("bound").to_numpy(zero_copy_only=False).astype(float)
            far = np.where(np.isnan(far), np.inf, far)
            rows = np.arange(len(d))
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d2 - d2[rows, own][:, None]) / (2 * between[own])
            plane = np.where(np.isfinite(plane), plane, 0)
            spare = (far + SPARE * (1 + np.where(np.isinf(far), 0, far)))[:, None] + SPARE * d
            row, cell = np.nonzero((np.maximum(d - reach, plane) <= spare) & (reach >= 0))
            for at in range(0, len(row), 65536):
                i, c = row[at : at + 65536], cell[at : at + 65536]
                yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(i)), part.column("x").take(pa.array(i)), pa.array(c), pa.array(d[i, c]), pa.array(far[i])], names=names)

    return queries.mapInArrow(run, T.StructType([T.StructField("k", kind), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("cell", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("far", T.DoubleType())]))


def _compared(met: DataFrame, packed: DataFrame, width: int, itself: bool, schema: T.StructType, work: Accumulator | None) -> DataFrame:
    """The nearest point of the block for each pair of a query (k, x) and a block."""
    groups = met.groupBy(*BLOCK).agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.lit(1)).alias("groups"))
    grouped = met.join(groups, BLOCK).withColumn("group", F.pmod(F.xxhash64("k"), F.col("groups")))
    asked = grouped.groupBy(*BLOCK, "group").agg(F.collect_list(F.struct("k", "x")).alias("queries"))
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, p = batch.column("queries")[i].values, batch.column("points")[i].values
                d2 = _squares(_matrix(q.field("x"), width), _matrix(p.field("x"), width))
                if work is not None:
                    work.add(d2.size)
                asking, first, second = (v.to_pylist() for v in (q.field("k"), p.field("k1"), p.field("k2")))
                order = {k: n for n, k in enumerate(sorted({*first, *(k for k in second if k is not None)}))}
                code = np.array([order[k] for k in first])
                use = np.broadcast_to(code, d2.shape)
                mine = np.zeros(d2.shape, bool)
                if not itself:
                    mine = np.array([order.get(k, -1) for k in asking])[:, None] == code[None, :]
                    next_ = np.array([order[k] if k is not None else -1 for k in second])
                    d2[mine & (next_ < 0)[None, :]] = np.inf
                    use = np.where(mine, next_[None, :], use)
                least = d2.min(1)
                at = np.where(d2 == least[:, None], use, len(order)).argmin(1)
                ok = np.flatnonzero(np.isfinite(least))
                one, two = p.field("y1").to_pylist(), p.field("y2").to_pylist()
                rows = [(asking[j], float(least[j]), second[at[j]] if mine[j, at[j]] else first[at[j]], two[at[j]] if mine[j, at[j]] else one[at[j]]) for j in ok]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], type=t) for n, t in enumerate(kinds)], names=schema.names)

    return asked.join(packed, BLOCK).select("queries", "points").mapInArrow(run, schema)
