"""Embedding near-duplicates: an exact metric range join in cells around pivots.

Vectors of one label and dimension are scaled to length 1, where a cosine of at
least t means a distance of at most e = sqrt(2 - 2 t). Each vector has its home
in the cell of its nearest pivot. It is replicated into another cell only if a
partner could have its home there: by the triangle inequality its distance to
that cell's pivot exceeds the one to its own by at most 2 e, and it lies within
e of the plane half way between the two. So both ends of a link are members of each other's home cell.

Replicas are bits: a vector is written once, to a block of its home cell in the shared folder, with a bit for each cell that it is a member of.
Two blocks are compared once, those vectors of each that are members of the other's cell. Tasks compare SIDE blocks with SIDE others
and read one pair at a time, so that the vectors on disk grow with the input alone, whatever the number of comparisons, and all tasks are bounded.

Equal vectors of a label are one class, known by a 128-bit hash of both and joined as one
with a count, so copies make no pairs. A task
gives the number of links of its classes and a spanning forest, not the links. Tables that vectors are joined with are stored first, so that Spark
knows their size and broadcasts small ones instead of shuffling the vectors.

Defined cases: a null label, a null or zero vector and one with null or
non-finite components links with nothing; vectors of different dimensions do
not link; rows that repeat a vec_id, or have none, are vectors of their own and link like others; the
component of vectors that all have no id is null, and all of them are kept; a cosine that is the threshold links; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c
from .components import connected
from .files import read_arrays, save_arrays
from .links import local_roots

#: Vectors of a label for one more pivot, and pivots of a label at most.
PIVOT_ROWS, MOST_PIVOTS = 2000, 16
#: Vectors of a block, about, and those of them that are compared with another block at once.
BLOCK_ROWS, TILE = 1000, 500
#: A task compares so many blocks with as many others.
SIDE = 8
#: Rows that are placed at once, each with the pivots of its label.
BATCH_ROWS = 1024


def _units(x: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps very large and very small vectors finite.
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _name(*columns: str | Column) -> Column:
    """A 128-bit hash of columns, as hexadecimal digits."""
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(n), *columns)), 16, "0") for n in (1, 2)])


def _pivots(reps: DataFrame) -> DataFrame:
    """label, dim, pivots: rows with the least hashes, some for each label."""
    sizes = c.stored(reps.groupBy("label", "dim").agg(F.count("*").alias("rows"), F.min("h").alias("least")), "sizes")
    want = sizes.withColumn("k", F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("rows") / PIVOT_ROWS)))
    share = F.lit(2.0**63) * F.least(F.lit(1.0), (4 * F.col("k") + 20) / F.col("rows"))
    near = reps.join(want, ["label", "dim"]).filter((F.col("h") <= share) | (F.col("h") == F.col("least")))
    return near.groupBy("label", "dim").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "embedding"))), 1, F.first("k").cast("int")).getField("embedding").alias("pivots"))


def link(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (least vec_id reachable), kept."""
    kind, values = vectors.schema[label].dataType.simpleString(), vectors.schema[embedding].dataType.simpleString()
    values = values if values == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast(values).alias("embedding"))
    fine = F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.withColumn("fine", F.coalesce(F.col("label").isNotNull() & fine, F.lit(False)))
    rep = _name("label", "embedding")
    group = rows.filter("fine").groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    reps = c.Stored(group.withColumns({"rep": rep, "dim": F.size("embedding"), "h": F.xxhash64("label", "embedding").bitwiseAND(F.lit(2**63 - 1))}), "vectors")
    e = math.sqrt(2 - 2 * threshold) + 1e-9

    def place(batches):
        for batch in batches:
            own, cells = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for (_, dim), at in batch.select(["label", "dim"]).to_pandas().groupby(["label", "dim"], sort=False).indices.items():
                x = _units(batch.column("embedding").take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim))
                p = _units(np.array(batch.column("pivots")[int(at[0])].as_py()))
                d2 = np.maximum(2 - 2 * x @ p.T, 0)
                d, home = np.sqrt(d2), d2.argmin(1)
                mine = np.arange(len(at))
                between = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))[home]
                near = (d - d[mine, home][:, None] <= 2 * e) & (d2 - d2[mine, home][:, None] <= 2 * between * e + 1e-9)
                near[mine, home] = True
                own[at], cells[at] = home, near @ (1 << np.arange(len(p)))
            kept = ["label", "dim", "rep", "copies", "least_id", "embedding"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(own), pa.array(cells)], names=[*kept, "cell", "cells"])

    with_pivots = reps.df.join(c.stored(_pivots(reps.df), "pivots"), ["label", "dim"]).select("label", "dim", "rep", "copies", "least_id", "embedding", "pivots")
    id_kind = reps.df.schema["least_id"].dataType.simpleString()
    placed = c.stored_in_batches(with_pivots.mapInArrow(place, f"label {kind}, dim int, rep string, copies long, least_id {id_kind}, embedding {values}, cell int, cells long"), "cells", BATCH_ROWS)
    reps.drop()
    sizes = c.stored(placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("nb")), "sizes")
    dealt = placed.join(sizes, ["label", "dim", "cell"]).withColumn("block", _name("label", "dim", "cell", F.pmod(F.xxhash64("rep"), F.col("nb"))))
    path = c.new_path(vectors.sparkSession, "blocks")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        save_arrays(f"{path}/{pdf['block'].iloc[0]}", x=np.stack(pdf["embedding"].to_list()), rep=pdf["rep"].to_numpy().astype("S32"), copies=pdf["copies"].to_numpy(), cells=pdf["cells"].to_numpy())
        return pdf[["label", "dim", "cell", "block"]][:1].assign(rows=len(pdf), cells=np.bitwise_or.reduce(pdf["cells"].to_numpy()))

    written = dealt.select("label", "dim", "cell", "block", "rep", "copies", "cells", "embedding").groupBy("block").applyInPandas(write, f"label {kind}, dim int, cell int, block string, rows long, cells long")
    side = F.floor((F.row_number().over(Window.partitionBy("label", "dim").orderBy("block")) - 1) / SIDE)
    blocks = c.stored(written.withColumn("side", side), "blocks")
    a, b = (blocks.select("label", "dim", *[F.col(n).alias(f"{n}_{s}") for n in ("block", "side", "cell", "cells", "rows")]) for s in "ab")
    has = lambda cells, cell: F.call_function("shiftright", F.col(cells), F.col(cell)).bitwiseAND(F.lit(1)) == 1
    pairs = a.join(b, ["label", "dim"]).filter((F.col("block_a") <= F.col("block_b")) & has("cells_a", "cell_b") & has("cells_b", "cell_a"))

    def load(block: str) -> tuple[np.ndarray, ...]:
        got = read_arrays(f"{path}/{block}")
        return _units(got["x"]), got["rep"], got["copies"], got["cells"]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        both = pd.concat([pdf[[f"block_{s}", f"rows_{s}"]].set_axis(["block", "rows"], axis=1) for s in "ab"]).drop_duplicates("block")
        first = dict(zip(both["block"], np.cumsum([0, *both["rows"]]), strict=False))
        n = int(both["rows"].sum())
        names, links, root = np.zeros(n, "S32"), np.zeros(n, np.int64), np.arange(n)
        for block_a, some in pdf.groupby("block_a", sort=False):
            left, at_a = load(block_a), first[block_a]
            names[at_a : at_a + len(left[1])] = left[1]
            for block_b, cell_a, cell_b in zip(some["block_b"], some["cell_a"], some["cell_b"], strict=True):
                right, at_b = left if block_b == block_a else load(block_b), first[block_b]
                names[at_b : at_b + len(right[1])] = right[1]
                rows_a, rows_b = np.flatnonzero(left[3] >> cell_b & 1), np.flatnonzero(right[3] >> cell_a & 1)
                y = right[0][rows_b].T
                for k in range(0, len(rows_a), TILE):
                    part = rows_a[k : k + TILE]
                    i, j = np.nonzero(left[0][part] @ y >= threshold)
                    i, j = part[i], rows_b[j]
                    if block_b == block_a:  # each pair once, and none of a vector with itself
                        i, j = i[i < j], j[i < j]
                    if not len(i):
                        continue
                    np.add.at(links, at_a + i, right[2][j])
                    np.add.at(links, at_b + j, left[2][i])
                    u, v = root[at_a + i], root[at_b + j]
                    if (new := u != v).any():
                        root = local_roots(n, u[new], v[new])[root]
        out = pd.DataFrame({"rep": names.astype("U32").astype(object), "links": links, "root": names[root].astype("U32").astype(object)})
        return out[links > 0]

    keys = ["label", "dim", "side_a", "side_b"]
    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.select(*keys).distinct().count() // 4)
    found = c.stored(pairs.repartition(tasks, *keys).groupBy(*keys).applyInPandas(compare, "rep string, links long, root string"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = placed.select("rep", "copies", "least_id").join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    known = c.stored(known.withColumn("component", F.coalesce("component", "rep")), "classes")
    least = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    links = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    linked = rows.filter("fine").select("vec_id", rep.alias("rep")).join(known.join(least, "component"), "rep").select("vec_id", links, "component_id")
    alone = rows.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(c.table(spark, sf_dir, "embeddings")).withColumn("component_id", F.col("component_id").cast("long"))
