"""Best-fit packing of token pieces into fixed sequences by the sum-of-squares rule.

A document is its ids and an end id. One longer than a sequence is cut into
pieces of full length, the first of which may be shorter. Full pieces fill a
sequence each. The others are dealt by a hash into groups of about
``GROUP_PIECES``; in a group, from the longest piece down, each goes where the
sum over residual gaps of the squared number of open bins with that gap becomes
smallest; a bin is opened only if the piece fits into none. A group's waste is a
few bins, whatever the input.

Defined cases: a null text counts as empty and is a piece of the end id alone;
null keys pass through; repeated rows are packed as often as they occur; very long texts are cut
whole; pieces of equal length go in no stated order; an
empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .encoding import encoder

#: Pieces that are packed together, about: a group is a bounded part of a task.
GROUP_PIECES = 20_000
#: Whole texts that an executor and its Python worker hold at a time, each.
BATCH_ROWS = 512


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of full size but the first."""
    first = n % size or size
    return [(0, min(first, n))] + [(at, size) for at in range(first, n, size)]


def pieces(docs: DataFrame, tokenizer: str, kind: str, end_id: int, size: int, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, uid (unique), and with ``with_ids`` the ids as little-endian uint32."""
    rows = c.id_texts(docs, key, text)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "uid"] + ["ids"] * with_ids
    types = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, uid = encoder(tokenizer, kind), TaskContext.get().partitionId() << 40
        for part in c.slices(batches):
            take, out = [], []
            for i, ids in enumerate(coder.encode(part.column("text").to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, (at, n) in enumerate(cut(len(ids), size)):
                    data = ids[at : at + n].tobytes()
                    take.append(i)
                    out.append((k, at, n, zlib.crc32(data), uid, data)[: len(names) - 1])
                    uid += 1
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(take, pa.int64())), *(pa.array(v, t) for v, t in zip(zip(*out, strict=True), types[1:]))], names=names)

    kind_of = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind_of}, piece int, start long, length long, ids_crc32 long, uid long" + ", ids binary" * with_ids)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, placed in the given order.

    Putting a piece of length s into a bin with gap h changes the sum of squares
    by 2 (n[h - s] - n[h]) + 2, and by 1 - 2 n[s] if it fills the bin.
    """
    n = np.zeros(size + 1, dtype=np.int64)
    open_: dict[int, list[int]] = defaultdict(list)
    bins, offsets, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    none = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        change = np.where(n[s:size] > 0, 2 * (n[: size - s] - n[s:size]) + 2, none)
        if s < size and n[s]:
            change[0] = 1 - 2 * n[s]
        k = int(change.argmin()) if s < size else 0
        if s < size and change[k] != none:
            gap = s + k
            b = open_[gap].pop()
            n[gap] -= 1
        else:
            gap, b, used = size, used, used + 1
        if gap > s:
            open_[gap - s].append(b)
            n[gap - s] += 1
        bins[i], offsets[i] = b, size - gap
    return bins, offsets


def pack(rows: DataFrame, size: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Append sequence_id and offset to pieces (see ``pieces``), which are read more than once: store them before."""
    partial = F.col("length") < size
    count = rows.agg(F.count_if(partial).alias("n")).first()["n"]
    groups = max(1, -(-count // group_pieces))
    names = [n for n in rows.columns]
    # Numbers of sequences: full pieces take their uid, groups take negative numbers.
    full = rows.filter(~partial).select(*names, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "uid"], ascending=[False, True], kind="stable")
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), size)
        group = int(pdf["grp"].iloc[0])
        return pdf.drop(columns="grp").assign(sequence_id=-1 - (bins * groups + group), offset=offsets)

    grouped = rows.filter(partial).withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    return full.unionByName(grouped.groupBy("grp").applyInPandas(place, full.schema))


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of every sequence, joined in the order of offsets; needs pieces with ids."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.unhex(F.lit("")), lambda a, x: F.concat(a, x)).alias("ids"), F.sum("length").alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str, size: int = 2048) -> DataFrame:
    docs = c.documents(spark, sf_dir).select("doc_id", "text")
    return packed_documents(docs, size)


def packed_documents(docs: DataFrame, size: int = 2048) -> DataFrame:
    rows = c.stored_in_batches(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), "spaces", end_id=0, size=size), "pieces", BATCH_ROWS)
    return pack(rows, size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
