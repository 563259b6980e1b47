"""Prefix sums over rows in a total order, without bringing the rows together.

The rows are dealt to ranges of the order, sorted there, and summed within each range by the task that holds it; the sums of the ranges
(one row a range) give what comes before each. The result is written to the shared folder, so that a row keeps its range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

#: Odd, so that its powers modulo 2**64 lose nothing.
BASE = np.uint64(0x9E3779B97F4A7C15)


def dealt(rows: DataFrame, by: list) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *by).sortWithinPartitions(*by)


def _extended(rows: DataFrame, names: list[str]) -> T.StructType:
    return T.StructType([*rows.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])


def _with(part: pa.RecordBatch, more: dict[str, np.ndarray]) -> pa.RecordBatch:
    keep = [n for n in part.schema.names if n not in more]
    return pa.RecordBatch.from_arrays([*[part.column(n) for n in keep], *[pa.array(v) for v in more.values()]], names=[*keep, *more])


def _power(base: np.uint64, of: np.ndarray) -> np.ndarray:
    return np.power(np.full(len(of), base, np.uint64), of.astype(np.uint64))


# --- running totals ------------------------------------------------------------------------------


def running(rows: DataFrame, by: list[str], sums: list[str], label: str) -> DataFrame:
    """The rows (whole numbers in ``sums``, never null) with ``run_x`` for each x of them: its total over all rows up to and with this one. The columns of ``by`` go."""
    keep = [n for n in rows.columns if n not in by or n in sums]
    ordered = dealt(rows, by).select(*keep)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for part in batches:
            more = {"shard": np.full(part.num_rows, shard, np.int64)}
            for n in sums:
                more[f"run_{n}"] = before[n] + np.cumsum(part.column(n).to_numpy(zero_copy_only=False))
                before[n] = int(more[f"run_{n}"][-1]) if part.num_rows else before[n]
            yield _with(part, more)

    names = ["shard", *[f"run_{n}" for n in sums]]
    done = c.stored(ordered.mapInArrow(local, _extended(ordered, names)), label)
    totals = done.groupBy("shard").agg(*[F.max(f"run_{n}").alias(n) for n in sums]).orderBy("shard").collect()  # one row a range; sums never fall
    offsets, at = [], dict.fromkeys(sums, 0)
    for r in totals:
        offsets.append((r["shard"], *[at[n] for n in sums]))
        at = {n: at[n] + r[n] for n in sums}
    table = rows.sparkSession.createDataFrame(offsets, "shard long, " + ", ".join(f"before_{n} long" for n in sums))
    joined = done.join(F.broadcast(table), "shard")
    return joined.withColumns({f"run_{n}": F.col(f"run_{n}") + F.col(f"before_{n}") for n in sums}).drop("shard", *[f"before_{n}" for n in sums])


# --- prefixes of sequences -------------------------------------------------------------------------


def prefixes(rows: DataFrame, key: str, by: list[str], hashes: list[str], label: str) -> DataFrame:
    """The rows with their place (``pos``, from 1) among those of their key (a long, never null) in the order of ``by``.

    For each of ``hashes`` (a long) x, ``x`` becomes a fingerprint of the sequence of x up to this row, and ``before_x`` that of the sequence before
    it: the polynomial sum of x times a power of an odd number by place, modulo 2**64, so that ranges can be summed apart. The columns of ``by`` go.
    """
    keep = [n for n in rows.columns if n not in by or n in hashes]
    ordered = dealt(rows, [key, *by]).select(*keep)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen, open_, count, sums = TaskContext.get().partitionId(), 0, None, 0, dict.fromkeys(hashes, np.uint64(0))
        for part in batches:
            n = part.num_rows
            if not n:
                continue
            k = part.column(key).to_numpy(zero_copy_only=False)
            new = np.concatenate([[open_ is None or k[0] != open_], k[1:] != k[:-1]])
            starts = np.flatnonzero(new)
            run = np.cumsum(new)  # 0: goes on from the batch before
            pos = np.arange(n) - np.concatenate([[-count], starts])[run] + 1
            weight = _power(BASE, pos)
            more = {"shard": np.full(n, shard, np.int64), "row": np.arange(seen, seen + n), "pos": pos}
            for x in hashes:
                term = part.column(x).to_numpy(zero_copy_only=False).view(np.uint64) * weight
                total = np.cumsum(term, dtype=np.uint64)
                zero = np.concatenate([[np.uint64(0) - sums[x]], (total - term)[starts]]).astype(np.uint64)
                total = total - zero[run]
                more[x], more[f"before_{x}"] = total.view(np.int64), (total - term).view(np.int64)
                sums[x] = total[-1]
            seen, open_, count = seen + n, k[-1], int(pos[-1])
            yield _with(part, more)

    out = _extended(ordered.drop(*hashes), ["shard", "row", "pos", *[y for x in hashes for y in (x, f"before_{x}")]])
    done = c.stored(ordered.mapInArrow(_quiet(local), out), label)
    ends = done.groupBy("shard").agg(F.min_by(key, "row").alias("first"), F.max_by(F.struct(key, "row", "pos", *hashes), "row").alias("end")).orderBy("shard").collect()  # one row a range
    return _carried(done, key, hashes, ends)


def _quiet(run):
    def quiet(batches):
        with np.errstate(over="ignore"):
            yield from run(batches)

    return quiet


def _carried(done: DataFrame, key: str, hashes: list[str], ends: list) -> DataFrame:
    """Add what each range's first key has in earlier ranges."""
    size = max([r["shard"] for r in ends], default=-1) + 1
    has, first, count = np.zeros(size, bool), np.zeros(size, np.int64), np.zeros(size, np.int64)
    carry = {x: np.zeros(size, np.uint64) for x in hashes}
    before = None  #: key, rows and fingerprints that are open at the end of the range before
    with np.errstate(over="ignore"):
        for r in ends:
            s, end = r["shard"], r["end"]
            if before is not None and before[0] == r["first"]:
                has[s], first[s], count[s] = True, r["first"], before[1]
                for x in hashes:
                    carry[x][s] = before[2][x]
            on = has[s] and end[key] == r["first"]
            shift = np.power(BASE, np.uint64(count[s])) if on else np.uint64(1)
            at = {x: np.uint64(end[x] % 2**64) * shift + (carry[x][s] if on else np.uint64(0)) for x in hashes}
            before = (end[key], end["pos"] + (int(count[s]) if on else 0), at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            shard, k = (part.column(x).to_numpy(zero_copy_only=False) for x in ("shard", key))
            on = has[shard] & (first[shard] == k)
            shift = np.where(on, _power(BASE, count[shard]), np.uint64(1))
            more = {"pos": part.column("pos").to_numpy(zero_copy_only=False) + np.where(on, count[shard], 0)}
            for x in hashes:
                for y in (x, f"before_{x}"):
                    more[y] = (part.column(y).to_numpy(zero_copy_only=False).view(np.uint64) * shift + np.where(on, carry[x][shard], np.uint64(0))).view(np.int64)
            yield _with(part.drop_columns(["shard", "row"]), more)

    sums = ["pos", *[y for x in hashes for y in (x, f"before_{x}")]]
    fields = [f for f in done.schema.fields if f.name not in ("shard", "row", *sums)]
    return done.mapInArrow(_quiet(run), T.StructType([*fields, *[T.StructField(n, T.LongType()) for n in sums]]))
