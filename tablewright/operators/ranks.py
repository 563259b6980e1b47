"""The values at given ranks of an ordered column, or of several columns in order, without sorting the table.

Ranges that hold a wanted rank are cut at sampled values and counted, in one pass for all of them, until a range is small or the rank falls on
a cut itself, as it does with ties. Cuts lie close around where the sample has the wanted ranks; if few rows lie there, their values are
counted in the same pass. A caller that knows where the values lie gives the first cuts itself. Cuts only save passes: what stands at a rank is
always found by counting. A value that many rows share is a cut sooner or later, so it is never gathered; far values cost nothing,
as cuts are values of rows and not equal steps. Each pass reads the rows and shuffles counts only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cuts of a range, and rows that a range may have at last.
CUTS, SMALL = 64, 5000
#: Sampled rows of a range for each cut, and the standard errors that a wanted rank may lie from where the sample has it.
SAMPLED, ERRORS = 128, 4


@dataclass(frozen=True)
class Found:
    """The value at a rank, the rows before that value, and the rows that have it."""

    value: object
    before: int
    same: int


@dataclass(frozen=True)
class Cuts:
    """Values in ascending order that part a range, and for each part, from the lowest to the highest, whether it has few rows (some SMALL, as far as is known), whose values are counted."""

    values: list = field(default_factory=list)
    few: list[bool] = field(default_factory=lambda: [False])


@dataclass
class _Range:
    group: object
    low: object | None  #: both ends are outside; None: open
    high: object | None
    before: int
    size: int
    ranks: list[int]


def _table(rows: DataFrame, ranges: list[tuple], more: str) -> DataFrame:
    group, value = rows.schema["g"].dataType, rows.schema["x"].dataType
    fields = [T.StructField("range", T.LongType()), T.StructField("rg", group), T.StructField("low", value), T.StructField("high", value), *T.StructType.fromDDL(more).fields]
    return F.broadcast(rows.sparkSession.createDataFrame(ranges, T.StructType(fields)).coalesce(1))


def merged(windows: list[tuple]) -> list[tuple]:
    """Windows (low, high) in ascending order; those that meet are one."""
    out: list[tuple] = []
    for low, high in sorted(windows):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def values_at(rows: DataFrame, wanted: dict[object, list[int]], sizes: dict[object, int], seed: int = 42, first: dict[object, Cuts] | None = None) -> dict[tuple[object, int], Found]:
    """For rows (g, x), and ranks from 1 to the size of each group g: what stands there in ascending order of x (never null itself).

    The groups are few, and so are the ranks. ``first`` has the first cuts of groups of which something is known before.
    """
    out: dict[tuple[object, int], Found] = {}
    open_ = [_Range(g, None, None, 0, sizes[g], sorted(set(ranks))) for g, ranks in wanted.items() if ranks]
    known = first or {}
    turn = 0
    while open_:
        cuts: list[Cuts | None] = [Cuts([], [True]) if r.size <= SMALL else known.get(r.group) for r in open_]
        sampled = iter(_sampled(rows, [r for r, c in zip(open_, cuts, strict=True) if c is None], seed + turn))
        open_ = _counted(rows, [(r, c or next(sampled)) for r, c in zip(open_, cuts, strict=True)], out)
        known = {}
        turn += 1
    return out


def _sampled(rows: DataFrame, ranges: list[_Range], seed: int) -> list[Cuts]:
    """Cuts of each range around where a sample has its wanted ranks."""
    if not ranges:
        return []
    table = _table(rows, [(k, r.group, r.low, r.high, min(1.0, SAMPLED * CUTS / r.size)) for k, r in enumerate(ranges)], "share double")
    inside = (F.col("low").isNull() | (F.col("x") > F.col("low"))) & (F.col("high").isNull() | (F.col("x") < F.col("high")))
    found = rows.join(table, F.col("g").eqNullSafe(F.col("rg")) & inside).filter(F.rand(seed) < F.col("share")).groupBy("range").agg(F.sort_array(F.collect_list("x")).alias("x")).collect()  # some SAMPLED * CUTS rows a range
    by = {r["range"]: r["x"] for r in found}
    return [_around(r, by.get(k, [])) for k, r in enumerate(ranges)]


def _around(r: _Range, sample: list) -> Cuts:
    """Cuts at sampled values that the wanted ranks lie between, and more of them between these if many rows lie there. Without a sample there are none, and the next turn takes another."""
    m, windows = len(sample), []
    for rank in r.ranks:
        share = (rank - r.before) / r.size
        far = ERRORS * math.sqrt(m * share * (1 - share)) + 1
        windows.append((math.floor(share * m - far), math.ceil(share * m + far)))
    values, few = [], [False]
    for low, high in merged(windows):
        short = (high - low) * r.size <= SMALL * m
        steps = 1 if short else min(CUTS, high - low)
        at = [i for i in (low + (high - low) * k // steps for k in range(steps + 1)) if 0 <= i < m]
        few[-1] |= short and low < 0
        values += [sample[i] for i in at]
        few += [short] * (len(at) - 1) + [short and high >= m] * bool(at)
    return Cuts(values, few)


def _counted(rows: DataFrame, ranges: list[tuple[_Range, Cuts]], out: dict) -> list[_Range]:
    """Count the rows between and at the cuts, and each value where there are few rows, in one pass; ranks that fall on a value are found, the others have a narrower range."""
    parts = []
    for k, (r, cuts) in enumerate(ranges):
        ends = [r.low, *cuts.values, r.high]
        parts += [(k, r.group, low, high, i, few) for i, (low, high, few) in enumerate(zip(ends[:-1], ends[1:], cuts.few, strict=True))]
    # A part has its lower end, which is counted apart. Ends that are open are null; ends of structs are never null themselves, so that nulls within them compare as Spark sorts them.
    inside = (F.col("low").isNull() | (F.col("x") >= F.col("low"))) & (F.col("high").isNull() | (F.col("x") < F.col("high")))
    on_end = F.coalesce(F.col("x") == F.col("low"), F.lit(False))
    counts = rows.join(_table(rows, parts, "part long, few boolean"), F.col("g").eqNullSafe(F.col("rg")) & inside).groupBy("range", "part", on_end.alias("on_end"), F.when(F.col("few") | on_end, F.col("x")).alias("x")).count()
    found = counts.groupBy("range", "part").agg(F.sort_array(F.collect_list(F.struct("x", "on_end", "count"))).alias("found")).collect()  # some SMALL values of a part at most
    by = {(r["range"], r["part"]): r["found"] for r in found}
    narrower = []
    for k, (r, cuts) in enumerate(ranges):
        before, ends = r.before, [r.low, *cuts.values, r.high]
        for i, few in enumerate(cuts.few):
            here = by.get((k, i), [])
            between = sum(f["count"] for f in here if not f["on_end"])
            for f in here:
                if (f["on_end"] and i) or (few and not f["on_end"]):  # the range's own lower end is counted already
                    out.update({(r.group, x): Found(f["x"], before, f["count"]) for x in r.ranks if before < x <= before + f["count"]})
                    before += f["count"]
            if not few:
                if ranks := [x for x in r.ranks if before < x <= before + between]:
                    narrower.append(_Range(r.group, ends[i], ends[i + 1], before, between, ranks))
                before += between
    return narrower


def value_at(df: DataFrame, by: list, rank: int, size: int, seed: int = 42, first: Cuts | None = None) -> Found:
    """What stands at a rank of a table in ascending order of columns (nulls first), as a row of these columns."""
    rows = df.select(F.lit(0).alias("g"), F.struct(*by).alias("x"))
    return values_at(rows, {0: [rank]}, {0: size}, seed, {0: first} if first else None)[0, rank]
