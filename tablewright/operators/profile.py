"""Exploring a table: summaries, correlations, histograms, counts."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import SMALL, Cuts, merged, values_at

#: Approximate quantiles are at most this part of the rows away (1 / ACCURACY; Spark's default), and so many are taken around each exact one.
ACCURACY, NEAR = 10000, 9


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, std (sample), min, quartiles (exact, interpolated), max; no rows for an empty table. One pass has all but the exact quartiles, and about where these lie."""
    columns, shares = list(dict.fromkeys(columns)), {"q1": 0.25, "median": 0.5, "q3": 0.75}
    value = {c: F.col(c).cast("double") for c in columns}
    parts = [lambda x: F.count(x), lambda x: F.avg(x), lambda x: F.stddev_samp(x), lambda x: F.min(x), lambda x: F.max(x), lambda x: near(x, shares)]
    one = df.agg(F.count("*"), *[F.struct(*[f(x) for f in parts]) for x in value.values()]).first()
    found = {c: tuple(v) for c, v in zip(columns, one[1:], strict=True) if one[0]}
    stats = df.sparkSession.createDataFrame([(c, *v[:-1]) for c, v in found.items()], "column string, n long, mean double, std double, low double, high double").coalesce(1)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), x.alias("x")) for c, x in value.items()])).alias("v")).select("v.*")
    exact = quantiles(long.filter("x is not null"), shares, {c: v[0] for c, v in found.items() if v[0]}, {c: v[-1] for c, v in found.items()})
    return stats.join(F.broadcast(exact), "column", "left").select("column", "n", "mean", "std", "low", "q1", "median", "q3", "high")


def near(x: Column, shares: dict[str, float]) -> Column:
    """For each share in order, NEAR approximate quantiles in ascending order: the exact one lies between the first and the last."""
    return F.percentile_approx(x, [min(1.0, max(0.0, q + (4 * k / (NEAR - 1) - 2) / ACCURACY)) for q in shares.values() for k in range(NEAR)], ACCURACY)


def quantiles(rows: DataFrame, shares: dict[str, float], sizes: dict[str, int] | None = None, about: dict[str, list[float]] | None = None) -> DataFrame:
    """column and its exact, interpolated quantiles from rows (column, x), x never null; the values at their ranks are found by counting, see ``ranks``.

    ``sizes`` has the rows of each column, ``about`` what ``near`` says of it; both only save passes.
    """
    if sizes is None:
        sizes = {r["column"]: r["n"] for r in rows.groupBy("column").agg(F.count("*").alias("n")).collect()}  # one row a column
    ends = {(c, q): (math.floor(q * (n - 1)), math.ceil(q * (n - 1)), q * (n - 1)) for c, n in sizes.items() for q in shares.values()}
    wanted = {c: [rank + 1 for q in shares.values() for rank in ends[c, q][:2]] for c in sizes}
    first = {c: _cuts(about[c], n) for c, n in sizes.items()} if about else {}
    found = values_at(rows.select(F.col("column").alias("g"), "x"), wanted, sizes, first=first)
    out = []
    for c in sizes:
        values = []
        for q in shares.values():
            low, high, at = ends[c, q]
            a, b = found[c, low + 1].value, found[c, high + 1].value
            values.append(a if a == b else a + (b - a) * (at - low))
        out.append((c, *values))
    return rows.sparkSession.createDataFrame(out, "column string, " + ", ".join(f"{n} double" for n in shares)).coalesce(1)


def _cuts(about: list[float], n: int) -> Cuts:
    """First cuts at the ends of what lies near each share, and within it too if it has many rows. NaN, which Python has no order for, is left out."""
    groups = [[x for x in about[i : i + NEAR] if x == x] for i in range(0, len(about), NEAR)]
    few = 6 * n <= SMALL * ACCURACY  # four steps of 1 / ACCURACY, and each end may be one away
    values, parts = [], [False]
    for low, high in merged([(min(g), max(g)) for g in groups if g]):
        between = [] if few else sorted({x for g in groups for x in g if low < x < high})
        values += [low, *between, high]
        parts += [few] * (1 + len(between)) + [False]
    return Cuts(values, parts)


def null_profile(df: DataFrame) -> DataFrame:
    """column, non_null, nulls in one pass."""
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.count(c).alias("non_null"), F.count_if(F.col(c).isNull()).alias("nulls")).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[F.col(f"`{c}`") for c in df.columns])).alias("x")).select("x.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for all ordered pairs, the diagonal included, in one pass."""
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for i, a in enumerate(columns) for b in columns[i:]])
    cell = lambda a, b: f"`{a}|{b}`" if columns.index(a) <= columns.index(b) else f"`{b}|{a}`"
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(cell(a, b)).alias("r")) for a, b in product(columns, columns)])).alias("x")).select("x.*")


def strong_pairs(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of at least the strength, either sign, but for perfect ones."""
    return pairs.filter(((F.col("r") >= least) & (F.col("r") < 1)) | ((F.col("r") <= -least) & (F.col("r") > -1)))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """bin, n of equal-width bins between the extremes; the last is closed. Empty bins are left out, a constant column has bin 0 only, nulls and NaN have none."""
    x = F.col(column).cast("double")
    values = df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    edges = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # one row
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(F.lit(0))
    return values.crossJoin(F.broadcast(edges)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def scatter(df: DataFrame, x: str, y: str, by: str | None = None, most: int = 5000, seed: int = 42) -> DataFrame:
    """The points of a scatter plot: a sample of at most so many rows, which is what a plot can show."""
    columns = [x, y, *([by] if by else [])]
    n = df.count()
    return df.select(*columns) if n <= most else df.select(*columns).sample(min(1.0, 1.2 * most / n), seed).limit(most)
