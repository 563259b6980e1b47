"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join. The links are written to the shared
folder after each round, which cuts the lineage; the rounds end when the links
no longer change. Nothing but a count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c


def _lowest(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _lowest(both).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _lowest(down)
    rest = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionAll(low.select("a", F.col("m").alias("b"))).filter("a <> b")


def connected(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of the links (a, b), whose nulls are ignored."""
    now = c.Stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        seen = now.df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] == 0 or (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
        then = c.Stored(_small_star(_large_star(now.df)).distinct(), "links")
        now.drop()
        now = then
    return now.df.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.df.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
