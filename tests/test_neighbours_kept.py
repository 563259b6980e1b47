"""Points of the nearest-neighbour join are placed once."""

from pyspark.sql import functions as F

from tablewright.operators.neighbours import nearest_neighbour


def test_placed_points_are_read_from_memory(spark):
    rows = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * F.col("id")).cast("double").alias("x"))
    near = nearest_neighbour(rows, rows, "k", ["x"], "x")
    assert near._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") >= 3
    assert {r["query_key"]: r["neighbour_key"] for r in near.collect()} == {0: 1} | {k: k - 1 for k in range(1, 60)}
    spark.catalog.clearCache()
