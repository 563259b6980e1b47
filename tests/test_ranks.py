"""Values at ranks against sorting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators import dataset as D
from tablewright.operators import profile as P
from tablewright.operators import ranks


@pytest.fixture(autouse=True)
def small_ranges(monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", 40)
    monkeypatch.setattr(ranks, "CUTS", 6)


def tables():
    rng = np.random.default_rng(11)
    return {
        "tails": np.concatenate([rng.pareto(0.3, 1500), [1e300, -1e300, 0.0]]),
        "ties": np.concatenate([np.full(900, 3.0), rng.integers(0, 5, 300), rng.normal(size=200)]),
        "constant": np.full(500, 7.0),
        "few": np.array([2.0, 1.0]),
        "one": np.array([5.0]),
    }


def test_all_groups_at_once(spark):
    data = tables()
    rows = spark.createDataFrame([(g, float(x)) for g, v in data.items() for x in v], "g string, x double").repartition(5)
    wanted = {g: [1, len(v), max(1, len(v) // 2), max(1, len(v) // 3), max(1, len(v) - 1)] for g, v in data.items()}
    got = ranks.values_at(rows, wanted, {g: len(v) for g, v in data.items()})
    for g, v in data.items():
        ordered = np.sort(v)
        for r in wanted[g]:
            x = ordered[r - 1]
            assert got[g, r] == ranks.Found(x, int((v < x).sum()), int((v == x).sum()))


def test_columns_in_order_with_nulls(spark):
    rng = np.random.default_rng(3)
    rows = [(None if a < 2 else int(a), None if b == 0 else "x" * int(b)) for a, b in rng.integers(0, 9, (700, 2))] + [(None, None)] * 300
    df = spark.createDataFrame(rows, "a int, b string")
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for rank in (1, 250, 301, 500, 640, 1000):
        found = ranks.value_at(df, ["a", "b"], rank, 1000)
        assert tuple(found.value) == ordered[rank - 1] and (found.before, found.same) == (ordered.index(ordered[rank - 1]), ordered.count(ordered[rank - 1]))


def test_quantiles_of_heavy_tails(spark):
    for values in tables().values():
        got = P.describe(spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 9, "v double"), ["v"]).first()
        assert (got["q1"], got["median"], got["q3"]) == pytest.approx(tuple(np.quantile(values, [0.25, 0.5, 0.75]))) and got["n"] == len(values)


def test_samples_with_a_hot_key(spark):
    rows = [(7, "same")] * 600 + [(7, f"own {k}") for k in range(200)] + [(None, "none")] * 150 + [(k, "x") for k in range(250)]
    df = spark.createDataFrame(rows, "key int, v string").repartition(6)
    for n in (1, 130, 400, 777, 1199, 1200, 5000):
        flagged = D.first_by_hash(df, "key", n, 42, "f").collect()
        assert sum(r["f"] for r in flagged) == min(n, 1200) and sorted(map(str, ((r["key"], r["v"]) for r in flagged))) == sorted(map(str, rows))
    assert {(r["key"], r["v"]) for r in D.first_by_hash(df, "key", 130, 42, "f").filter("f").collect()} == {(r["key"], r["v"]) for r in D.first_by_hash(df.repartition(2), "key", 130, 42, "f").filter("f").collect()}


def test_time_splits(spark):
    rows = [(k, min(k, 300) if k % 7 else None) for k in range(1000)]
    df = spark.createDataFrame(rows, "k int, t int")
    got = {r["k"]: r["is_test"] for r in D.split_by_time(df, "t", "k", "0.2").collect()}
    timed = sorted((t, k) for k, t in rows if t is not None)
    late = {k for _, k in timed[len(timed) - math.ceil(0.2 * len(timed)) :]}
    assert got == {k: k in late for k in range(1000)}


def test_no_sort_over_the_table(spark, monkeypatch):
    """No plan limits or sorts more than a bounded range."""
    df = spark.range(5000).withColumn("t", F.col("id") % 100)
    plan = D.split_by_time(df, "t", "id")._jdf.queryExecution().executedPlan().toString() + D.split_train_test(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan and "Sort" not in plan and "Window" not in plan


def test_histograms(spark):
    bins = lambda values: {r["bin"]: r["n"] for r in P.histogram(spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", T.DoubleType())])), "v").collect()}
    assert bins([0.0, 10.0, None, None, None, float("nan")]) == {0: 1, 49: 1}
    assert bins([3.0, 3.0, None]) == {0: 2} and bins([None]) == {} and bins([]) == {}
