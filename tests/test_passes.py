"""How often operators read their input, and that odd rows stay as they were."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions import metrics as M
from tablewright.operators import dataset as D
from tablewright.operators import profile as P
from tablewright.operators import ranks
from tablewright.operators.time_folds import rolling_origin


def read_counted(df):
    """The table, and an accumulator that has the rows read of it."""
    read = df.sparkSession.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            read.add(len(b))
            yield b

    return df.mapInPandas(through, df.schema), read


def test_describe_reads_twice(spark):
    rng = np.random.default_rng(5)
    values = [(float(a), float(b)) for a, b in zip(rng.pareto(0.5, 20000), rng.integers(0, 9, 20000), strict=True)]
    df, read = read_counted(spark.createDataFrame(values, "a double, b double").repartition(5))
    got = {r["column"]: r for r in P.describe(df, ["a", "b"]).collect()}
    assert read.value <= 2 * len(values)
    for i, c in enumerate("ab"):
        assert [got[c][q] for q in ("q1", "median", "q3")] == pytest.approx(list(np.quantile([v[i] for v in values], [0.25, 0.5, 0.75])), rel=1e-12)


@pytest.mark.parametrize("small", [5000, 30])
def test_describe_of_odd_rows(spark, monkeypatch, small):
    monkeypatch.setattr(ranks, "SMALL", small)
    monkeypatch.setattr(P, "SMALL", small)
    odd = [-math.inf] * 3 + [-0.0] * 200 + [0.0] * 200 + [7.0] * 300 + [float(k) for k in range(500)] + [math.inf] * 2
    rows = [(x, None, float("nan")) for x in odd] + [(None, None, None)] * 50
    got = {r["column"]: r for r in P.describe(spark.createDataFrame(rows, "x double, none double, nan double").repartition(4), ["x", "none", "nan"]).collect()}
    x = sorted(odd)
    at = lambda q: (x[math.floor(q * (len(x) - 1))] + x[math.ceil(q * (len(x) - 1))]) / 2  # noqa: E731  between equal values here
    assert (got["x"]["n"], got["x"]["low"], got["x"]["high"]) == (len(odd), -math.inf, math.inf)
    assert [got["x"][q] for q in ("q1", "median", "q3")] == [at(0.25), at(0.5), at(0.75)] and math.copysign(1, got["x"]["q1"]) == 1
    assert (got["none"]["n"], got["none"]["mean"], got["none"]["median"]) == (0, None, None)
    assert got["nan"]["n"] == len(odd) and all(math.isnan(got["nan"][q]) for q in ("q1", "median", "q3"))
    assert P.describe(spark.createDataFrame([], "x double"), ["x"]).collect() == []


def test_wrong_first_cuts_only_cost_passes(spark):
    values = [float(k % 3000) for k in range(9000)]
    rows = spark.createDataFrame([("g", v) for v in values], "g string, x double")
    for cuts in (ranks.Cuts([-5.0, -1.0], [False, True, False]), ranks.Cuts([10.0, 10.0, 9000.0], [True, True, False, True]), ranks.Cuts()):
        got = ranks.values_at(rows, {"g": [1, 33, 4500, 9000]}, {"g": 9000}, first={"g": cuts})
        assert got == {("g", r): ranks.Found(float((r - 1) // 3), (r - 1) // 3 * 3, 3) for r in (1, 33, 4500, 9000)}


@pytest.mark.parametrize("n", [6000, 60000])
def test_splits_read_as_often_at_any_size(spark, n):
    df, read = read_counted(spark.range(n).repartition(4))
    assert sum(r["is_test"] for r in D.split_train_test(df, "id").collect()) == math.ceil(0.3 * n)
    assert read.value <= 3 * n  # the number of rows, the hash at the edge, the result


@pytest.mark.parametrize("n", [1, 2500, 5200, 7000, 11900, 11999])
def test_split_flags_the_least_hashes(spark, n):
    keys = [*range(6000), *[77] * 3000, *[None] * 2000, *[k % 50 for k in range(1000)]]
    df = spark.createDataFrame([(k, f"v{i % 7}") for i, k in enumerate(keys)], "key int, v string").repartition(4)
    flagged = Counter(r["key"] for r in D.first_by_hash(df, "key", n, 42, "f").collect() if r["f"])
    expected, left = {}, n
    for k, rows in sorted(Counter(keys).items(), key=lambda x: hashlib.md5(f"42|{chr(0) if x[0] is None else x[0]}".encode()).hexdigest()):
        expected[k] = min(left, rows)
        left -= expected[k]
    assert flagged == Counter({k: v for k, v in expected.items() if v})


def test_rolling_origin_reads_once(spark):
    rng = np.random.default_rng(9)
    rows = [(None if k % 97 == 0 else k, 500 if k % 5 == 0 else int(t), float(y)) for k, (t, y) in enumerate(zip(rng.integers(0, 1000, 9000), rng.normal(50, 9, 9000), strict=True))]
    rows += rows[:300] + [(k, None, 1.0) for k in range(40)]
    df, read = read_counted(spark.createDataFrame(rows, "k int, t int, y double").repartition(4))
    models = {"mean": lambda train: lambda test: test.crossJoin(F.broadcast(train.agg(F.avg("y").alias("prediction")))), "zero": lambda train: lambda test: test.withColumn("prediction", F.lit(0.0))}
    got = rolling_origin(df, "t", "k", models, (M.mae(),), "y").collect()
    assert read.value == len(rows)
    ordered = sorted((t, -1 if k is None else k, y) for k, t, y in rows if t is not None)
    ends = [ordered[len(ordered) * i // 4 - 1][:2] for i in (1, 2, 3)]
    fold = lambda r: sum(r[:2] > e for e in ends)
    for r, i in zip(got, (1, 2, 3), strict=True):
        train, test = [x for x in ordered if fold(x) < i], [x[2] for x in ordered if fold(x) == i]
        mean = np.mean([x[2] for x in train])
        assert (r["fold"], r["n_train"], r["n_test"], r["model"]) == (i, len(train), len(test), "mean") and r["MAE"] == pytest.approx(np.mean(np.abs(np.array(test) - mean)))


def test_what_the_caller_keeps_is_kept(spark):
    df = spark.range(40).selectExpr("id as k", "id as t", "id * 1.0D as y").persist()
    rolling_origin(df, "t", "k", {"zero": lambda train: lambda test: test.withColumn("prediction", F.lit(0.0))}, (M.mae(),), "y").collect()
    assert df.storageLevel.useMemory
    df.unpersist()


@pytest.mark.parametrize("inner", ["0.3", "1", "0"])
def test_a_known_edge_splits_alike(spark, inner):
    df = spark.createDataFrame([(k if k % 9 else None, k // 4 if k % 7 else None) for k in range(200)], "k int, t int")
    timed = sorted((r["t"], r["k"] is not None, r["k"] or 0) for r in df.collect() if r["t"] is not None)
    searched = D.split_by_time(df, "t", "k", inner).collect()
    if late := math.ceil(float(inner) * len(timed)):
        t, known, k = timed[len(timed) - late]
        assert Counter(D.split_by_time(df, "t", "k", inner, (t, k if known else None)).collect()) == Counter(searched)
    assert sum(r["is_test"] for r in searched) >= late
