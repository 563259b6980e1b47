"""The prefix trie against plain dictionaries."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import prefix_trie, scans

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(sequences):
    """Of conversations as tuples of (role, text): the rows of the trie."""
    members, ends = defaultdict(list), defaultdict(list)
    for k, s in sequences.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(k)
        ends[s].append(k)
    children, leaves, saved = Counter(s[:-1] for s in members if s), Counter(), Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in children
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1].encode()) if s else 0
    digest = lambda s: hashlib.sha256(",".join(map(str, sorted(ends.get(s, [])))).encode()).hexdigest()
    return Counter((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s], digest(s)) for s, m in members.items())


def ordered(rows):
    out = defaultdict(list)
    for k, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out[k].append((role or "", text or ""))
    return {k: tuple(v) for k, v in out.items()}


def rebuilt(rows):
    own = ordered(rows)
    h = {k: zlib.crc32(str(k).encode()) % 9 for k in own}
    return {k: own.get(k - (k % 5 if k >= 0 else -(-k % 5)), ())[: h[k]] + own[k][h[k] :] for k in own}


ODD = [(5, 0, "user", None), (5, 1, None, "x"), (6, None, "user", "first"), (6, 0, "user", "second"), (None, 0, "user", "nobody"), (8, 3, "", ""), (9, 0, "a", "ü" * 30000), (13, 0, "a", "b"), (-3, 0, "a", "b"), (-5, 0, "q", "r"), (0, 0, "z", "z")]
ODD += [(20, t, "u", "same") for t in range(700)] + [(21, t, "u", "same") for t in range(700)] + [(22, t, "u", "same") for t in range(699)] + [(23, t, "u", f"own {t}") for t in range(900)]


@pytest.mark.parametrize("shards", [1, 4, 23])
def test_rebuilt_conversations(spark, sf_dir, shards):
    real = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        for rows in (real, ODD):
            table = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("mine"), "s1": F.lit(1), "kind": F.lit("k"), "pos": F.lit(2)})
            got = prefix_trie.trie(prefix_trie.rebuilt(table))
            assert Counter(tuple(r)[:8] for r in got.collect()) == brute(rebuilt(rows))
            where = {(r["position"], r["end_position"], r["n_nodes"]) for r in got.collect()}
            assert {a for a, _, _ in where} == set(range(1, len(where) + 1)) and all(b - a + 1 == n for a, b, n in where)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_conversations_as_they_are(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):  # deep and crooked: each goes along an earlier one for a while
        n = int(rng.integers(1, 12))
        base = [r for r in rows if r[0] == k - int(rng.integers(1, 4))][: int(rng.integers(0, 12))]
        rows += [(k, t, r[2], r[3]) for t, r in enumerate(base)] + [(k, len(base) + t, "u", f"{rng.integers(0, 3)}") for t in range(n)]
    rows += [(1000 + k, t, "u", "long") for k in range(300) for t in range(1 + k % 3)]  # many equal ones
    rows += [(100 * k - 50000, 0, "u", "far") for k in range(400)]  # keys of many blocks, some below zero
    got = prefix_trie.conversations(spark.createDataFrame(rows, SCHEMA))
    assert Counter(tuple(r)[:8] for r in got.collect()) == brute(ordered(rows))


def test_a_chain_of_branches(spark):
    rows = [(k, t, "u", f"{t}") for k in range(70) for t in range(k)] + [(k, k, "u", f"off {k}") for k in range(70)]
    got = prefix_trie.conversations(spark.createDataFrame(rows, SCHEMA))
    assert Counter(tuple(r)[:8] for r in got.collect()) == brute(ordered(rows))


def test_equal_turns_are_ordered_alike(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "b"), (1, 0, "u", "b"), (2, 0, "u", "b"), (2, 0, "u", "a"), (2, 0, "u", "b")]
    got = prefix_trie.conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4 and all(r["n_convs"] == 2 for r in got)


def test_empty(spark):
    assert prefix_trie.conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))).count() == 0


def test_sql(spark, sf_dir):
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want, got = db.sql(prefix_trie.sql()), prefix_trie.query(spark, sf_dir)
    assert want.columns == got.columns and Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def test_running_sums(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("at"), (F.col("id") % 5).alias("x"))
    got = sorted(scans.running(rows.withColumn("id", F.col("at")), ["at"], ["x"], "t").collect(), key=lambda r: r["id"])
    assert [r["run_x"] for r in got] == np.cumsum([r["x"] for r in got]).tolist()
