"""Blocks of vectors: written once, whatever the number of comparisons, and compared as all pairs are."""

import numpy as np

from tablewright.llm import embedding_join


def rows_of(spark, begun):
    """The most rows that a join or a generator has made in the executions since."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    runs, most = store.executionsList(), 0
    for k in range(runs.size()):
        if (run := runs.apply(k).executionId()) < begun:
            continue
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            for m in map(node.metrics().apply, range(node.metrics().size())):
                if m.name() == "number of output rows" and any(x in node.name() for x in ("Join", "Generate")) and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_vectors_are_not_dealt_to_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "BLOCK_ROWS", 20)
    monkeypatch.setattr(embedding_join, "PIVOT_ROWS", 100)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(500, 6))
    x = np.concatenate([base, base[:150] + rng.normal(scale=0.1, size=(150, 6)), base[:1] + rng.normal(scale=0.04, size=(150, 6)), base[:100]]).astype(np.float32)
    n = len(x)
    begun = spark._jsparkSession.sharedState().statusStore().executionsCount()
    frame = spark.createDataFrame([(k, 0, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, label int, embedding array<float>")
    got = {r["vec_id"]: r for r in embedding_join.link(frame).collect()}
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.98
    np.fill_diagonal(hit, False)
    group = np.arange(n)
    for _ in range(n):
        group = np.minimum(group, np.where(hit, group[None, :], n).min(1))
    assert [(got[k]["n_links"], got[k]["component_id"]) for k in range(n)] == list(zip(hit.sum(1).tolist(), group.tolist(), strict=True)) and hit.sum() > 20_000
    assert rows_of(spark, begun) <= 5 * n  # no row for each vector and block that it meets
