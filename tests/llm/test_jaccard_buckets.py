from tablewright.llm import jaccard_join as J


def test_only_sets_of_large_buckets_go_on(spark, monkeypatch):
    """The last level reads the paths of the sets in large buckets, not those of all sets."""
    seen, likely = [], J.c.likely
    monkeypatch.setattr(J.c, "likely", lambda rows, *rest: (seen.append(rows.count()), likely(rows, *rest))[1])
    monkeypatch.setattr(J, "BUCKET_BLOCK", 5)
    rows = [(n, [1], [0], [7], [1]) for n in range(10)] + [(n, [1000 + n], [0], [5000 + 10 * n + k for k in range(5)], [1000 + n] * 5) for n in range(10, 100)]
    sets = spark.createDataFrame(rows, "node long, path2 array<long>, parent2 array<long>, path3 array<long>, parent3 array<long>")
    assert sorted(map(tuple, J._final_buckets(sets).collect())) == [(7, 10, n) for n in range(10)]
    assert max(seen) <= 100
