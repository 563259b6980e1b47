"""N-gram Jaccard join by chosen paths: near-duplicate texts on five-word shingles.

A text is the set of its shingles (runs of five words, lower-case A-Z; fewer
words are one shingle). Texts with equal sets are one class. For each of several
independent runs a tree of paths starts at the root; at each level a set follows
the shared tokens that a hash of path and token samples, about ``BRANCH`` of
them, so that similar sets keep meeting and others part. At the second level
small buckets are final; larger ones are split again, down to ``DEPTH``. The number of
runs follows from the target recall by the branching process.

In a final bucket all members are compared by min-hash sketches, and those that
may be similar go into one candidate component. Up to here a 64-bit hash stands
for a set: others meet both of two sets that share it, and the exact step tells them apart. A component's sets then meet
once, in blocks, and the exact Jaccard similarity of all its pairs decides.
Blocks give numbers of links and spanning forests, never lists of pairs, so a
large group's result is small; its members are written once for each block that they meet. Cutting buckets and components into
blocks keeps every task bounded without dropping a pair.

Defined cases: a text without words (or null) links with nothing; a null key is
carried but, where a class has other keys, never names it; repeated rows are
members of one class; rows that share a key but not the text are joined as the
texts they are; very long texts are compared whole; a similarity that is the threshold
links, and of equal keys of a group any row is as good; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .components import connected
from .links import local_roots

SHINGLE = 5
BRANCH = 1.25
#: First level with final buckets, and the last level.
START, DEPTH = 2, 3
#: Members of a block of a bucket, and of a bucket that is final before the last level; sets of a block of a component.
BUCKET_BLOCK, COMPONENT_BLOCK = 400, 200
#: Values of a sketch; candidates are those estimated at most this far below the threshold (four standard deviations).
SKETCH, SLACK = 64, 0.2
RECALL = 0.999
#: Rows of a task's group, about.
GROUP_ROWS = 4000


def runs_needed(threshold: float, recall: float = RECALL, levels: int = DEPTH) -> int:
    """Two sets at the threshold share at least BRANCH * threshold paths a level on average; they meet unless the process dies out."""
    dead = 0.0
    for _ in range(levels):
        dead = math.exp(-BRANCH * threshold * (1 - dead))
    return math.ceil(math.log(1 - recall) / math.log(dead))


def _mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_WEIGHTS = _mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ROOTS = _mix(np.arange(1, 1000, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_SEEDS = _mix(np.arange(2001, 2001 + SKETCH, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Shingler:
    """Sorted distinct 64-bit hashes of the shingles of a text."""

    def __init__(self, most: int = 200_000):
        self.words: dict[bytes, int] = {}
        self.most = most

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.array([known[w] for w in words], dtype=np.uint64)
        with np.errstate(over="ignore"):
            n = max(1, len(h) - SHINGLE + 1)
            out = np.zeros(n, np.uint64)
            for i in range(min(SHINGLE, len(h))):
                out += _mix(h[i : i + n] * _WEIGHTS[i] + np.uint64(i))
            return np.unique(_mix(out))


def paths(shingles: np.ndarray, runs: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(paths, their parents) of the levels START to DEPTH."""
    limit = np.uint64(min(BRANCH / len(shingles), 1.0) * (2**64 - 2**12))
    at, out = _ROOTS[:runs], []
    with np.errstate(over="ignore"):
        for level in range(1, DEPTH + 1):
            if len(at) * len(shingles) > 1 << 22:  # very long texts: a few paths at a time
                hits = [(np.full(len(k), i), k) for i, p in enumerate(at) for k in [np.flatnonzero(_mix(shingles ^ p) < limit)]]
                i, j = (np.concatenate(x) for x in zip(*hits, strict=True))
            else:
                i, j = np.nonzero(_mix(shingles[None, :] ^ at[:, None]) < limit)
            new = _mix(at[i] * np.uint64(0x9E3779B97F4A7C15) + shingles[j])
            if level >= START:
                out.append((new, at[i]))
            at = new
            if not len(at):
                out += [(at, at)] * (DEPTH - max(level, START - 1))
                break
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The least hash of the set under each of SKETCH functions, cut to 8 bits: chance agreement adds candidates and loses none."""
    out = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), 4096):
            out = np.minimum(out, _mix(shingles[None, k : k + 4096] ^ _SEEDS[:, None]).min(1))
    return (out >> np.uint64(32)).astype(np.uint8)


def _signatures(texts: DataFrame, runs: int) -> DataFrame:
    """doc_id, sid (a 128-bit hash of the set; null without words), paths and parents by level, sketch."""
    levels = range(START, DEPTH + 1)
    lists = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for part in c.slices(batches):
            cols: list[list] = [[] for _ in range(2 + 2 * len(levels))]
            for t in part.column("text").to_pylist():
                s = shingler(t)
                if not len(s):
                    for col in cols:
                        col.append(None)
                    continue
                cols[0].append(xxhash.xxh128_digest(s.tobytes()))
                cols[1].append(sketch(s).tobytes())
                for k, (new, parent) in enumerate(paths(s, runs)):
                    cols[2 + 2 * k].append(new.view(np.int64))
                    cols[3 + 2 * k].append(parent.view(np.int64))
            kinds = [pa.binary(), pa.binary()] + [lists] * (2 * len(levels))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], names=["doc_id", "sid", "sketch", *[f"{n}{k}" for k in levels for n in ("path", "parent")]])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, sid binary, sketch binary, " + ", ".join(f"path{k} array<long>, parent{k} array<long>" for k in levels))


def _segments(values: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(values[1:] != values[:-1]) + 1
    return zip([0, *edges.tolist()], [*edges.tolist(), len(values)], strict=True)


def _final_buckets(sets: DataFrame) -> DataFrame:
    """bucket, n, node of all buckets with two sets or more that need no further split."""
    out, split = [], None
    for level in range(START, DEPTH + 1):
        if split is not None:  # only sets of a large bucket have paths that go on
            large = split.select("node").distinct()
            sets = c.likely(sets, "node", large, "node").join(large, "node", "left_semi")
        each = sets.select("node", F.explode(F.arrays_zip(f"path{level}", f"parent{level}")).alias("x")).select("node", F.col(f"x.path{level}").alias("bucket"), F.col(f"x.parent{level}").alias("parent"))
        if split is not None:
            parents = split.select(F.col("bucket").alias("parent")).distinct()
            each = each.join(parents, "parent", "left_semi")
        # Most buckets have one set only; they are told by their least and greatest node and go before anything is shuffled by set.
        mixed = c.stored(each.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("bucket"), "mixed")
        some = c.likely(each, "bucket", mixed, "bucket").join(mixed, "bucket", "left_semi").select("node", "bucket").distinct()
        some = c.stored(some, "some")
        shared = some.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
        rows = c.stored(some.join(shared, "bucket").select("bucket", "n", "node"), "buckets")
        split = rows.filter(F.col("n") > BUCKET_BLOCK)
        if level == DEPTH or split.isEmpty():
            out.append(rows)
            break
        out.append(rows.filter(F.col("n") <= BUCKET_BLOCK))
    final = out[0]
    for more in out[1:]:
        final = final.unionByName(more)
    return final


def _dealt(rows: DataFrame, group: list[str], size: str, block: int, ident: str) -> DataFrame:
    """Add i and j (the two blocks that meet) and b (the row's own), so that every pair of rows of a group meets once, in bounded blocks."""
    nb = F.ceil(F.col(size) / block).cast("int")
    own = rows.withColumn("nb", nb).withColumn("b", F.pmod(F.xxhash64(ident), F.col("nb")).cast("int"))
    at = F.expr("transform(sequence(0, nb - 1), k -> named_struct('i', least(b, k), 'j', greatest(b, k)))")
    return own.withColumn("at", F.explode(at)).select(*group, "at.i", "at.j", *[n for n in own.columns if n not in (*group, "nb")])


def _tasks(rows: DataFrame, columns: list[str], count: int, rows_of_group: int = GROUP_ROWS) -> DataFrame:
    """Groups of whole blocks, about ``rows_of_group`` rows each."""
    return rows.withColumn("task", F.pmod(F.xxhash64(*columns), F.lit(max(1, -(-count // rows_of_group)))).cast("int"))


def _candidates(final: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links a - b between the nodes of sets that their sketches do not rule out.

    A block that meets itself gives a spanning forest; two blocks that meet give
    only what connects the trees of one with those of the other, so that a large
    group of near copies gives about one link a member.
    """
    dealt = c.stored(_dealt(final, ["bucket"], "n", BUCKET_BLOCK, "node").drop("n"), "dealt")
    least = math.ceil((threshold - SLACK) * SKETCH)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "i", "j", "node"], kind="stable")
        nodes, side = pdf["node"].to_numpy(), pdf["b"].to_numpy()
        marks = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), SKETCH)
        block = pd.factorize(pd.MultiIndex.from_frame(pdf[["bucket", "i", "j"]]))[0]
        edges = list(_segments(block))
        out: list[np.ndarray] = []
        two = np.array([s for s, e in edges if e - s == 2], dtype=np.int64)
        if len(two):
            ok = two[(marks[two] == marks[two + 1]).sum(1) >= least]
            out.append(np.stack([ok, ok + 1], 1))
        for s, e in edges:
            if e - s <= 2:
                continue
            m = marks[s:e]
            alike = np.zeros((e - s, e - s), np.uint8)
            for k in range(SKETCH):
                alike += m[:, None, k] == m[None, :, k]
            a, z = np.nonzero(np.triu(alike >= least, 1))
            root = local_roots(e - s, a, z)
            own = root != np.arange(e - s)
            here = side[s:e]
            if here.min() != here.max():  # each block's own links come from where it meets itself
                same = here[a] == here[z]
                own &= local_roots(e - s, a[same], z[same]) == np.arange(e - s)
            own = np.flatnonzero(own)
            out.append(np.stack([root[own], own], 1) + s)
        at = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
        return pd.DataFrame({"a": nodes[at[:, 0]], "b": nodes[at[:, 1]]}).drop_duplicates()

    with_sketch = dealt.join(sets.select("node", "sketch"), "node")
    return _tasks(with_sketch, ["bucket", "i", "j"], dealt.count()).groupBy("task").applyInPandas(compare, "a long, b long").distinct()


def _similar(x: list[np.ndarray], y: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of two lists of sorted sets have at least the Jaccard similarity; exact, over columns of bounded width."""
    flat = np.concatenate([*x, *y])
    which = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    order = np.argsort(flat, kind="stable")
    values, which = flat[order], which[order]
    column = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]]))
    width = np.bincount(column)
    column, which = column[width[column] > 1], which[width[column] > 1]  # tokens of one set only don't count
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    both = np.zeros((len(x), len(y)))
    step = max(256, (1 << 22) // (len(x) + len(y)))
    for at in range(0, int(column.max(initial=-1)) + 1, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        m = np.zeros((len(x) + len(y), step), np.float32)
        m[which[lo:hi], column[lo:hi] - at] = 1
        both += m[: len(x)] @ m[len(x) :].T
    sizes = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
    return both >= threshold * (sizes - both) - 1e-9


def join(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, component_id, kept.

    class_id is the least key with the same shingles, n_links the number of
    other documents at or above the threshold, component_id the least key
    reachable over links, and kept marks the document whose key that is.
    """
    texts = c.id_texts(docs, key, text)
    sig = c.stored(_signatures(texts, runs_needed(threshold, recall)), "signatures")
    classes = sig.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    sets = sig.filter("sid is not null").select("sid", F.xxhash64("sid").alias("node"), "sketch", *[f"{n}{k}" for k in range(START, DEPTH + 1) for n in ("path", "parent")])
    one = c.stored(sets.select("sid", "node", "sketch").dropDuplicates(["sid"]), "sketches")
    near = c.stored(connected(_candidates(_final_buckets(sets), one, threshold)), "components")

    # The shingles of the candidates only, from one document of each class.
    sizes = near.groupBy("component").agg(F.count("*").alias("n"))
    placed = c.stored(near.join(sizes, "component").join(classes, F.col("node") == F.xxhash64("sid")).select("component", "n", "sid", "copies", "class_id"), "members")
    keys = placed.select("class_id").distinct()
    again = c.likely(texts, "doc_id", keys, "class_id").join(keys, F.col("doc_id") == F.col("class_id"), "left_semi").unionAll(texts.filter("doc_id is null"))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for part in c.slices(batches):
            got = [shingler(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh128_digest(s.tobytes()) for s in got], pa.binary()), pa.array([s.tobytes() for s in got], pa.binary())], names=["sid", "shingles"])

    shingles = again.select("text").mapInArrow(shingle, "sid binary, shingles binary").dropDuplicates(["sid"])
    dealt = _dealt(placed.drop("class_id"), ["component"], "n", COMPONENT_BLOCK, "sid").drop("n")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["component", "i", "j", "sid"], kind="stable")
        sids, copies, b = pdf["sid"].to_numpy(), pdf["copies"].to_numpy(), pdf["b"].to_numpy()
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        found = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        block = pd.factorize(pd.MultiIndex.from_frame(pdf[["component", "i", "j"]]))[0]
        links, root = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        for s, e in _segments(block):
            left, right = s + np.flatnonzero(b[s:e] == i[s]), s + np.flatnonzero(b[s:e] == j[s])
            hit = _similar([found[k] for k in left], [found[k] for k in right], threshold)
            if i[s] == j[s]:
                np.fill_diagonal(hit, False)
                links[left] += hit @ copies[right]
            else:
                links[left] += hit @ copies[right]
                links[right] += copies[left] @ hit
            x, y = np.nonzero(hit)
            root[s:e] = s + local_roots(e - s, left[x] - s, right[y] - s)
        out = pd.DataFrame({"sid": sids, "links": links, "root": sids[root]})
        return out[out["links"] > 0]

    tasks = _tasks(dealt.join(shingles, "sid"), ["component", "i", "j"], dealt.count(), rows_of_group=1000)
    found = c.stored(tasks.groupBy("task").applyInPandas(compare, "sid binary, links long, root binary"), "links")
    linked = connected(found.select(F.col("sid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "sid")
    least = linked.join(classes, "sid").groupBy("component").agg(F.min("class_id").alias("component_id"))
    own = classes.join(found.groupBy("sid").agg(F.sum("links").alias("links")), "sid", "left").join(linked.join(least, "component").select("sid", "component_id"), "sid", "left")
    out = sig.select("doc_id", "sid").join(own, "sid", "left")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "class_id", "doc_id").alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(c.documents(spark, sf_dir).select("doc_id", "text"))
