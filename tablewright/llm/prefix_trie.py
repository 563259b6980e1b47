"""The trie of all prefixes of conversations, by preorder intervals.

A node is a distinct sequence of first turns, known by its depth and a 128-bit fingerprint of the sequence; the fingerprints of all prefixes
of a conversation are prefix sums over its turns (``scans.prefixes``). A node belongs to its smallest member, so the nodes of a conversation
that are its own are a path: a branch, which hangs on a node of a smaller conversation's branch. Nodes are ranked by their path of branches,
lexicographically: first the branch itself, downwards, then what hangs on it, from its deepest node up. So each subtree is an interval that
starts at its node. Running sums over that order count the nodes, leaves, saved bytes and ends of conversations. The subtree of a node ends at
the node where the last of its members ends: the running number of ends there is that before the node plus its members, so the end is found by
an equal join, and what a subtree holds is a difference of running sums.

Nothing is gathered by conversation, node or depth: sequences, however long, are summed by ranges of the order; the paths of branches are
doubled (as many joins as the logarithm of the most branches on a path); parents with many children, and conversations with many nodes, are split by
Spark's skew join, as both sides are written tables. The keys of the members that end at a node are first joined in blocks of CHUNK keys and
then streamed through one hash, as a hash of them all asks for.

Defined cases: turns with the same number go by a hash of role and text (null numbers first); null roles and texts are empty; rows with a null
key belong to no conversation; a conversation without turns is a member of the root only; very long texts and conversations are used
whole; equal conversations end at one node; an empty table has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from . import scans

#: Keys of members that are joined at once: those of an equal quotient by this.
CHUNK = 4096
NODE = ["depth", "s1", "s2"]
#: Kinds of rows: the root's, those of turns, and the end of a conversation. The prefix sums see a conversation's rows in this order.
ROOT, TURN, END = 0, 1, 3
HASHES = ["s1", "s2"]


def digests(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, two hashes of role and text, and the bytes of the text, of all rows with a key; texts are not needed any more."""
    role_, text_ = c.text_of(role), c.text_of(text)
    hashed = [F.xxhash64(F.lit(n), role_, text_).alias(f"s{n}") for n in (1, 2)]
    return turns.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv_id"), F.col(turn).alias("turn"), *hashed, F.octet_length(text_).cast("long").alias("bytes"))


def placed(turns: DataFrame) -> DataFrame:
    """``digests`` with ``pos``, the place of a turn in its conversation, from 1."""
    again = turns.withColumns({"h1": F.col("s1"), "h2": F.col("s2")})
    return scans.prefixes(again, "conv_id", ["turn", "h1", "h2"], [], "turns")


def with_ends(sequences: DataFrame, conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, kind, pos, s1, s2, bytes), to which each conversation (conv_id, distinct) gives the root's row and its end."""
    empty = [F.lit(0).cast("long").alias(n) for n in ("pos", "s1", "s2", "bytes")]
    marks = conversations.select("conv_id", F.explode(F.array(F.lit(ROOT), F.lit(END))).alias("kind"), *empty)
    return sequences.select(*marks.columns).unionAll(marks)


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of rows (conv_id, kind, pos, s1, s2, bytes), see ``with_ends``; equal kinds go by pos.

    A node is named by its smallest member (conv_id) and its depth: its sequence is the first ``depth`` turns of that conversation. Besides what
    the query returns: position (preorder, from 1), end_position (of the last node of its subtree), n_nodes (of the subtree).
    """
    known = scans.prefixes(rows.withColumn("end", F.col("kind") == END), "conv_id", ["kind", "pos"], HASHES, "prefixes")
    # The root's row is the first, so that a turn's depth is one less than its place; an end stands one after the last turn, whose fingerprint lies before it.
    turns = known.filter(~F.col("end")).withColumn("depth", F.col("pos") - 1)
    ends = known.filter("end").select((F.col("pos") - 2).alias("depth"), F.col("before_s1").alias("s1"), F.col("before_s2").alias("s2"), "conv_id")
    members = turns.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(n).alias(n) for n in ("before_s1", "before_s2", "bytes")])
    nodes = c.stored(members, "nodes")
    hashed = c.stored(_ends(ends), "ends")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("before_s1").alias("s1"), F.col("before_s2").alias("s2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("before_s1"), F.col("s2").alias("before_s2"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(children, NODE, "left").join(hashed, NODE, "left")
    whole = c.stored(whole.join(parents, ["depth", "before_s1", "before_s2"], "left").drop("before_s1", "before_s2", *HASHES), "whole-nodes")
    return _ranked(whole)


def _ends(ends: DataFrame) -> DataFrame:
    """For each node at which conversations end: how many, and the SHA-256 of their keys in ascending order, joined by commas."""
    blocks = ends.groupBy(*NODE, F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("keys"))
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = blocks.repartition(n, *NODE).sortWithinPartitions(*NODE, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, count, state = None, 0, None
        for part in batches:
            out = []
            for *this, _, n, keys in zip(*[part.column(x).to_pylist() for x in (*NODE, "chunk", "n", "keys")], strict=True):
                if this != node:
                    if node is not None:
                        out.append((*node, count, state.hexdigest()))
                    node, count, state = this, 0, hashlib.sha256()
                elif count:
                    state.update(b",")
                state.update(keys.encode())
                count += n
            yield written(out)
        yield written([(*node, count, state.hexdigest())] if node is not None else [])

    names = [*NODE, "n_ends", "ends_sha256"]
    kinds = [pa.int64()] * 4 + [pa.string()]

    def written(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=k) for i, k in enumerate(kinds)], names=names)

    return ordered.mapInArrow(run, "depth long, s1 long, s2 long, n_ends long, ends_sha256 string")


def _branches(nodes: DataFrame) -> DataFrame:
    """conv_id of each branch and its path of branches: for each, from the root, 1, the negative depth that it hangs on, and its key.

    Each round joins a path with that of the branch on which it hangs, so that paths double.
    """
    none = F.array().cast("array<struct<kind:int,at:bigint,conv_id:bigint>>")
    tops = nodes.filter(F.col("parent_conv_id").isNull() | (F.col("parent_conv_id") != F.col("conv_id")))
    step = F.struct(F.lit(1).alias("kind"), (1 - F.col("depth")).alias("at"), F.col("conv_id").alias("conv_id"))
    now = c.Stored(tops.select("conv_id", F.col("parent_conv_id").alias("up"), F.when(F.col("parent_conv_id").isNull(), none).otherwise(F.array(step)).alias("path")), "branches")
    while not now.df.filter("up is not null").isEmpty():
        upper = now.df.select(F.col("conv_id").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"))
        done = now.df.filter("up is null")
        longer = now.df.filter("up is not null").join(upper, "up").select("conv_id", F.col("next").alias("up"), F.concat("before", "path").alias("path"))
        then = c.Stored(done.unionAll(longer), "branches")
        now.drop()
        now = then
    return now.df.select("conv_id", "path")


def _ranked(nodes: DataFrame) -> DataFrame:
    own = F.array(F.struct(F.lit(0).alias("kind"), F.col("depth").alias("at"), F.lit(0).cast("long").alias("conv_id")))
    counts = {"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "n_ends": F.coalesce("n_ends", F.lit(0).cast("long"))}
    keyed = nodes.join(_branches(nodes), "conv_id").withColumns(counts | {"rank": F.concat("path", own)}).drop("path")
    summed = keyed.withColumns({"one": F.lit(1).cast("long"), "leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")})
    run = c.stored(scans.running(summed, ["rank"], ["one", "leaf", "saved", "n_ends"], "preorder"), "preorder")
    last = run.filter("n_ends > 0").select(F.col("run_n_ends").alias("until"), F.col("run_one").alias("end_position"), F.col("run_leaf").alias("end_leaf"), F.col("run_saved").alias("end_saved"))
    both = run.withColumn("until", F.col("run_n_ends") - F.col("n_ends") + F.col("n_convs")).join(last, "until")
    inside = lambda end, n: (F.col(end) - F.col(f"run_{n}") + F.col(n))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return both.select(
        *["conv_id", "depth", "parent_conv_id", "n_convs", "n_children"],
        *[inside("end_leaf", "leaf").alias("n_leaves"), inside("end_saved", "saved").alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256")],
        *[F.col("run_one").alias("position"), "end_position", inside("end_position", "one").alias("n_nodes")],
    )


def conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of a table of turns as they are."""
    rows = c.stored(placed(digests(turns, key, turn, role, text)), "placed")
    return trie(with_ends(rows.withColumn("kind", F.lit(TURN)), rows.select("conv_id").distinct()))


# --- the query: conversations that share first turns -----------------------------------------------

#: Conversations of an equal quotient by this share the first turns of the first of them.
SHARED = 5
#: One more than the most turns that are shared.
HEADS = 9


def rebuilt(turns: DataFrame) -> DataFrame:
    """Rows for ``trie``: of conversation c, the first h turns of c - c % SHARED, then its own turns after its first h; h is its crc32 modulo HEADS."""
    rows = c.stored(placed(digests(turns)), "placed")
    convs = rows.select("conv_id").distinct()
    head = lambda key: c.crc32_of(key) % HEADS
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARED - 1).cast("long")))
    first = rows.filter((F.col("conv_id") % SHARED == 0) & (F.col("pos") < HEADS)).withColumn("k", other).withColumn("conv_id", F.col("conv_id") + F.when(F.col("conv_id") < 0, -F.col("k")).otherwise(F.col("k"))).drop("k")
    # Zero is the first of those above and of those below it.
    first = first.unionAll(rows.filter((F.col("conv_id") == 0) & (F.col("pos") < HEADS)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(SHARED - 1)))).withColumn("conv_id", -F.col("k").cast("long")).drop("k"))
    shared = first.filter(F.col("pos") <= head("conv_id")).join(convs, "conv_id", "left_semi").withColumn("kind", F.lit(TURN))
    own = rows.filter(F.col("pos") > head("conv_id")).withColumn("kind", F.lit(TURN + 1))
    return with_ends(shared.unionByName(own), convs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(c.table(spark, sf_dir, "conversations"))).drop("position", "end_position", "n_nodes")


def sql() -> str:
    """The same for DuckDB, with whole sequences as keys of nodes and all ancestors of every node."""
    crc = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, b:
        list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295)"""
    return f"""
    with t as (select conv_id, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (partition by conv_id order by turn nulls first) as pos from conversations where conv_id is not null),
    c as (select conv_id, {crc} % {HEADS} as h from (select distinct conv_id from t)),
    rows_ as (
        select c.conv_id, 0 as part, pos, r, x from c join t on t.conv_id = c.conv_id - c.conv_id % {SHARED} and pos <= h
        union all select c.conv_id, 1, pos, r, x from c join t on t.conv_id = c.conv_id and pos > h
    ),
    deep as (select conv_id, row_number() over w as depth, list([r, x]) over (w rows unbounded preceding) as path, x from rows_ window w as (partition by conv_id order by part, pos)),
    member as (select conv_id, depth, path, strlen(x) as bytes from deep union all select conv_id, 0, [], 0 from c),
    node as (select path, depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * min(bytes) as saved from member group by path, depth),
    last as (select path, string_agg(m.conv_id::varchar, ',' order by m.conv_id) as keys from member m join (select conv_id, max(depth) as depth from member group by conv_id) using (conv_id, depth) group by path),
    kids as (select path[1:depth - 1] as path, count(*) as n_children from node where depth > 0 group by 1),
    above as (select unnest(list_transform(range(depth + 1), lambda k: path[1:k])) as path, kids.path is null as leaf, saved from node left join kids using (path)),
    inside as (select path, count(*) filter (leaf) as n_leaves, sum(saved)::bigint as saved_tokens from above group by path)
    select node.conv_id, node.depth, up.conv_id as parent_conv_id, node.n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, sha256(coalesce(keys, '')) as ends_sha256
    from node join inside using (path) left join kids using (path) left join last using (path) left join node up on up.path = node.path[1:node.depth - 1] and node.depth > 0
    """
