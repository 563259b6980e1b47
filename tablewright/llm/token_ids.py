"""Token ids in binary shards, and a minimal perfect hash index from document keys to places in them.

A shard holds a range of keys in ascending order: the raw ids (little-endian,
2 bytes if the vocabulary allows, else 4), then the number of ids of each
document (int64), then a fixed trailer. The index is split into buckets by a
hash of the key. A bucket is a minimal perfect hash function over its keys
(levels of bit arrays, each key settled at the first level where it is alone),
and for each slot a 32-bit fingerprint of the key and the place: shard, row,
first id, number of ids, number of rows with that key. A look-up probes a
constant expected number of words of bits, with the ranks stored beside them, reads the one entry, compares the
fingerprint and gives the place; nothing else of the file is read, unless many keys of a bucket are asked for at once;
a key that was not indexed is found only if its fingerprint agrees by chance
(2**-32).

Defined cases: a null text counts as empty and gives the end id alone; a null
key is a key of its own and comes first; very long texts are encoded whole; rows that repeat a key stand next to
each other, ordered by text, under one index entry; an empty table gives no
shards and an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c
from .encoding import encoder
from .files import reading, writing

#: Keys of an index bucket, about.
BUCKET_KEYS = 50_000
#: Trailer of a shard: width of an id, documents, ids (three int64).
TRAILER = 24
NULL_KEY = "\x00"
ENTRY = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("row", "<i8"), ("start", "<i8"), ("length", "<i8"), ("copies", "<i8")])


@dataclass(frozen=True)
class Store:
    """Where the shards and the index are; ``starts`` has the ids before each shard (one number a shard)."""

    path: str
    manifest: DataFrame
    key_type: T.DataType
    starts: dict[int, int]
    buckets: int


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(NULL_KEY))


def _hashes(df: DataFrame, buckets: int) -> DataFrame:
    """The two hashes of a key: h1 gives its bucket and fingerprint, h2 its slot there."""
    return df.withColumns({"h1": F.xxhash64(F.lit(1), "key"), "h2": F.xxhash64(F.lit(2), "key")}).withColumn("bucket", F.pmod("h1", F.lit(buckets)).cast("int"))


def _fingerprint(pdf: pd.DataFrame) -> np.ndarray:
    return (pdf["h1"].to_numpy().view(np.uint64) >> np.uint64(32)).astype(np.uint32)


# --- minimal perfect hash function -------------------------------------------------------------


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    """A new hash for each level (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = h.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: 64 bits of a level, and the number of set bits before them in this and all earlier levels.
WORD = np.dtype([("bits", "<u8"), ("rank", "<u4")])


@dataclass
class PerfectHash:
    """Bit arrays by level; the slot of a key is the rank of its bit. Keys left over after the last level are listed.

    Ranks are stored beside the bits, so a slot takes one word of each level that is probed, whatever the number of keys.
    """

    sizes: list[int]  #: bits of each level
    levels: list[np.ndarray]
    rest: np.ndarray
    settled: int  #: keys before those of ``rest``

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0, most: int = 40) -> PerfectHash:
        sizes, levels, left, rank = [], [], np.unique(keys), 0
        while len(left) and len(levels) < most:
            size = max(8, int(gamma * len(left)))
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=-(-size // 64) * 64) == 1
            words = np.zeros(len(bits) // 64, WORD)
            words["bits"] = np.packbits(bits, bitorder="little").view("<u8")
            counts = bits.reshape(-1, 64).sum(1)
            words["rank"] = rank + np.cumsum(counts) - counts
            rank += int(counts.sum())
            sizes.append(size)
            levels.append(words)
            left = left[~bits[at]]
        return cls(sizes, levels, np.sort(left), rank)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for k, (size, words) in enumerate(zip(self.sizes, self.levels, strict=True)):
            at = _mix(keys[open_], k) % np.uint64(size)
            word, bit = words[(at >> np.uint64(6)).astype(np.int64)], at & np.uint64(63)
            hit = (word["bits"] >> bit & np.uint64(1)).astype(bool)
            below = word["bits"] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (word["rank"] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.settled + at[hit]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.sizes), len(self.rest), self.settled, *self.sizes], dtype="<i8")
        return head.tobytes() + b"".join(w.tobytes() for w in self.levels) + self.rest.astype("<i8").tobytes()

    @classmethod
    def load(cls, data: bytes) -> tuple[PerfectHash, int]:
        n, rest, settled = (int(x) for x in np.frombuffer(data, "<i8", 3))
        sizes = np.frombuffer(data, "<i8", n, 24).tolist()
        at, levels = 24 + 8 * n, []
        for s in sizes:
            levels.append(np.frombuffer(data, WORD, -(-s // 64), at))
            at += levels[-1].nbytes
        return cls(sizes, levels, np.frombuffer(data, "<i8", rest, at), settled), at + 8 * rest


#: Keys of one bucket beyond which a look-up reads its file at once.
MANY_KEYS = 200


def _entries(file, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key the entry at its slot, and whether it has one. A few keys cost a few reads of a few bytes each."""
    if len(keys) > MANY_KEYS:
        data = file.read()
        function, at = PerfectHash.load(data)
        slots = function.slots(keys)
        return np.frombuffer(data, ENTRY, offset=at)[np.maximum(slots, 0)], slots >= 0
    n, rest, settled = (int(x) for x in np.frombuffer(file.read_at(24, 0), "<i8"))
    sizes = np.frombuffer(file.read_at(8 * n, 24), "<i8").tolist() if n else []
    starts = (24 + 8 * n + np.cumsum([0, *(-(-s // 64) * WORD.itemsize for s in sizes)])).tolist()
    out, found = np.zeros(len(keys), ENTRY), np.zeros(len(keys), bool)
    left = np.frombuffer(file.read_at(8 * rest, starts[-1]), "<i8") if rest else np.empty(0, np.int64)  # 40 levels leave next to none
    for i in range(len(keys)):
        slot = -1
        for k, size in enumerate(sizes):
            at = int(_mix(keys[i : i + 1], k)[0] % np.uint64(size))
            word = np.frombuffer(file.read_at(WORD.itemsize, starts[k] + at // 64 * WORD.itemsize), WORD)[0]
            bits = int(word["bits"])
            if bits >> at % 64 & 1:
                slot = int(word["rank"]) + (bits & (1 << at % 64) - 1).bit_count()
                break
        if slot < 0 and (hit := np.flatnonzero(left == keys[i])).size:
            slot = settled + int(hit[0])
        if slot >= 0:
            out[i] = np.frombuffer(file.read_at(ENTRY.itemsize, starts[-1] + 8 * rest + slot * ENTRY.itemsize), ENTRY)[0]
            found[i] = True
    return out, found


# --- writing -----------------------------------------------------------------------------------


def write(docs: DataFrame, tokenizer: str, kind: str, end_id: int, key: str = "doc_id", text: str = "text", shards: int | None = None, path: str | None = None) -> Store:
    """Encode every text, append the end id, write shards in ascending key order, and index them.

    One shuffle of the texts by ranges of the key; each shard is streamed to its
    file by the task that encodes it.
    """
    spark = docs.sparkSession
    path = path or c.new_path(spark, "token-ids")
    n = shards or _shards(docs, text)
    key_type = docs.schema[key].dataType
    rows = c.id_texts(docs, key, text).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").select(key_text(F.col("doc_id")).alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, kind)
        shard, lengths, total, out, file = TaskContext.get().partitionId(), [], 0, None, None
        for part in c.slices(batches):
            if out is None:
                file = writing(f"{path}/shards/{shard:06d}.ids")
                out = file.__enter__()
            ids = [np.append(x, np.uint32(end_id)) for x in coder.encode(part.column("text").to_pylist())]
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            first = total + np.cumsum(sizes) - sizes
            out.write(np.concatenate(ids).astype(coder.dtype).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), shard, np.int32)), part.column("key"), pa.array(np.arange(len(lengths), len(lengths) + len(ids))), pa.array(first), pa.array(sizes)],
                names=["shard", "key", "row", "start", "length"],
            )
            lengths += sizes.tolist()
            total += int(sizes.sum())
        if out is not None:
            out.write(np.array(lengths, "<i8").tobytes() + np.array([coder.dtype().itemsize, len(lengths), total], "<i8").tobytes())
            file.__exit__(None, None, None)

    manifest = c.stored(rows.mapInArrow(run, "shard int, key string, row long, start long, length long"), "manifest")
    totals = manifest.groupBy("shard").agg(F.sum("length").alias("n")).orderBy("shard").collect()  # one row a shard
    starts, before = {}, 0
    for r in totals:
        starts[r["shard"]], before = before, before + r["n"]
    buckets = max(1, -(-manifest.count() // BUCKET_KEYS))
    _index(manifest, path, buckets)
    return Store(path, manifest, key_type, starts, buckets)


#: Characters of a shard, about.
SHARD_CHARS = 64_000_000


def _shards(docs: DataFrame, text: str) -> int:
    """So many shards that each is of a bounded size (but for rows that share one key), and as many as there are shuffle partitions at least."""
    chars = docs.agg(F.sum(F.length(text)).alias("n")).first()["n"] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // SHARD_CHARS))


def _index(manifest: DataFrame, path: str, buckets: int) -> None:
    # A key's rows are neighbours in one shard, so the entry with its first row covers them all.
    one = manifest.groupBy("key").agg(F.min("shard").alias("shard"), F.min("row").alias("row"), F.min("start").alias("start"), F.sum("length").alias("length"), F.count("*").alias("copies"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h2 = pdf["h2"].to_numpy()
        function = PerfectHash.build(h2)
        entries = np.zeros(len(np.unique(h2)), dtype=ENTRY)
        at = function.slots(h2)
        entries["fingerprint"][at] = _fingerprint(pdf)
        for name in ("shard", "row", "start", "length", "copies"):
            entries[name][at] = pdf[name].to_numpy()
        with writing(f"{path}/index/{int(pdf['bucket'].iloc[0]):06d}.mph") as out:
            out.write(function.dump() + entries.tobytes())
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "keys": [len(entries)]})

    built = _hashes(one, buckets).groupBy("bucket").applyInPandas(build, "bucket int, keys long")
    keys, rows = c.stored(built, "index").agg(F.sum("keys")).first()[0], one.count()
    if (keys or 0) != rows:
        raise ValueError(f"two keys share a bucket and a 64-bit hash: {rows} keys, {keys} slots")


# --- reading -----------------------------------------------------------------------------------


def lookup(store: Store, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The place of every key of ``keys`` that is in the index: key, shard, row, start, length, copies."""
    path = store.path
    wanted = _hashes(keys.select(key_text(F.col(key)).alias("key")).distinct(), store.buckets)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            with reading(f"{path}/index/{int(pdf['bucket'].iloc[0]):06d}.mph") as f:
                found, ok = _entries(f, pdf["h2"].to_numpy())
        except FileNotFoundError:  # a bucket without keys has no file
            found, ok = np.zeros(len(pdf), ENTRY), np.zeros(len(pdf), bool)
        ok = ok & (found["fingerprint"] == _fingerprint(pdf))
        found = found[ok]
        return pd.DataFrame({"key": pdf["key"][ok].to_numpy()} | {n: found[n].astype(np.int64) for n in ("shard", "row", "start", "length", "copies")})

    return wanted.groupBy("bucket").applyInPandas(find, "key string, shard long, row long, start long, length long, copies long")


def fetch(store: Store, keys: DataFrame, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Documents read back from the shards through the index.

    doc_id, start (ids of all documents before it), n_tokens, ids_crc32 over the
    ids as little-endian uint32, and with ``with_ids`` the ids as such bytes.
    """
    path, starts = store.path, store.starts

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        out: dict[str, list] = {n: [] for n in ("key", "start", "n_tokens", "ids_crc32", "ids")}
        with reading(f"{path}/shards/{shard:06d}.ids") as f:
            size = f.size()
            width, docs, _ = (int(x) for x in np.frombuffer(f.read_at(TRAILER, size - TRAILER), "<i8"))
            lengths = np.frombuffer(f.read_at(8 * docs, size - TRAILER - 8 * docs), "<i8")
            for k, row, start, copies in pdf.sort_values("row")[["key", "row", "start", "copies"]].itertuples(index=False):
                for n in lengths[row : row + copies]:
                    ids = np.frombuffer(f.read_at(int(n) * width, start * width), f"<u{width}").astype("<u4").tobytes()
                    for name, v in (("key", k), ("start", starts[shard] + start), ("n_tokens", int(n)), ("ids_crc32", zlib.crc32(ids)), ("ids", ids if with_ids else None)):
                        out[name].append(v)
                    start += int(n)
        return pd.DataFrame(out if with_ids else {k: v for k, v in out.items() if k != "ids"})

    found = lookup(store, keys, key).groupBy("shard").applyInPandas(read, "key string, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return found.withColumn("doc_id", F.when(F.col("key") != NULL_KEY, F.col("key")).cast(store.key_type)).select("doc_id", *[n for n in found.columns if n != "key"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.documents(spark, sf_dir).select("doc_id", "text")
    store = write(docs, public_tokenizers.path("word_bpe_49k.json"), "words", end_id=1)
    return fetch(store, store.manifest.select("key"), "key", with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
