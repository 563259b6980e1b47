"""Language-model scoring: a log-bilinear model trained in numpy by noise-contrastive estimation.

Words are classes: the most frequent training words each are one, all others
share one, and the end of a text is one. A word's score given the one before is
q[context] . r[word] + b[word]. The sufficient statistics, the class bigrams of
ALL training texts, are counted on the executors; the matrix of them is bounded
by the square of the number of classes. NCE then maximises, over that whole
matrix, the expected log odds that data are told from k unigram noise words. At
scoring, one batched matrix product gives all scores, which are normalised over
the classes exactly; within the shared class a word has its smoothed unigram
share. So the probabilities of all words, with one reserved for unseen words,
sum to 1 in every context.

Beside it: the smoothed unigram base score from the counts of all training
tokens. Frequent words and their counts (a bounded list) go to every task; the
other words of a text are joined to the table of counts, so that no frequent
word becomes a hot join key.

Defined cases: a null text counts as empty and is one end token; a null key is
never trained on (its remainder is null) and held_out is null; repeated rows
are counted and scored as often as they occur; very long texts are counted and
scored whole; words of equal counts are taken in their order; without training rows N and V
are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: Distinct words that a task counts before it hands its counts on.
FLUSH_WORDS = 150_000
END = ""  #: no word is empty, so this stands for the end of a text


@dataclass(frozen=True)
class Settings:
    classes: int = 1024  #: of the model, with the end and the shared class
    dimensions: int = 32
    noise: int = 8  #: noise words a data word
    steps: int = 150  #: of Adam over the whole bigram matrix
    rate: float = 0.05
    known_words: int = 100_000  #: words, at most, whose counts go to every task


@dataclass(frozen=True)
class Model:
    counts: DataFrame  #: word, c over all training tokens, the end as the empty word
    tokens: int
    distinct: int
    frequent: dict[str, int]  #: counts of the most frequent words
    classes: dict[str, int]  #: class of a word; others have the class ``shared``
    shared: int
    log10_p: np.ndarray  #: classes x classes: of the next class given the last
    shared_total: float  #: tokens in the shared class + its distinct words + 1


def words_of(text: str) -> list[bytes]:
    """Lower-case A-Z only, and split at the six ASCII white-space characters only: what bytes do."""
    return text.encode().lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """word, c of all tokens; counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return out

        for part in c.slices(batches):
            for t in part.column("text").to_pylist():
                seen.update(words_of(t))
            seen[b""] += part.num_rows
            if len(seen) > FLUSH_WORDS:
                yield flush()
        if seen:
            yield flush()

    return texts.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> dict[str, int]:
    """Words from the least count upwards that keeps them at ``most`` or fewer, by a histogram of counts."""
    level = F.floor(F.log2("c") * 16).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for r in levels:
        total += r["n"]
        if total > most:
            break
        least = r["level"]
    if least is None:
        return {}
    return {r["word"]: r["c"] for r in counts.filter(level >= least).collect()}


def class_bigrams(texts: DataFrame, classes: dict[str, int], n: int, shared: int, end: int) -> np.ndarray:
    """How often each class follows each class in all texts, as an n x n matrix."""
    ids = {w.encode(): k for w, k in classes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(n * n, dtype=np.int64)
        get = ids.get
        for part in c.slices(batches):
            flat = [end]
            for t in part.column("text").to_pylist():
                flat += [get(w, shared) for w in words_of(t)]
                flat.append(end)
            a = np.array(flat, dtype=np.int64)
            cells += np.bincount(a[:-1] * n + a[1:], minlength=n * n)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], names=["cell", "k"])

    got = texts.select("text").mapInArrow(run, "cell long, k long").groupBy("cell").agg(F.sum("k").alias("k")).toPandas()  # n * n cells at most
    out = np.zeros(n * n)
    out[got["cell"].to_numpy(np.int64)] = got["k"].to_numpy(np.float64)
    return out.reshape(n, n)


def train(bigrams: np.ndarray, s: Settings) -> np.ndarray:
    """NCE over the whole matrix; returns the log10 of normalised probabilities."""
    n, total = len(bigrams), max(bigrams.sum(), 1.0)
    rng = np.random.default_rng(7)
    noise = (bigrams.sum(0) + 0.5) / (bigrams.sum() + 0.5 * n)
    data, context = (bigrams / total).astype(np.float32), (bigrams.sum(1) / total).astype(np.float32)
    expected = (s.noise * context[:, None] * noise[None, :]).astype(np.float32)
    shift = np.log(s.noise * noise).astype(np.float32)
    w = {"q": rng.normal(0, 0.1, (n, s.dimensions)), "r": rng.normal(0, 0.1, (n, s.dimensions)), "b": np.log(noise)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    m, v = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}
    for t in range(1, s.steps + 1):
        score = w["q"] @ w["r"].T + w["b"]
        p = 1 / (1 + np.exp(-np.clip(score - shift, -30, 30)))
        d = data * (1 - p) - expected * p  # gradient of the objective by the score
        grad = {"q": d @ w["r"], "r": d.T @ w["q"], "b": d.sum(0)}
        for k in w:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
            w[k] = w[k] + s.rate * (1 - t / (s.steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-10)
    score = (w["q"] @ w["r"].T + w["b"]).astype(np.float64)
    top = score.max(1, keepdims=True)
    return (score - top - np.log(np.exp(score - top).sum(1, keepdims=True))) / math.log(10)


def fit(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> Model:
    """Learn from all rows of ``docs``."""
    texts = c.id_texts(docs, key, text)
    counts = c.stored(count_words(texts), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    frequent = frequent_words(counts, settings.known_words)
    ranked = sorted(((n, w) for w, n in frequent.items() if w != END), key=lambda x: (-x[0], x[1]))[: settings.classes - 2]
    classes = {w: k for k, (_, w) in enumerate(ranked)}
    shared, end, n = len(classes), len(classes) + 1, len(classes) + 2
    log10_p = train(class_bigrams(texts, classes, n, shared, end), settings)
    in_classes = sum(k for k, _ in ranked)
    ends = frequent[END] if END in frequent else sum(r["c"] for r in counts.filter(F.col("word") == END).collect())
    shared_tokens = total["n"] - in_classes - ends
    shared_words = total["v"] - len(classes) - (ends > 0)
    return Model(counts, total["n"], total["v"], frequent, classes, shared, log10_p, shared_tokens + shared_words + 1)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability)."""
    spark = docs.sparkSession
    rows = c.id_texts(docs, key, text)
    # Bounded: settings.known_words counts and the square of settings.classes.
    given = spark.sparkContext.broadcast(({w.encode(): n for w, n in model.frequent.items()}, {w.encode(): k for w, k in model.classes.items()}, model.log10_p.astype(np.float32)))
    shared, end = model.shared, model.shared + 1
    names = ["uid", "doc_id", "n_tokens", "known", "logs", "path", "n_shared", "shared_logs", "words", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, classes, log10_p = given.value
        of_word, of_class = frequent.get, classes.get
        log_end = math.log10(frequent.get(b"", 0) + 1)
        uid = TaskContext.get().partitionId() << 40
        for part in c.slices(batches):
            out = []
            for t in part.column("text").to_pylist():
                words = words_of(t)
                a = np.array([end, *[of_class(w, shared) for w in words], end])
                n = np.array([of_word(w, 0) for w in words], dtype=np.int64)
                log = np.log10(n + 1.0)
                rest = Counter([w for w, k in zip(words, n.tolist(), strict=True) if not k])
                out.append((len(words) + 1, int((n > 0).sum()), float(log.sum()), float(log10_p[a[:-1], a[1:]].sum(dtype=np.float64)), int((a == shared).sum()), float(log[a[1:-1] == shared].sum()), list(rest), list(rest.values())))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            arrays = [pa.array(v, k) for v, k in zip(cols, kinds, strict=True)]
            arrays[6] = arrays[6].cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + len(out))), part.column("doc_id"), *arrays], names=names)
            uid += len(out)

    kind = docs.schema[key].dataType.simpleString()
    own = c.stored(rows.mapInArrow(run, f"uid long, doc_id {kind}, n_tokens long, known long, logs double, path double, n_shared long, shared_logs double, words array<string>, times array<long>"), "tokens")
    # The end is no rarer than any word here; where the list of frequent words is empty it comes from the table.
    ends = model.frequent.get(END)
    if ends is None:
        ends = sum(r["c"] for r in model.counts.filter(F.col("word") == END).collect())
    rare = own.select("uid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("uid", F.col("x.words").alias("word"), F.col("x.times").alias("k"))
    found = rare.join(model.counts, "word").groupBy("uid").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    joined = own.drop("words", "times").join(found, "uid", "left")
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("more_logs", F.lit(0.0))
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + more + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + logs + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(math.log10(model.tokens + model.distinct + 1))).alias("base_score"),
        (F.col("path") + F.col("shared_logs") + logs - F.col("n_shared") * F.lit(math.log10(model.shared_total))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.documents(spark, sf_dir).select("doc_id", "text")
    held = c.crc32_of("doc_id") % 7 == 2
    out = score(docs, fit(docs.filter(~held)))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
