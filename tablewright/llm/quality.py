"""Quality classifier: zstandard dictionaries of good and bad text, and a calibrated size difference.

Two views of a text are compressed: its bytes, and its shape (letters, capitals
and digits collapsed to one sign each, so that punctuation and layout stand
out). For each view there is a dictionary trained on good and one on bad
labelled texts, whole ones of a bounded number of rows. A whole text is cut into blocks, every block is compressed with
both, and the normalised difference of the summed sizes, with the compressed
ratio, is turned into a probability by a logistic calibration.

Defined cases: a null text counts as empty; an empty text has differences and
ratios of 0 and gets the calibrated score of such a text; null keys pass
through; an empty table gives an empty result, and without labels or documents to
learn from the score is constant; very long texts are scored whole, block by block;
repeated rows are scored alike; labels with null quality or null key
are ignored, keys with contradicting labels too; a score at the threshold is good; columns of the table are kept
and a column named as an output is replaced. If either class has too few rows
to train dictionaries, the score is the share of good labels (0.5 without any).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

#: The byte table of the shape view (a letter or non-ASCII byte, A capital, 0 digit, others as they are).
SHAPE = bytes(97 if 97 <= i <= 122 or i >= 128 else 65 if 65 <= i <= 90 else 48 if 48 <= i <= 57 else i for i in range(256))


@dataclass(frozen=True)
class Settings:
    """Bounds of the labelled sample and form of the model."""

    dictionary_rows: int = 400  #: labelled texts of each class, at most, for dictionaries
    calibration_rows: int = 1500  #: labelled texts of each class, at most, for the calibration
    block_bytes: int = 2000
    dictionary_bytes: int = 65536
    level: int = 3
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    dictionaries: tuple[bytes, ...]  #: good and bad for bytes, good and bad for shape; empty without training
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]  #: one weight, the log odds, without dictionaries
    settings: Settings


def shape(data: bytes) -> bytes:
    return re.sub(rb"a+", b"a", re.sub(rb"A+", b"A", data.translate(SHAPE)))


def _compressors(dictionaries: tuple[bytes, ...], level: int) -> list[zstandard.ZstdCompressor]:
    out = []
    for d in dictionaries:
        data = zstandard.ZstdCompressionDict(d)
        data.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_dict_id=False))
    return out


def _features(compressors: list, block: int):
    def of(text: str | None) -> tuple[float, ...]:
        raw = (text or "").encode()
        out = []
        for data, good, bad in ((raw, *compressors[:2]), (shape(raw), *compressors[2:])):
            g = b = 0
            for i in range(0, len(data), block):
                part = data[i : i + block]
                g += len(good.compress(part))
                b += len(bad.compress(part))
            out += [(b - g) / max(b, g, 1), min(g, b) / (len(data) + 20)]
        return tuple(out)

    return of


def _design(x: np.ndarray, mean, scale) -> np.ndarray:
    z = np.clip((x - np.asarray(mean)) / np.asarray(scale), -4, 4)
    return np.concatenate([np.ones((len(z), 1)), z, z * z], axis=1)


def _logistic(a: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, a.T @ (y - p) - ridge * w)
    return w


def one_text(texts: DataFrame, *by: str) -> DataFrame:
    """Of rows that share a key one text, that with the least hash, so that as many texts come to the driver as there are keys."""
    return texts.groupBy(*by).agg(F.min_by("text", F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on a bounded sample of labelled rows, taken in the order of a hash of the key.

    Of each class at most ``dictionary_rows + calibration_rows`` texts are
    used: some for the dictionaries, the rest for the calibration, whose
    features are computed on the executors over whole texts. Of texts that share a
    labelled key, that with the least hash counts.
    """
    one = (
        labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter("doc_id is not null and y in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("y1"))
        .filter("y = y1")
        .select("doc_id", "y", F.xxhash64(F.lit(17), "doc_id").alias("h"))
    )
    n = settings.dictionary_rows + settings.calibration_rows
    picks = [one.filter(F.col("y") == y).orderBy("h", "doc_id").limit(n) for y in (0, 1)]
    # Every other row goes to the dictionaries while they have room, so that either part gets its share of few labels.
    rows = [(r["doc_id"], r["y"], i % 2 == 0 and i < 2 * settings.dictionary_rows) for p in picks for i, r in enumerate(p.collect())]
    share = sum(y for _, y, _ in rows) / len(rows) if rows else 0.5
    constant = Model((), (), (), (float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))),), settings)
    if min(sum(y == v and d for _, y, d in rows) for v in (0, 1)) < 8:
        return constant
    spark = docs.sparkSession
    sample = spark.createDataFrame(rows, T.StructType([T.StructField("doc_id", one.schema["doc_id"].dataType), T.StructField("y", T.IntegerType()), T.StructField("dictionary", T.BooleanType())]))
    # At most 2 * (dictionary_rows + calibration_rows) keys: a proven bound for the broadcast.
    texts = one_text(c.id_texts(docs, key, text).join(F.broadcast(sample), "doc_id"), "doc_id", "y", "dictionary")
    block = settings.block_bytes
    # ``dictionary_rows`` whole texts of each class at most.
    got = texts.filter("dictionary").select("y", "text").orderBy("doc_id", "text").collect()
    dictionaries = []
    for view in (bytes, shape):
        for y in (1, 0):
            samples = [p for r in got if r["y"] == y for d in [view(r["text"].encode())] for p in (d[i : i + block] for i in range(0, len(d), block)) if len(p) >= 8]
            try:
                dictionaries.append(zstandard.train_dictionary(settings.dictionary_bytes, samples).as_bytes())
            except zstandard.ZstdError:  # too little text to train on: the samples themselves
                dictionaries.append(b"".join(samples) or b"        ")
    compressors = tuple(dictionaries)
    level = settings.level

    def features():
        of = _features(_compressors(compressors, level), block)
        return lambda values: [[list(of(v)) for v in values]]

    rest = c.add_columns(texts.filter("not dictionary").select("doc_id", "y", "text"), "text", [c.field("x", T.ArrayType(T.DoubleType()))], features, drop=True).orderBy("doc_id").collect()
    if len({r["y"] for r in rest}) < 2:
        return constant
    x, y = np.array([r["x"] for r in rest]), np.array([r["y"] for r in rest], dtype=float)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    weights = _logistic(_design(x, mean, scale), y)
    # The sample holds each class up to a bound; the intercept goes back to the shares among all labels.
    seen = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = max((y == 1).sum(), 1), max((y == 0).sum(), 1)
    weights[0] += np.log(seen.get(1, 1) / seen.get(0, 1)) - np.log(pos / neg)
    return Model(compressors, tuple(mean), tuple(scale), tuple(weights), settings)


def score(docs: DataFrame, model: Model, text: str = "text", score_col: str = "score", keep_text: bool = True) -> DataFrame:
    """Append the probability that a text is good. Narrow: no shuffle, one pass over the texts."""

    def make():
        s = model.settings
        if not model.dictionaries:
            p = float(1 / (1 + np.exp(-model.weights[0])))
            return lambda values: [[p] * len(values)]
        of = _features(_compressors(model.dictionaries, s.level), s.block_bytes)
        w = np.asarray(model.weights)
        return lambda values: [1 / (1 + np.exp(-np.clip(_design(np.array([of(v) for v in values]), model.mean, model.scale) @ w, -30, 30)))]

    return c.add_columns(docs, text, [c.field(score_col, T.DoubleType())], make, drop=not keep_text)


def training_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The labels that may be learnt from: crc32 of the key is not divisible by 5."""
    return labels.filter(c.crc32_of(key) % 5 != 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, training_labels(c.table(spark, sf_dir, "labels")))
    return score(docs, model, keep_text=False).select(
        "doc_id", (c.crc32_of("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= model.settings.threshold).cast("int").alias("predicted")
    )
