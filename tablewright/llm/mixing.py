"""Mixing to target weights with soft membership of domains.

The labelled table gives the domains: ``low`` (quality 0), ``toxic`` (quality 1,
toxic 1) and ``clean`` (quality 1, toxic 0). A softmax classifier on the
presence of telling words and on the form of a text predicts each document's
posteriors. Nonnegative rates r of the documents are then fitted by projected
gradient so that the expected tokens of each domain, the sums of posterior times
tokens times rate, match their targets in the least-squares sense. A step
changes a rate by an amount linear in the document's posteriors and cuts it at
zero; so the rates are a short fold over the steps, every pass is one grouped
sum in whole numbers, and only sums over domains come to the driver. Two runs over the
same rows give the same rates to the last bit.

Tokens are words between ASCII white space, one at least. Defined cases: a null
text counts as empty; labels with nulls or contradictions are ignored; of texts that share a labelled key, that with the least hash counts; without
labels of two domains all posteriors are the shares of the labels (equal without
any); a domain that nothing belongs to cannot be met and gets what is least in
squares; very long texts count whole; an empty table gives an empty result; repeated rows get equal rates; a target that is not given is 0; words that tell equally much are taken in their order; other
columns pass through, and a column named as an output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c
from .quality import one_text

DOMAINS = ("clean", "low", "toxic")
#: ASCII signs that are not letters or digits separate words here.
_WORD_TABLE = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


@dataclass(frozen=True)
class Settings:
    """Bounds of the labelled sample, and the targets of the query and the pipeline."""

    rows: int = 1200  #: labelled texts of each domain, at most
    words: int = 3000  #: words of the classifier, at most
    least_texts: int = 3  #: of the sample that hold a word
    ridge: float = 1e-3
    weights: dict[str, float] = field(default_factory=lambda: {"clean": 0.97, "low": 0.01, "toxic": 0.02})
    headroom: float = 1.1  #: target tokens of the first domain, in units of what it is expected to have
    steps: int = 30
    tolerance: float = 1e-7


@dataclass(frozen=True)
class Model:
    words: dict[bytes, int]
    coefficients: np.ndarray  #: domains x (bias, form, words)
    mean: np.ndarray
    scale: np.ndarray


def _form(text: str) -> tuple[list[float], set[bytes], int]:
    """What the form of a text is like, the distinct words, the number of words."""
    raw = text.encode()
    split = raw.split()
    size, n = max(len(raw), 1), max(len(split), 1)
    upper = sum(map(raw.count, (b"A", b"E", b"I", b"N", b"O", b"R", b"S", b"T")))
    signs = sum(map(raw.count, (b"!", b"#", b"$", b"%", b"&", b"*", b"|", b"<", b">")))
    distinct = len(set(split))
    lines = raw.split(b"\n")
    return [upper / size, signs / size, distinct / n, len(set(lines)) / len(lines), float(np.log1p(n))], set(raw.translate(_WORD_TABLE).lower().split()), n


def _posterior(x: np.ndarray, hits: list[list[int]], model: Model) -> np.ndarray:
    k = len(model.mean)
    w = model.coefficients
    score = w[:, 0] + np.clip((x - model.mean) / model.scale, -4, 4) @ w[:, 1 : 1 + k].T
    words = w[:, 1 + k :].T
    for row, at in enumerate(hits):
        if at:
            score[row] += words[sorted(at)].sum(0)  # in one order, so that every run gives the same bits
    score -= score.max(1, keepdims=True)
    p = np.exp(score)
    return p / p.sum(1, keepdims=True)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> Model:
    """The classifier, from a bounded sample of labelled rows of each domain in the order of a hash of the key."""
    quality, toxic = F.col("quality").cast("int"), F.col("toxic").cast("int")
    domain = F.when(quality == 0, 1).when((quality == 1) & (toxic == 1), 2).when((quality == 1) & (toxic == 0), 0)
    one = labels.select(F.col(key).alias("doc_id"), domain.alias("y")).filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y1")).filter("y = y1").drop("y1")
    seen = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = max(sum(seen.values()), 1)
    share = np.array([(seen.get(k, 0) + 1e-6) / total for k in range(len(DOMAINS))]) if seen else np.ones(len(DOMAINS))
    constant = Model({}, np.concatenate([np.log(share)[:, None], np.zeros((len(DOMAINS), 5))], 1), np.zeros(5), np.ones(5))
    picked = [r for k in range(len(DOMAINS)) for r in one.filter(F.col("y") == k).orderBy(F.xxhash64(F.lit(23), "doc_id"), "doc_id").limit(settings.rows).collect()]
    if len({r["y"] for r in picked}) < 2:
        return constant
    sample = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in picked], T.StructType([T.StructField("doc_id", one.schema["doc_id"].dataType), T.StructField("y", T.IntegerType())]))

    def make():
        def of(values: list) -> list:
            got = [_form(v) for v in values]
            return [[f for f, _, _ in got], [sorted(w.decode(errors="replace") for w in words) for _, words, _ in got]]

        return of

    # At most ``rows`` keys a domain: a proven bound for the broadcast.
    texts = one_text(c.id_texts(docs, key, text).join(F.broadcast(sample), "doc_id"), "doc_id", "y")
    fields = [c.field("form", T.ArrayType(T.DoubleType())), T.StructField("words", T.ArrayType(T.StringType()))]
    both = c.stored(_with_words(texts, make, fields), "sample")
    y_words = both.select("y", F.explode("words").alias("w")).groupBy("w").agg(*[F.count_if(F.col("y") == k).alias(f"n{k}") for k in range(len(DOMAINS))])
    n = {r["y"]: r["n"] for r in both.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return constant
    all_rows, seen_in = sum(n.values()), sum((F.col(f"n{k}") for k in range(len(DOMAINS))), F.lit(0))
    # A word tells as much as its texts in a domain differ from the number expected there.
    tells = F.greatest(*[F.abs(F.col(f"n{k}") - seen_in * (n.get(k, 0) / all_rows)) / F.sqrt(seen_in) for k in range(len(DOMAINS))])
    words = [r["w"] for r in y_words.filter(seen_in >= settings.least_texts).orderBy(F.desc(tells), "w").limit(settings.words).collect()]
    at = {w.encode(): k for k, w in enumerate(words)}
    rows = both.select("y", "form", F.array_intersect("words", F.lit(words) if words else F.array().cast("array<string>")).alias("words")).collect()
    rows = sorted(rows, key=lambda r: (r["y"], r["form"], r["words"]))
    x = np.array([r["form"] for r in rows])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    a = np.zeros((len(rows), 1 + x.shape[1] + len(words)), np.float32)
    a[:, 0], a[:, 1 : 1 + x.shape[1]] = 1, np.clip((x - mean) / scale, -4, 4)
    for k, r in enumerate(rows):
        a[k, [1 + x.shape[1] + at[w.encode()] for w in r["words"]]] = 1
    w = _softmax(a, np.array([r["y"] for r in rows]), settings.ridge)
    got = np.array([n.get(k, 0) for k in range(len(DOMAINS))], float)
    w[:, 0] += np.where(got > 0, np.log(share / share.sum()) - np.log(np.maximum(got, 1) / all_rows), -20)
    return Model(at, w, mean, scale)


def _with_words(texts: DataFrame, make, fields) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        apply = make()
        for part in c.slices(batches):
            forms, words = apply(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(forms, pa.list_(pa.float64())), pa.array(words, pa.list_(pa.string()))], names=["y", "form", "words"])

    return texts.select("y", "text").mapInArrow(run, T.StructType([T.StructField("y", T.IntegerType()), *fields]))


def _softmax(a: np.ndarray, y: np.ndarray, ridge: float, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """Adam on the ridge-penalised log loss, each domain with equal weight."""
    k = len(DOMAINS)
    target = np.eye(k, dtype=np.float32)[y]
    weight = (1 / np.maximum(target.sum(0), 1))[y].astype(np.float32)[:, None] / k
    w = np.zeros((k, a.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    prior = np.log(np.maximum(target.mean(0), 1e-9) * k)
    for t in range(1, steps + 1):
        s = a @ w.T
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = ((p - target) * weight).T @ a + ridge * w / np.sqrt(len(a))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    w = w.astype(np.float64)
    w[:, 0] += prior  # as if each domain had its share of the sample
    return w


def posteriors(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append n_tokens and posterior (an array in the order of DOMAINS). Narrow: one pass over the texts."""

    def make():
        words = model.words

        def of(values: list) -> list:
            got = [_form(v or "") for v in values]
            p = _posterior(np.array([f for f, _, _ in got]), [[words[w] for w in s.intersection(words)] for _, s, _ in got], model)
            return [[max(n, 1) for _, _, n in got], np.round(p, 9).tolist()]

        return of

    return c.add_columns(docs, text, [c.field("n_tokens", T.LongType()), c.field("posterior", T.ArrayType(T.DoubleType()))], make)


def _rate(steps: list[np.ndarray]) -> Column:
    r = F.lit(1.0)
    for g in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.col("posterior")[k] * F.lit(float(x)) for k, x in enumerate(g)), F.lit(0.0)))
    return r


def fit_rates(scored: DataFrame, targets: np.ndarray | None, settings: Settings = Settings()) -> list[np.ndarray]:
    """The steps whose fold gives the rates. ``targets``: tokens of each domain, or None for the settings' weights.

    The squares are weighted by the inverse of the domains' second moments, in
    which the least-squares problem has a step of 1.
    """
    k = len(DOMAINS)
    p = [F.col("posterior")[i] for i in range(k)]

    def total(x: Column, name: str) -> Column:
        """A sum in whole millionths, which doesn't depend on the order of the rows."""
        return (F.sum((x * 1e6).cast("decimal(38,0)")).cast("double") / 1e6).alias(name)

    tokens = F.col("n_tokens")
    first = scored.agg(*[total(p[i] * tokens, f"e{i}") for i in range(k)], *[total(p[i] * p[j] * tokens, f"m{i}{j}") for i in range(k) for j in range(k)]).first()
    if first["e0"] is None:
        return []
    has = np.array([first[f"e{i}"] for i in range(k)])
    second = np.array([[first[f"m{i}{j}"] for j in range(k)] for i in range(k)])
    if targets is None:
        w = np.array([settings.weights.get(d, 0.0) for d in DOMAINS])
        targets = w / w[0] * has[0] * settings.headroom
    inverse = np.linalg.pinv(second + 1e-12 * np.trace(second) * np.eye(k), hermitian=True)
    steps: list[np.ndarray] = []
    for _ in range(settings.steps):
        gap = has - targets
        if np.abs(gap).sum() <= settings.tolerance * max(targets.sum(), 1.0):
            break
        steps.append(inverse @ gap)
        got = scored.withColumn("rate", _rate(steps)).agg(*[total(p[i] * tokens * F.col("rate"), f"e{i}") for i in range(k)]).first()
        new = np.array([got[f"e{i}"] for i in range(k)])
        if np.abs(new - has).sum() <= settings.tolerance * max(has.sum(), 1.0):
            break
        has = new
    return steps


def mix(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), targets: np.ndarray | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns with n_tokens, posterior, rate, and copies: the rate rounded up or down by a hash of key, text and place, so that it holds on average.

    The place is that in the written posteriors, so that rows without a key, and rows that repeat, are not all rounded alike.
    """
    scored = c.stored(posteriors(docs, fit(docs, labels, settings, key, text), text), "posteriors")
    rated = scored.withColumn("rate", _rate(fit_rates(scored, targets, settings)))
    chance = F.xxhash64(F.lit(29), F.col(key), F.col(text), F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    return rated.withColumn("copies", (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(c.documents(spark, sf_dir).select("doc_id", "text"), c.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_tokens", *[F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", "copies")
