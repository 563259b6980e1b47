"""Quality rules: fixed base rules, then robust multivariate outliers by language and source.

For each text: its words, their characters, symbols, repeated lines and
repeated five-word windows. Texts that pass the base rules give, in each group
of language and source, a minimum-covariance-determinant estimate of location
and scatter of five transformed statistics: from two starts, the shortest half of each
statistic and its median and quartiles, concentration steps keep the half (of n rows in p
dimensions, (n + p + 1) / 2) with the least Mahalanobis distances until
its determinant falls no more, and the start with the least determinant counts. A text is rejected if its squared distance passes a
chi-square quantile. All steps are grouped sums over all rows (by group and bin of the
distance), so a hot source is summed in the tasks before any shuffle. Of the bin in which the half is
reached, each row counts with the share of the bin that still fits.

Defined cases: a null or empty text has no words and fails; a very long text
counts whole; null language or source is a
group of its own; a group of fewer than 100 passing texts is held against the
estimate of its language, and if that has fewer too, against that of all texts, so
every passing text gets a verdict; statistics that do not vary get
a least scale, so no covariance is singular; repeated rows count as often as
they occur; texts of equal distance get one verdict, and one at the cutoff stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

WINDOW = 5
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Transformed statistics, with the least standard deviation that counts for each.
FEATURES = ("length", "word_length", "symbols", "dup_lines", "repeats")
LEAST_SCALE = (0.3, 0.05, 0.5, 0.3, 0.05)
#: Stands for all sources of a language, or all languages.
WIDER = "\x01"
#: Quantiles of a half of the values that the start looks at; bins of the squared distance in a factor of two.
HALF, BINS = 50, 32


@dataclass(frozen=True)
class Settings:
    fall: float = 1e-3  #: of the logarithm of the determinant, without which an estimate stands
    tail: float = 1e-8  #: of a chi-square distribution that is rejected
    least_rows: int = 100  #: of a group (or language) with an estimate of its own


# --- statistics of a text ----------------------------------------------------------------------


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words that lie in an n-word window found twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(n)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    number: dict = {}
    at = np.array([number.setdefault(w, len(number)) for w in windows])
    twice = np.flatnonzero(np.bincount(at)[at] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    blank = sum(map(text.count, " \t\n\x0b\f\r"))
    return len(words), len(text) - blank, sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def with_statistics(docs: DataFrame, text: str = "text", drop: bool = False) -> DataFrame:
    def make():
        return lambda values: list(zip(*map(statistics, values), strict=True))

    return c.add_columns(docs, text, [c.field(s, T.LongType()) for s in STATS], make, drop=drop)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> list[Column]:
    words = F.greatest("n_words", F.lit(1))
    return [
        F.log1p("n_words").alias("length"),
        F.log(F.col("word_chars") / words + 1).alias("word_length"),
        F.log1p(1000.0 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("symbols"),
        F.log1p("n_dup_lines").alias("dup_lines"),
        (F.col("n_repeat_words") / words).alias("repeats"),
    ]


# --- chi-square --------------------------------------------------------------------------------


def chi2_cdf(x: float, k: int) -> float:
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return total * math.exp(a * math.log(z) - z - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


# --- minimum covariance determinant ------------------------------------------------------------

PARAMS = "lang string, source string, start int, mu array<double>, inv array<double>, logdet double, open boolean"


def _inverse(center: list[np.ndarray], scatter: list[np.ndarray]) -> list[list[float]]:
    """Inverses of covariances whose scales are held at the least; off-diagonals shrink a little."""
    out = []
    for s in scatter:
        scale = np.maximum(np.sqrt(np.maximum(np.diag(s), 0)), LEAST_SCALE)
        corr = 0.95 * s / np.outer(scale, scale)
        np.fill_diagonal(corr, 1.0)
        out.append((np.linalg.inv(corr) / np.outer(scale, scale)).ravel().tolist())
    return out


def _distance(p: int) -> Column:
    x = [F.col(FEATURES[i]) - F.col("mu")[i] for i in range(p)]
    return sum((x[i] * x[j] * F.col("inv")[i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))


def estimate(rows: DataFrame, s: Settings) -> DataFrame:
    """Location, inverse scatter and the logarithm of its determinant by (lang, source) of ``rows``."""
    p = len(FEATURES)
    start = rows.groupBy("lang", "source").agg(*[F.percentile_approx(f, [k / (2 * HALF) for k in range(2 * HALF + 1)], 1000).alias(f) for f in FEATURES])

    def first(batches):
        for pdf in batches:
            q = np.array([[list(x) for x in pdf[f]] for f in FEATURES]).reshape(p, len(pdf), 2 * HALF + 1)
            # Outliers, up to half of a group, move quartiles; the shortest interval with half of the values stays with the others.
            width = q[:, :, HALF:] - q[:, :, : HALF + 1]
            at = width.argmin(2)[:, :, None]
            low, high = (np.take_along_axis(q, at + k, 2)[:, :, 0].T for k in (0, HALF))
            quarter = HALF // 2
            for n, mu, scale in ((0, (low + high) / 2, (high - low) / 1.349), (1, q[:, :, HALF].T, (q[:, :, 3 * quarter] - q[:, :, quarter]).T / 1.349)):
                yield pd.DataFrame({"lang": pdf["lang"], "source": pdf["source"], "start": n, "mu": mu.tolist(), "inv": _inverse(list(mu), [np.diag(x**2) for x in scale]), "logdet": np.inf, "open": True})

    params = c.stored(start.mapInPandas(first, PARAMS), "mcd")
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def consistent(share: float) -> float:
        """For normal data, a kept share has variances too small by this factor."""
        return share / chi2_cdf(chi2_quantile(share, p), p + 2)

    def concentrate(batches):
        for pdf in batches:
            n = pdf["n"].to_numpy(float)[:, None]
            mu = np.array(pdf["sums"].tolist()).reshape(len(pdf), p) / n
            second = np.array(pdf["products"].tolist()).reshape(len(pdf), len(pairs)) / n
            scatter = np.zeros((len(pdf), p, p))
            for k, (i, j) in enumerate(pairs):
                scatter[:, i, j] = scatter[:, j, i] = second[:, k] - mu[:, i] * mu[:, j]
            factor = np.array([consistent(x) for x in n[:, 0] / pdf["all"]])[:, None, None]
            inv = _inverse(list(mu), list(scatter * factor))
            yield pd.DataFrame({"lang": pdf["lang"], "source": pdf["source"], "start": pdf["start"], "mu": mu.tolist(), "inv": inv, "logdet": -np.linalg.slogdet(np.array(inv).reshape(-1, p, p))[1], "open": True})

    while not params.filter("open").isEmpty():
        binned = rows.join(params.filter("open"), ["lang", "source"]).withColumn("bin", F.floor(BINS * F.log2(_distance(p) + 1e-6)).cast("int"))
        sums = [F.sum(f).alias(f) for f in FEATURES] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}{j}") for i, j in pairs]
        by_bin = binned.groupBy("lang", "source", "start", "bin").agg(F.count("*").alias("n"), *sums)
        # The bins with the least distances, up to the one in which the half is reached (some thousands of bins a group).
        window = "partition by lang, source, start"
        kept = by_bin.withColumns({"before": F.expr(f"coalesce(sum(n) over ({window} order by bin rows between unbounded preceding and 1 preceding), 0)"), "all": F.expr(f"sum(n) over ({window})")})
        kept = kept.withColumn("half", F.floor((F.col("all") + p + 1) / 2)).filter("before < half").withColumn("part", F.least(F.lit(1.0), (F.col("half") - F.col("before")) / F.col("n")))
        part = lambda x: F.sum(F.col("part") * F.col(x))
        total = kept.groupBy("lang", "source", "start").agg(part("n").alias("n"), F.first("all").alias("all"), F.array(*[part(f) for f in FEATURES]).alias("sums"), F.array(*[part(f"p{i}{j}") for i, j in pairs]).alias("products"))
        new = total.mapInPandas(concentrate, PARAMS).select("lang", "source", "start", F.struct("mu", "inv", "logdet", "open").alias("new"))
        falls = F.coalesce(F.col("new.logdet") < F.col("logdet") - s.fall, F.lit(False))
        # Each step of an open group lowers its determinant, which has a least value, so the steps end; a group that stands is not read again.
        taken = [F.when(falls, F.col(f"new.{x}")).otherwise(F.col(x)).alias(x) for x in ("mu", "inv", "logdet")]
        params = c.stored(params.join(new, ["lang", "source", "start"], "left").select("lang", "source", "start", *taken, falls.alias("open")), "mcd")
    best = params.groupBy("lang", "source").agg(F.min_by(F.struct("mu", "inv", "logdet"), F.struct("logdet", "start")).alias("x"))
    return best.select("lang", "source", "x.mu", "x.inv", "x.logdet")


def judge(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, the statistics, base_failed, distance (null only where the base rules have failed) and kept."""
    group = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("\x00"))
    some = docs.select(F.col(key).alias("doc_id"), group(lang).alias("lang"), group(source).alias("source"), F.col(text).alias("text"))
    rows = c.stored(with_statistics(some, drop=True).withColumn("base_failed", base_failed()), "statistics")
    vectors = rows.select("*", *features())
    passed = vectors.filter(~F.col("base_failed"))
    sizes = passed.groupBy("lang", "source").agg(F.count("*").alias("n"))
    enough = F.col("n") >= settings.least_rows
    large = sizes.groupBy("lang").agg(F.sum("n").alias("m")).withColumn("large", F.col("m") >= settings.least_rows).select("lang", "large")
    level = F.when(enough, 0).when(F.col("large"), 1).otherwise(2)
    wider = lambda name, at: F.when(F.col("level") < at, F.col(name)).otherwise(F.lit(WIDER))
    groups = sizes.join(large, "lang").withColumn("level", level).select("lang", "source", "level", wider("lang", 2).alias("of_lang"), wider("source", 1).alias("of_source"))
    groups = c.stored(groups, "groups")  # one row a group
    own = passed.join(groups.filter("level = 0").select("lang", "source"), ["lang", "source"])
    languages = passed.join(groups.filter("level = 1").select("lang").distinct(), "lang").withColumn("source", F.lit(WIDER))
    fitted = own.select(*FEATURES, "lang", "source").unionAll(languages.select(*FEATURES, "lang", "source"))
    if not groups.filter("level = 2").isEmpty():
        fitted = fitted.unionAll(passed.select(*FEATURES, F.lit(WIDER).alias("lang"), F.lit(WIDER).alias("source")))
    params = estimate(fitted, settings)
    placed = vectors.join(groups, ["lang", "source"], "left").drop("lang", "source").withColumnsRenamed({"of_lang": "lang", "of_source": "source"})
    p = len(FEATURES)
    cutoff = chi2_quantile(1 - settings.tail, p)
    out = placed.join(params, ["lang", "source"], "left").withColumn("distance", _distance(p))
    return out.select("doc_id", *STATS, "base_failed", F.when(~F.col("base_failed"), F.col("distance")).alias("distance"), (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(c.documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
