"""The corpus pipeline: from documents to packed token sequences.

Each stage takes the documents that its predecessor kept and returns documents
with the same columns; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import common, jaccard_join, line_dedup, mixing, packing, quality


def _others(docs: DataFrame) -> list[str]:
    return [n for n in docs.columns if n not in ("doc_id", "text")]


def _carried(docs: DataFrame) -> DataFrame:
    """Key and text for the operators, and all else of the row beside them in one column, so that no column of the documents meets one of theirs."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(_others(docs))]).alias("document"))


def _documents(rows: DataFrame, docs: DataFrame, cut: bool = False) -> DataFrame:
    """The rows as they came in; with ``cut``, where texts have changed, with n_chars as the text has."""
    place = {n: F.col("document").getField(f"c{i}") for i, n in enumerate(_others(docs))} | {n: F.col(n) for n in ("doc_id", "text")}
    if cut and "n_chars" in place:
        place["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[place[n].alias(n) for n in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null texts are empty; empty texts, very long ones and rows without a key are scored like others; rows that repeat stay or go
    together; a score at the threshold stays; an empty table stays empty; all columns stay as they are, whatever their names.
    """
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    scored = quality.score(_carried(docs), model, score_col="score")
    return _documents(scored.filter(F.col("score") >= model.settings.threshold), docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat, exactly or nearly, stay once; documents of which nothing is left go.

    A null text is empty and stays, as it loses nothing; of equal lines, the first by key (a null key is the first), text hash and line number stays; very long
    lines count whole; rows that repeat key and text lose the same lines; an empty table stays empty; n_chars follows the text, all other columns stay.
    """
    out = line_dedup.dedup(_carried(docs))
    return _documents(out.filter((F.col("n_removed") == 0) | (F.trim("text") != "")), docs, cut=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.

    A document is known by its key and a hash of its text, not by the key alone: rows without a key, and rows that share a key but not
    the text, are documents of their own. Of a group the least key stays, a null key only where there is no other; of rows that repeat
    key and text the least one. Documents without a word (null and empty texts among them) are near nothing, so all of them stay. Very long
    texts are compared whole; an empty table stays empty; all columns stay as they are, whatever their names.
    """
    text = common.text_of()
    known = F.struct(F.col("doc_id").isNull().alias("no_key"), F.col("doc_id").alias("key"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    words = text.rlike(r"[^\x20\t\n\r\x0b\f]")
    rows = _carried(docs)
    some = rows.filter(words).withColumn("known", known)
    kept = jaccard_join.join(some.select("known", "text"), key="known").filter("kept").select(F.col("doc_id").alias("known")).distinct()
    one = some.join(kept, "known", "left_semi").groupBy("known").agg(F.min(F.struct("doc_id", "document", "text")).alias("row")).select("row.*")
    return _documents(one, docs).unionAll(_documents(rows.filter(~words), docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or dropped at their rates, so that domains have their target shares of the tokens.

    Null and empty texts count as one token; very long ones count whole; rows without a key and rows that repeat are rounded up or down each for itself; an
    empty table stays empty; all columns stay as they are, whatever their names.
    """
    mixed = mixing.mix(_carried(docs), common.table(spark, sf_dir, "labels")).filter("copies > 0")
    return _documents(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens.

    A null text is empty, and an empty one is its end token alone; very long ones are cut into pieces; rows that repeat are packed each; an empty
    table has no pieces; other columns are left out.
    """
    return packing.packed_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("jaccard_join", near_duplicates),
    ("source_mixing", source_mixing),
    ("packing", best_fit_packing),
]

#: SQL expresses neither the classifier nor the packing; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
