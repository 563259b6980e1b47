"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_join, jaccard_join, language_model, line_dedup, mixing, outliers, packing, phrases, prefix_trie, quality, secrets, token_ids, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": secrets.query,
        "op2_quality_classifier": quality.query,
        "op3_token_ids": token_ids.query,
        "op4_embedding_join": embedding_join.query,
        "op5_packing": packing.query,
        "op6_line_dedup": line_dedup.query,
        "op7_mixing": mixing.query,
        "op8_language_model": language_model.query,
        "op9_outliers": outliers.query,
        "op10_jaccard_join": jaccard_join.query,
        "op11_prefix_trie": prefix_trie.query,
        "op12_url_filter": url_filter.query,
        "op13_phrases": phrases.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": secrets.sql(), "op11_prefix_trie": prefix_trie.sql(), "op12_url_filter": url_filter.sql(), "op13_phrases": phrases.sql()}
