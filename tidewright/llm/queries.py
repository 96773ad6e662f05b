"""The corpus operators' queries, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import chat, decontaminate, language, mixing, secrets, simhash, sstable, substring_bytes, substring_words, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secrets.query,
        "op2_top_k": topk.query,
        "op3_decontaminate": decontaminate.query,
        "op4_mix_sources": mixing.query,
        "op5_chat_format": chat.query,
        "op6_substring_words": substring_words.query,
        "op7_language": language.query,
        "op8_substring_bytes": substring_bytes.query,
        "op9_token_shards": sstable.query,
        "op10_simhash": simhash.query,
        "language_pages": language.pages_query,
    }


TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_top_k": TOP_K, "op4_mix_sources": mixing.oracle()}
