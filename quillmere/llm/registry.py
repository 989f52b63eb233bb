"""Queries of this subpackage for the entry file, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmere.llm import query_alignment, query_chat, query_decontaminate, query_html, query_language, query_lines, query_near, query_packing, query_sharding, query_spelling, query_tokens, query_topk, query_toxicity

MODULES = (query_packing, query_sharding, query_decontaminate, query_chat, query_topk, query_lines, query_near, query_tokens, query_language, query_toxicity, query_alignment, query_html, query_spelling)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
