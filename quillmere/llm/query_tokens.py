"""op8: tokens of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmere.llm.common import table
from quillmere.llm.token_counts import count_tokens
from quillmere.llm.vocabularies import vocabulary_path


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), limit=512)


QUERIES = {"op8_token_counts": op8_token_counts}
#: The counts come from a tokenizer library, which SQL has none of.
ORACLE_SQL: dict[str, str] = {}
