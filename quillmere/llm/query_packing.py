"""op1: every document packed into sequences of at most 4096 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmere.llm.common import table
from quillmere.llm.packing import pack_documents
from quillmere.llm.vocabularies import vocabulary_path


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), capacity=4096, end_id=1)


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
#: The ids come from a tokenizer library, which SQL has none of.
ORACLE_SQL: dict[str, str] = {}
