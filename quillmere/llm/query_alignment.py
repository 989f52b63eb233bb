"""op11: two tokenizers' tokens of every document aligned, with the corpus' counts of the pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmere.llm.alignment import align_tokens
from quillmere.llm.common import table
from quillmere.llm.vocabularies import vocabulary_path


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_tokens(docs, vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))


QUERIES = {"op11_token_alignment": op11_token_alignment}
#: The tokens come from tokenizer libraries, which SQL has none of.
ORACLE_SQL: dict[str, str] = {}
