"""op9: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.common import held_out, table
from quillmere.llm.language_id import identify, train_profiles


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = train_profiles(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    found = identify(docs.select("doc_id", "text"), profiles)
    return found.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
#: A learned model, which SQL has none of.
ORACLE_SQL: dict[str, str] = {}
