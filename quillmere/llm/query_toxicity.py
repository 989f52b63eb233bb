"""op10: a toxicity score for every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.common import held_out, table
from quillmere.llm.toxicity import SAMPLE, learn, score_toxicity


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    machine = learn(docs, labels, SAMPLE)
    found = score_toxicity(docs, machine, threshold=0.3)
    return found.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op10_toxicity": op10_toxicity}
#: A learned model, which SQL has none of.
ORACLE_SQL: dict[str, str] = {}
