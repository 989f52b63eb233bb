"""op3: benchmark items that documents contain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmere.llm.common import table
from quillmere.llm.decontaminate import find_items


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontamination": op3_decontamination}
#: Best runs under an edit distance inside a text, which SQL cannot express.
ORACLE_SQL: dict[str, str] = {}
