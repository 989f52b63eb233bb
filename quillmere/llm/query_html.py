"""op12: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.common import table
from quillmere.llm.html_extract import extract_pages


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op12_html_extraction": op12_html_extraction}
#: SQL has no reader of HTML; the query is held against a model in tests/llm.
ORACLE_SQL: dict[str, str] = {}
