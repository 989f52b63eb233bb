"""op6: documents without the lines that ten documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.common import table
from quillmere.llm.line_dedup import drop_frequent_lines


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_frequent_lines(docs, min_docs=10).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLE_SQL = {
    "op6_line_dedup": """
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (
      SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
    k AS (
      SELECT r, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
    kept AS (SELECT r, string_agg(line, chr(10) ORDER BY pos) AS t, count(*) AS n FROM k WHERE key NOT IN (SELECT key FROM f) GROUP BY r)
    SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (r)
    """,
}
