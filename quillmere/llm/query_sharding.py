"""op2: every document's shard of at most 16 MiB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.common import table
from quillmere.llm.sharding import assign_shards

LIMIT = 16 << 20


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign_shards(docs, LIMIT).select("doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), "prefix", "chunk")


QUERIES = {"op2_extendible_sharding": op2_extendible_sharding}
ORACLE_SQL = {
    "op2_extendible_sharding": f"""
    WITH d AS (
      SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
    p AS (SELECT doc_id, n_bytes, depth, h >> (60 - depth) AS prefix FROM d, (SELECT unnest(range(0, 41)) AS depth)),
    s AS (SELECT depth, prefix FROM p GROUP BY 1, 2 HAVING sum(n_bytes) <= {LIMIT})
    SELECT doc_id, n_bytes, CAST(min(depth) AS INTEGER) AS depth, CAST(arg_min(prefix, depth) AS BIGINT) AS prefix, CAST(0 AS BIGINT) AS chunk
    FROM p JOIN s USING (depth, prefix) GROUP BY doc_id, n_bytes
    """,
}
