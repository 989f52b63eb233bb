"""op5: the 20 highest integer inner products of every twentieth vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.common import table
from quillmere.llm.topk import quantize, top_products


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantize(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_products(vectors.where(F.col("vec_id") % 20 == 0), vectors, k=20)


QUERIES = {"op5_exact_topk": op5_exact_topk}
ORACLE_SQL = {
    "op5_exact_topk": """
    WITH v AS (
      SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
}
