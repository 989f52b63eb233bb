"""Similarity search over embeddings, and its fusion with keyword scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cut to 0..1; 0 for a zero vector. [MTH11]"""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0))))


#: Query vectors that may meet all documents at once, sent to each task; more go in blocks.
QUERY_BLOCK = 1000


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def finite(name: str) -> Column:
    """Whether a vector and all its components are there and finite."""
    odd = F.exists(name, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(F.col(name).isNotNull() & ~odd, F.lit(False))


#: Queries and vectors whose scores are in memory at once.
TILE = 256, 2048


class Best:
    """The ``top`` of each of ``n`` queries among the vectors met so far: higher scores first, ties to the smaller id.

    It holds ``n * top`` rows and the scores of one tile, however many vectors it meets at once.
    """

    def __init__(self, n: int, top: int):
        self.top, self.least = top, np.full(n, -1.0)
        self.rows, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def meet(self, units: np.ndarray, ids: np.ndarray, held: np.ndarray, rows: np.ndarray | None = None) -> None:
        """The queries' unit vectors, those at ``rows`` alone if it is given, meet unit vectors that have ``ids``."""
        rows = np.arange(len(units)) if rows is None else rows
        for i in range(0, len(rows), TILE[0]):
            some = rows[i : i + TILE[0]]
            for k in range(0, len(ids), TILE[1]):
                self._tile(some, np.clip(units[some] @ held[k : k + TILE[1]].T, 0.0, 1.0).round(12), ids[k : k + TILE[1]])

    def _tile(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        least = self.least[rows]
        if scores.shape[1] > self.top and (least < 0).any():
            least = np.maximum(least, np.partition(scores, -self.top, axis=1)[:, -self.top])
        at, column = np.nonzero(scores >= least[:, None])
        if not len(at):
            return
        all_rows = np.concatenate([self.rows, rows[at]])
        all_ids, all_scores = np.concatenate([self.ids, ids[column]]), np.concatenate([self.scores, scores[at, column]])
        order = np.lexsort((all_ids, -all_scores, all_rows))
        sorted_rows = all_rows[order]
        nth = np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows)
        order = order[nth < self.top]
        self.rows, self.ids, self.scores = all_rows[order], all_ids[order], all_scores[order]
        full = nth == self.top - 1
        self.least[sorted_rows[full]] = self.scores[np.searchsorted(self.rows, sorted_rows[full], "right") - 1]

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        """(query_id, vec_id, score) of what is held."""
        return pa.RecordBatch.from_arrays([pa.array(query_ids[self.rows]), pa.array(self.ids), pa.array(self.scores)], names=["query_id", "vec_id", "score"])


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of vectors of one length, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def search(vectors: DataFrame, queries: DataFrame, top: int = 100, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, score, rank) of each query's nearest vectors. [SEM12, JN18, TOP4]

    ``queries`` (query_id, vector) is a stated set; it meets the vectors in
    blocks of bounded size. Unit vectors are made once, tiles of a block of queries and a batch of vectors are matrix products, and
    a task passes on the best of each query only. Scores are rounded to twelve places before they are ranked, ties to the smaller vec_id.
    The queries' vectors are of one length; rows without an id, and vectors that are null, of another length, or hold nulls or what is no finite number, take no part.
    """
    rows = queries.select("query_id", "vector").where(F.col("query_id").isNotNull() & finite("vector"))
    lengths = [r[0] for r in rows.select(F.size("vector")).distinct().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError("the queries' vectors have different lengths")
    length = lengths[0] if lengths else 0
    vectors = vectors.where(finite("embedding") & (F.size("embedding") == length))
    n = -(-rows.count() // block) or 1
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(n)))
    found = None
    for k in range(n):
        asked = dealt.where(F.col("_block") == k).select("query_id", "vector").toPandas()
        if not len(asked) and found is not None:
            continue
        shared = vectors.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(np.int64), unit(np.array(asked["vector"].tolist(), np.float64).reshape(len(asked), length))))

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_ids, units = shared.value
            best = Best(len(query_ids), top)
            for batch in batches:
                if batch.num_rows and len(query_ids):
                    best.meet(units, batch.column(0).to_numpy(), unit(matrix(batch.column(1))))
            yield best.batch(query_ids)

        part = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null").mapInArrow(nearest, "query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= top)


def hybrid_weights(query: Column) -> Column:
    """(semantic, keyword) weights by the query's length and kind. [MTH13]"""
    parts = F.filter(F.split(F.trim(F.regexp_replace(query, r"\s+", " ")), " "), lambda w: w != "")
    asks = F.exists(F.slice(parts, 1, 2), lambda w: F.lower(w).isin("hur", "vad", "var", "när", "varför", "vem", "vilken", "vilket"))
    pair = lambda s, k: F.struct(F.lit(s).alias("semantic"), F.lit(k).alias("keyword"))
    return F.when(F.size(parts) <= 2, pair(0.6, 0.4)).when(F.size(parts) >= 5, pair(0.2, 0.8)).when(asks, pair(0.45, 0.55)).otherwise(pair(0.3, 0.7))


def fuse(keyword: DataFrame, semantic: DataFrame, keyword_weight: float | Column = 0.7, semantic_weight: float | Column = 0.3) -> DataFrame:
    """(query_id, doc_id, score): keyword scores over their highest, added to similarities; a side that lacks a document gives 0. [MTH12, JN13, SET6, AGG26]"""
    top = keyword.groupBy("query_id").agg(F.max("score").alias("_top"))
    normal = keyword.join(top, "query_id").select("query_id", "doc_id", F.when(F.col("_top") > 0, F.col("score") / F.col("_top")).otherwise(0.0).alias("_keyword"))
    near = semantic.select("query_id", "doc_id", F.col("score").alias("_semantic"))
    weigh = lambda w: w if isinstance(w, Column) else F.lit(w)
    both = normal.join(near, ["query_id", "doc_id"], "full_outer")
    return both.select("query_id", "doc_id", (weigh(keyword_weight) * F.coalesce("_keyword", F.lit(0.0)) + weigh(semantic_weight) * F.coalesce("_semantic", F.lit(0.0))).alias("score"))
