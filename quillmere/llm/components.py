"""Connected components of a graph that is a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import durable, swept

#: Edges of a task, 16 bytes each.
PER_TASK = 100_000


def _spread(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    return edges.join(hubs, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (u, v) reaches.

    Alternates two steps until the edges change no more: every node links its
    larger neighbours (large star), then its smaller ones and itself (small
    star), to the smallest. Both need only a minimum for each node, which is
    added up before the shuffle. A hub's edges meet its minimum in a join, which adaptive execution can deal
    out to several tasks only where Spark's thresholds for skew are passed. A task has ``PER_TASK`` edges at least where there
    are that many, so few edges are no work of many tasks. Null nodes and loops are left out; no edges give no rows.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = durable(edges)
    before, n = None, edges.count()
    for _ in range(rounds):
        parts = max(1, -(-n // PER_TASK))
        sized = lambda df: df.coalesce(parts)  # noqa: B023, E731
        edges = sized(edges)
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        hubs = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: (larger neighbour, smallest). Edges are (larger, smaller), so a node's larger neighbours are the u of edges whose v it is.
        larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = _spread(larger, hubs).distinct()
        hubs = large.groupBy("u").agg(F.min("v").alias("m"))
        small = sized(_spread(large, hubs).unionByName(hubs.select("u", F.col("m").alias("v")))).distinct()
        edges = durable(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        # What the round has shuffled, and the edges before it, take disk until both sides have been swept.
        del both, hubs, larger, large, small
        swept(edges.sparkSession)
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    found = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
