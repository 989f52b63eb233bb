"""PageRank and link joins over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.functions import lexicon as L
from quillmere.shared import durable, partitions_of


def pagerank(vertices: DataFrame, edges: DataFrame, iterations: int = L.ITERATIONS, damping: float = L.DAMPING, every: int = 5, settled: float = 1e-12) -> DataFrame:
    """(id, score) with the highest score 1. [MTH3, AGG26]

    ``vertices`` (id), ``edges`` (src, dst). The weight of vertices without
    edges is not dealt out again; an edge to no vertex counts in its source's
    degree and nowhere else. Vertices, links and ranks are dealt out alike once, so a turn shuffles nothing but the sums it has made
    beforehand. Every few turns the lineage is cut, and the turns end early where no score has moved by more than ``settled``.
    """
    parts = partitions_of(vertices.sparkSession)
    vertices = durable(vertices.select("id").distinct().repartition(parts, "id"))
    n = vertices.count()
    if not n:
        return vertices.withColumn("score", F.lit(0.0))
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    known = edges.join(vertices.withColumnRenamed("id", "dst"), "dst", "left_semi").join(vertices.withColumnRenamed("id", "src"), "src", "left_semi")
    links = durable(known.join(degree, "src").select("src", "dst", (1 / F.col("degree")).alias("share")).repartition(parts, "src"))
    ranks = before = vertices.withColumn("score", F.lit(1.0 / n))
    for turn in range(1, iterations + 1):
        sent = links.join(ranks, links["src"] == ranks["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        ranks = vertices.join(sent, "id", "left").select("id", ((1 - damping) / n + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        if turn % every == 0 and turn < iterations:
            ranks = durable(ranks)
            moved = ranks.join(before.withColumnRenamed("score", "_before"), "id").agg(F.max(F.abs(F.col("score") - F.col("_before")))).first()[0]
            before = ranks
            if moved <= settled:
                break
    ranks = durable(ranks)
    top = ranks.agg(F.max("score")).first()[0]
    return ranks.select("id", F.when(F.lit(top) > 0, F.col("score") / F.lit(top)).otherwise(0.0).alias("score"))


def resolve_links(pages: DataFrame) -> DataFrame:
    """Edges (src, dst) from pages (doc_id, url, links); links to no known page are dropped. [JN5, SRC2]"""
    out = pages.select(F.col("doc_id").alias("src"), F.explode("links").alias("url"))
    return out.join(pages.select("url", F.col("doc_id").alias("dst")), "url").select("src", "dst").distinct()


def backlinks(edges: DataFrame, pages: DataFrame, target: object) -> DataFrame:
    """Pages that link to the target, by falling PageRank. [JN11]"""
    return edges.where(F.col("dst") == F.lit(target)).join(pages, F.col("src") == F.col("id")).orderBy(F.desc("score"), F.asc("id"))
