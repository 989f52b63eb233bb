"""Pages end to end: fields from the markup, an index of the texts, the graph of the links with its PageRank, and a search that ranks by all seven factors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.operators import graph, pages, ranking
from quillmere.operators.index import Index, candidate_limit, query_table, search_tfidf
from quillmere.shared import durable


@dataclass
class Site:
    """``documents`` (doc_id, url, domain, title, snippet, crawled_at, authority, links), an index of their texts and their ``ranks`` (doc_id, pagerank)."""

    documents: DataFrame
    index: Index
    ranks: DataFrame

    @classmethod
    def build(cls, crawled: DataFrame, stemmed: bool = True) -> Site:
        """From crawled pages (page_id, url, html, and crawled_at where it is known).

        Pages without an id are left out. Of pages with one text the newest (the largest page_id) stands for all; a link to any of them counts for it.
        The markup is read once.
        """
        when = F.col("crawled_at").cast("timestamp") if "crawled_at" in crawled.columns else F.lit(None).cast("timestamp")
        rows = crawled.where("page_id is not null").select(F.col("page_id").cast("long").alias("doc_id"), "url", when.alias("crawled_at"), pages.fields(F.col("html"), F.col("url")).alias("f"))
        read = durable(rows.select("doc_id", "url", "crawled_at", F.coalesce("f.content", F.lit("")).alias("text"), pages.crawled_links(F.col("f"), F.col("url")).alias("links"), pages.named(F.col("f")).alias("title")))
        kept = read.groupBy(F.md5("text").alias("hash")).agg(F.max("doc_id").alias("newest"))
        # A text has as many rows as it has copies; the join carries ids and the hash alone.
        placed = durable(read.select("doc_id", "url", F.md5("text").alias("hash")).join(kept, "hash").select("doc_id", "url", "newest"))
        whole = read.join(placed.where("doc_id = newest").select("doc_id"), "doc_id", "left_semi")
        domain = pages.host(F.col("url"))
        documents = durable(whole.select("doc_id", "url", domain.alias("domain"), "title", F.substring("text", 1, 200).alias("snippet"), "crawled_at", ranking.authority(domain).alias("authority"), F.size("links").alias("links")))
        targets = placed.groupBy("url").agg(F.max("newest").alias("dst"))
        out = whole.select(F.col("doc_id").alias("src"), F.explode("links").alias("url")).join(targets, "url").select("src", "dst").distinct()
        ranks = graph.pagerank(documents.select(F.col("doc_id").alias("id")), out)
        return cls(documents, Index.build(whole.select("doc_id", "text"), stemmed=stemmed), ranks.select(F.col("id").alias("doc_id"), F.col("score").alias("pagerank")))

    def save(self, path: str) -> Site:
        self.documents.write.mode("overwrite").parquet(f"{path}/pages")
        self.ranks.write.mode("overwrite").parquet(f"{path}/ranks")
        self.index.save(f"{path}/index")
        return self.load(self.documents.sparkSession, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Site:
        return cls(spark.read.parquet(f"{path}/pages"), Index.load(spark, f"{path}/index"), spark.read.parquet(f"{path}/ranks"))

    def search(self, queries: dict[int, list[str]], as_of: Column, limit: int = 10) -> DataFrame:
        """(query_id, rank, doc_id, url, title, snippet, score, factors) of each query's best pages. [PRJ11, JN2, JN4, MTH2-MTH9, TOP2]"""
        spark = self.documents.sparkSession
        found = search_tfidf(self.index, query_table(spark, queries), candidate_limit(limit), cap=None)
        asked = spark.createDataFrame(list(queries.items()), "query_id long, terms array<string>")
        return ranking.rank(found, self.documents.drop("links"), self.ranks, self.documents.select("doc_id", "links"), asked, as_of, limit)
