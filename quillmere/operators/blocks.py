"""Postings in blocks with bounds, so that a search reads the blocks that can matter and leaves the others on disk.

Documents are put into blocks of like length, about the same number to each. Of every term and block the table of bounds has the highest weight that
the term gives a document there, without its idf. A search adds the bounds of a query's terms block by block, scores the blocks that promise most
until as many documents as are wanted have a score, and then only such further blocks whose bounds reach the lowest of those scores: what
is left out cannot be among the best. Results are those of scoring everything. [JN1, TOP1]
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.operators.index import Index, bm25, holding, top_per_query
from quillmere.shared import durable, local_table

#: Documents of a block on average, and blocks of a query whose numbers go to the scan as a filter; more are joined.
PER_BLOCK, FILTER_BLOCKS = 32, 2000


def weight(tf: Column, dl: Column, average: float, k1: float = 1.5, b: float = 0.75) -> Column:
    """BM25 without the idf, which is one number a term. [MTH10]"""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average))


@dataclass
class BlockIndex:
    """``postings`` (term, block, doc_id, tf, dl) and ``bounds`` (term, block, bound, n), both in the order of term and block; ``terms`` (term, df)."""

    postings: DataFrame
    bounds: DataFrame
    terms: DataFrame
    n: int
    average: float

    @classmethod
    def save(cls, index: Index, path: str, per_block: int = PER_BLOCK) -> BlockIndex:
        """Writes the postings of an index in blocks."""
        spark = index.postings.sparkSession
        # A document's frequencies add up to its length, so those of all documents of a length, divided by it, are their number: no document is looked for.
        lengths = index.postings.groupBy("dl").agg(F.greatest(F.lit(1), F.ceil(F.sum("tf") / F.col("dl"))).alias("_docs"))
        # One row for each length that occurs, which the longest document bounds.
        before = F.coalesce(F.sum("_docs").over(Window.orderBy("dl").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        places = durable(lengths.withColumn("_before", before))
        # Numbers rise with the length; which of a length lie together is up to a hash, so neither ranks nor joins of documents are needed.
        block = F.floor((F.col("_before") + F.pmod(F.xxhash64("doc_id"), F.col("_docs"))) / per_block)
        post = index.postings.join(F.broadcast(places), "dl").select("term", block.alias("block"), "doc_id", "tf", "dl")
        # Rows of a term and block lie together in one task, so its bound stands on one of its rows: no aggregate has to hold all terms and blocks of a task.
        group = Window.partitionBy("term", "block")
        first = F.col("doc_id") == F.min("doc_id").over(group)
        highest = F.max(weight(F.col("tf"), F.col("dl"), index.average)).over(group)
        placed = post.repartitionByRange(index.tasks(), "term", "block").withColumns({"bound": F.when(first, highest), "n": F.when(first, F.count("*").over(group))})
        placed.write.option("parquet.block.size", 1 << 20).mode("overwrite").parquet(f"{path}/postings")
        firsts = spark.read.parquet(f"{path}/postings").where(F.col("n").isNotNull())
        firsts.select("term", "block", "bound", "n").write.option("parquet.block.size", 1 << 20).mode("overwrite").parquet(f"{path}/bounds")
        index.terms.select("term", "df").repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        local_table(spark, {"n": [index.n], "average": [index.average]}, "n long, average double").write.mode("overwrite").parquet(f"{path}/about")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BlockIndex:
        about = spark.read.parquet(f"{path}/about").first()
        post, bounds, terms = (spark.read.parquet(f"{path}/{x}") for x in ("postings", "bounds", "terms"))
        return cls(post.select("term", "block", "doc_id", "tf", "dl"), bounds, terms, about["n"], about["average"])


def _idf(index: BlockIndex, queries: DataFrame) -> DataFrame:
    """(query_id, term, idf, times): a term that a query repeats counts each time."""
    idf = F.log((F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    known = holding(index.terms, queries).select("term", "df", idf.alias("idf"))
    return queries.groupBy("query_id", "term").agg(F.count("*").alias("times")).join(known, "term").select("query_id", "term", "df", "idf", "times")


def _scored(index: BlockIndex, asked: DataFrame, chosen: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of the documents in the chosen (query_id, block)."""
    found = holding(index.postings, asked)
    few = [r[0] for r in chosen.select("block").distinct().limit(FILTER_BLOCKS + 1).collect()]
    found = found.where(F.col("block").isin(few)) if len(few) <= FILTER_BLOCKS else found
    hits = found.join(asked, "term").join(chosen.select("query_id", "block"), ["query_id", "block"])
    score = F.col("times") * bm25(F.col("tf"), F.col("dl"), F.lit(index.average), F.col("df"), F.lit(index.n))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(score).alias("score"))


def search(index: BlockIndex, queries: DataFrame, limit: int = 10, first: int = 8) -> tuple[DataFrame, DataFrame]:
    """The hits (query_id, doc_id, score, rank) of ``search_bm25``, and what was read for them (query_id, postings, read).

    ``first``: how many times the blocks that could hold ``limit`` documents are scored before the others are judged; it changes nothing but what is read.
    """
    asked = durable(_idf(index, queries))
    of_query = holding(index.bounds, asked).join(asked, "term")
    # One row for each query and block. A document that several terms hold is counted by the largest of them.
    blocks = durable(of_query.groupBy("query_id", "block").agg(F.sum(F.col("bound") * F.col("idf") * F.col("times")).alias("most"), F.max("n").alias("docs"), F.sum("n").alias("postings")))
    best = top_per_query(blocks.withColumnRenamed("block", "doc_id"), limit * first, "most").withColumnRenamed("doc_id", "block")
    # Blocks in the order of their promise, until those before hold enough documents.
    before = F.sum("docs").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    seeds = durable(best.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < limit * first).select("query_id", "block", "postings"))
    sure = durable(_scored(index, asked, seeds))
    ranked = top_per_query(sure, limit)
    floor = ranked.groupBy("query_id").agg(F.when(F.count("*") == limit, F.min("score")).alias("_floor"))
    others = blocks.join(seeds.select("query_id", "block"), ["query_id", "block"], "left_anti").join(F.broadcast(floor), "query_id", "left")
    # Sums of floating point numbers may differ in the last digits.
    rest = durable(others.where(F.col("_floor").isNull() | (F.col("most") >= F.col("_floor") - 1e-9)).select("query_id", "block", "postings"))
    more = _scored(index, asked, rest) if rest.limit(1).count() else sure.limit(0)
    every = sure.unionByName(more)
    used = seeds.unionByName(rest).groupBy("query_id").agg(F.sum("postings").alias("read"))
    report = blocks.groupBy("query_id").agg(F.sum("postings").alias("postings")).join(used, "query_id", "left")
    return top_per_query(every, limit), report.select("query_id", "postings", F.coalesce("read", F.lit(0)).alias("read"))
