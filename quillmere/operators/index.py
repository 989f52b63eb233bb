"""Inverted index: documents, postings and term statistics as tables, and searches over them.

A posting is a row (term, doc_id, tf, dl), dl being the document's length, which saves scores a join. Nothing nests
postings, so a frequent term is many rows in many partitions. Aggregates are partial before each
shuffle. Queries come as a table (query_id, term), so one plan answers a batch.

A saved index has its postings in the order of terms, in small row groups; the terms of a batch of queries go to the scan
as a filter, which reads the row groups that hold them.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.functions import lexicon as L
from quillmere.functions import text as T
from quillmere.shared import local_table, partitions_of, remove_path, whole_row

#: Distinct terms of a batch of queries that go to the scan as a filter; more are joined.
FILTER_TERMS = 1000

#: Tokens whose postings one task sorts when an index is saved.
TASK_TOKENS = 1 << 21


def collapse_copies(docs: DataFrame, content: str = "text", newest: str = "doc_id") -> DataFrame:
    """One row for each content hash, the newest one. [PRJ6, WIN7]

    max_by adds up before the shuffle, so any number of copies is no group in one task.
    """
    hashed = docs.select(F.md5(F.col(content)).alias("content_hash"), whole_row(docs).alias("_row"))
    kept = hashed.groupBy("content_hash").agg(F.max_by("_row", F.struct(F.col("_row")[newest], F.col("_row")[content])).alias("_row"))
    return kept.select("content_hash", *[F.col("_row")[c].alias(c) for c in docs.columns if c != "content_hash"])


def _counted(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, Column]:
    """(doc_id, dl) of the documents, and the (token, tf) of each as an array over them.

    A row is a document. Its tokens are counted where they are: sorted, each run of equal ones is a posting, so that nothing is shuffled or spilled.
    """
    sorted_ = docs.select(F.col(doc_id).alias("doc_id"), F.sort_array(T.terms(F.col(text))).alias("tokens"))
    first = lambda i: (i == 1) | (F.get("tokens", i - 1) != F.get("tokens", i - 2))
    runs = sorted_.select("doc_id", "tokens", F.size("tokens").alias("dl"), F.when(F.size("tokens") > 0, F.filter(F.sequence(F.lit(1), F.size("tokens")), first)).alias("_at"))
    ends = F.concat(F.slice("_at", F.lit(2), F.size("_at")), F.array(F.col("dl") + 1))
    return runs, F.zip_with("_at", ends, lambda a, b: F.struct(F.get("tokens", a - 1).alias("token"), (b - a).cast("long").alias("tf")))


def _termed(counted: DataFrame, stemmed: bool) -> DataFrame:
    """Terms are stemmed once each posting, after counting."""
    if not stemmed:
        return counted.select(F.col("token").alias("term"), "doc_id", "tf", "dl")
    return counted.groupBy(T.stem(F.col("token")).alias("term"), "doc_id", "dl").agg(F.sum("tf").alias("tf")).select("term", "doc_id", "tf", "dl")


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, dl, counts), to be saved: a plan that goes on from ``counts`` unsaved would split the texts for a filter on it too."""
    runs, posting = _counted(docs, doc_id, text)
    return runs.select("doc_id", F.col("dl").cast("long").alias("dl"), posting.alias("counts"))


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stemmed: bool = True) -> DataFrame:
    """(term, doc_id, tf, dl). [AGG1, AGG2]"""
    runs, posting = _counted(docs, doc_id, text)
    return _termed(runs.select("doc_id", F.col("dl").cast("long").alias("dl"), F.inline(posting)), stemmed)


def document_lengths(post: DataFrame) -> DataFrame:
    """[AGG2]"""
    return post.groupBy("doc_id").agg(F.sum("tf").alias("dl"))


def idf_smooth(n: Column, df: Column) -> Column:
    """[AGG5]"""
    return F.log((n + 1) / (df + 1)) + 1


def idf_sql(n: Column, df: Column) -> Column:
    """The relational backend's, without the one added. [AGG6]"""
    return F.log((n + 1) / (df + 1))


def bm25(tf: Column, dl: Column, avgdl: Column, df: Column, n: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """[MTH10]"""
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / avgdl))


def term_statistics(post: DataFrame, n: int, variant=idf_smooth) -> DataFrame:
    """(term, df, idf). [AGG4, AGG7]"""
    return post.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", variant(F.lit(n), F.col("df")))


@dataclass
class Index:
    """The tables, the number of documents, and the mean length of those with terms."""

    documents: DataFrame
    postings: DataFrame
    terms: DataFrame
    n: int
    average: float

    @classmethod
    def build(cls, docs: DataFrame, stemmed: bool = True) -> Index:
        """``documents`` get a ``head``, the text's first 200 characters, which is what hits are shown with."""
        # Sizes are a column of their own, so that they are computed once and not each time an aggregate names them.
        sizes = docs.select(F.explode(F.array(F.size(T.terms(F.col("text"))))).alias("size"))
        n, average = sizes.agg(F.count("*"), F.avg(F.when(F.col("size") > 0, F.col("size")))).first()
        post = postings(docs, stemmed=stemmed)
        return cls(docs.withColumn("head", F.substring("text", 1, 200)), post, term_statistics(post, n), n, average or 0.0)

    def save(self, path: str) -> Index:
        """Writes the tables, postings range-partitioned by term so that a search reads few files; gives the saved index. [SNK3]

        Terms come from the saved postings, so texts are read once.
        """
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        return self._save_rest(path)

    @classmethod
    def written(cls, docs: DataFrame, path: str, stemmed: bool = True) -> Index:
        """What ``build(docs).save(path)`` gives, with ``docs`` computed once and its texts split once: all else is read from what was saved.

        Otherwise the mean length, the ranges of the postings and the postings would each split all texts.
        """
        spark = docs.sparkSession
        docs.withColumn("head", F.substring("text", 1, 200)).write.mode("overwrite").parquet(f"{path}/documents")
        documents = spark.read.parquet(f"{path}/documents")
        token_counts(documents).write.mode("overwrite").parquet(f"{path}/counts")
        counts = spark.read.parquet(f"{path}/counts")
        n, average = counts.agg(F.count("*"), F.avg(F.when(F.col("dl") > 0, F.col("dl")))).first()
        post = _termed(counts.select("doc_id", "dl", F.inline("counts")), stemmed)
        saved = cls(documents, post, term_statistics(post, n), n, average or 0.0)._save_rest(path)
        remove_path(spark, f"{path}/counts")
        return saved

    def _save_rest(self, path: str) -> Index:
        spark = self.documents.sparkSession
        # Half a million postings or so a row group.
        self.postings.repartitionByRange(self.tasks(), "term", "doc_id").sortWithinPartitions("term", "doc_id").write.option("parquet.block.size", 2 << 20).mode("overwrite").parquet(f"{path}/postings")
        saved = spark.read.parquet(f"{path}/postings")
        term_statistics(saved, self.n).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        local_table(spark, {"n": [self.n], "average": [self.average]}, "n long, average double").write.mode("overwrite").parquet(f"{path}/about")
        return self.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """[SRC3]"""
        about = spark.read.parquet(f"{path}/about").first()
        return cls(*(spark.read.parquet(f"{path}/{x}") for x in ("documents", "postings", "terms")), about["n"], about["average"])

    def tasks(self) -> int:
        """Tasks that sort the postings: as many as the tokens ask for, so that what one of them holds does not grow with the index."""
        return max(self.documents.sparkSession.sparkContext.defaultParallelism, ceil(self.n * self.average / TASK_TOKENS))

    def document(self, doc_id: object) -> DataFrame:
        """[SRC4]"""
        return self.documents.where(F.col("doc_id") == F.lit(doc_id))

    def stats(self) -> DataFrame:
        """[AGG3, AGG10]"""
        counts = self.postings.agg(F.count("*").alias("total_postings"), F.coalesce(F.sum("tf"), F.lit(0)).alias("total_terms"))
        terms = self.terms.agg(F.count("*").alias("num_terms"))
        return counts.crossJoin(terms).withColumns({"num_documents": F.lit(self.n).cast("long"), "avg_doc_length": F.lit(self.average)})

    def counts(self, links: DataFrame) -> DataFrame:
        """The relational backend's four counts; documents that have a status must be active. [AGG11, FLT6]"""
        docs = self.documents.where(F.col("status") == "active") if "status" in self.documents.columns else self.documents
        names = {"num_documents": docs, "num_terms": self.terms, "index_entries": self.postings, "page_links": links}
        sums = [df.agg(F.count("*").alias(name)) for name, df in names.items()]  # one row each
        return sums[0].crossJoin(sums[1]).crossJoin(sums[2]).crossJoin(sums[3])

    def verify(self) -> DataFrame:
        """Whether each indexed document exists. [the intent of index verification]"""
        known = self.postings.select("doc_id").distinct().join(self.documents.select("doc_id"), "doc_id", "left_anti")
        return known.agg((F.count("*") == 0).alias("valid"), F.count("*").alias("missing"))


def holding(table: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows of a table of the index whose term some query asks for. [FLT7]"""
    wanted = queries.select("term").distinct()
    few = [r["term"] for r in wanted.limit(FILTER_TERMS + 1).collect()]
    return table.where(F.col("term").isin(few)) if len(few) <= FILTER_TERMS else table.join(wanted, "term", "left_semi")


def capped(post: DataFrame, cap: int) -> DataFrame:
    """Of each term the ``cap`` postings of the highest tf, ties to the smaller id. [WIN1]

    A frequent term is ranked in as many parts as there are partitions first, so that what one task has to rank in the end
    is at most ``cap`` rows a part. Terms of no more postings than the cap, nearly all, are not ranked.
    """
    over = F.broadcast(post.groupBy("term").agg(F.count("*").alias("_n")).where(F.col("_n") > cap).select("term"))
    ranked, rest = post.join(over, "term", "left_semi"), post.join(over, "term", "left_anti")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(partitions_of(post.sparkSession)))
    best = [F.desc("tf"), F.asc("doc_id")]
    part = F.row_number().over(Window.partitionBy("term", "_salt").orderBy(*best))
    some = ranked.withColumn("_salt", salt).withColumn("_rank", part).where(F.col("_rank") <= cap).drop("_salt", "_rank")
    return rest.unionByName(some.withColumn("_rank", F.row_number().over(Window.partitionBy("term").orderBy(*best))).where(F.col("_rank") <= cap).drop("_rank"))


def matching(post: DataFrame, queries: DataFrame, cap: int | None = L.POSTING_CAP) -> DataFrame:
    """(query_id, term, doc_id, tf, dl) of the queries' terms; of a term with more postings than ``cap`` those of the highest tf. [JN1]"""
    found = holding(post, queries)
    return (found if cap is None else capped(found, cap)).join(queries, "term")


def top_per_query(scored: DataFrame, limit: int, score: str = "score") -> DataFrame:
    """The best ``limit`` documents of each query, ties to the smaller id. [TOP1-TOP3]"""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), F.asc("doc_id")))
    return scored.withColumn("rank", rank.cast("int")).where(F.col("rank") <= limit)


def candidate_limit(limit: int) -> int:
    return min(500, max(100, limit * 50))


def search_tfidf(index: Index, queries: DataFrame, limit: int = 100, cap: int | None = L.POSTING_CAP) -> DataFrame:
    """(query_id, doc_id, score, rank): sums of tf * idf; a term that a query repeats counts each time. [AGG8, MTH1, JN3]"""
    hits = matching(index.postings, queries, cap).join(holding(index.terms, queries).select("term", "idf"), "term", "left")
    scored = hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("score"))
    return top_per_query(scored, limit)


def search_relational(index: Index, queries: DataFrame, limit: int = 100) -> DataFrame:
    """Sums of tf_idf * idf, as the relational backend scores. [AGG9, JN9, JN12, FLT7]"""
    idf = holding(index.terms, queries).select("term", idf_sql(F.lit(index.n), F.col("df")).alias("idf"))
    hits = matching(index.postings, queries, None).join(idf, "term")
    scored = hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("tf") * F.col("idf") * F.col("idf")).alias("score"))
    return top_per_query(scored, limit)


def search_bm25(index: Index, queries: DataFrame, limit: int = 100) -> DataFrame:
    """[MTH10]"""
    hits = matching(index.postings, queries, None).join(holding(index.terms, queries).select("term", "df"), "term")
    scored = hits.groupBy("query_id", "doc_id").agg(F.sum(bm25(F.col("tf"), F.col("dl"), F.lit(index.average), F.col("df"), F.lit(index.n))).alias("score"))
    return top_per_query(scored, limit)


def term_view(post: DataFrame, terms: DataFrame) -> DataFrame:
    """Documents and mean frequency of every term, those without postings too. [JN10, AGG12]"""
    joined = terms.select("term").join(post, "term", "left")
    return joined.groupBy("term").agg(F.count("doc_id").alias("doc_count"), F.avg("tf").alias("avg_tf"))


def query_table(spark: SparkSession, queries: dict[int, list[str]]) -> DataFrame:
    rows = [(q, t) for q, ts in queries.items() for t in ts]
    return local_table(spark, {"query_id": [q for q, _ in rows], "term": [t for _, t in rows]}, "query_id long, term string")


def upsert_documents(old: DataFrame, new: DataFrame, key: str = "doc_id", updated: tuple[str, ...] = ("url", "title", "crawled_at")) -> DataFrame:
    """Old and new rows; of a key that both have, the old row with the ``updated`` columns of the new. [SNK4]"""
    renamed = new.select(*[F.col(c).alias(f"_new_{c}") for c in new.columns])
    joined = old.withColumn("_old", F.lit(True)).join(renamed, F.col(key) == F.col(f"_new_{key}"), "full_outer")
    both = F.col("_old") & F.col(f"_new_{key}").isNotNull()
    pick = lambda c: F.when(both & F.lit(c in updated), F.col(f"_new_{c}")).when(F.col("_old"), F.col(c)).otherwise(F.col(f"_new_{c}"))
    return joined.select(*[pick(c).alias(c) for c in old.columns])


def upsert_postings(old: DataFrame, new: DataFrame) -> DataFrame:
    """New frequencies win; old terms of a changed document stay. [SNK4]"""
    fresh = new.select("term", "doc_id", F.col("tf").alias("_tf"))
    return old.join(fresh, ["term", "doc_id"], "full_outer").select("term", "doc_id", F.coalesce("_tf", "tf").alias("tf"))


def nested_index(post: DataFrame) -> DataFrame:
    """(term, map of doc_id to tf), for export; a term's map is one value, so this is for small indexes. [COL9]

    Postings are dealt out by term as they are: lists begun before the shuffle would be sorted and spilled there, as many terms as there are, to be joined only afterwards.
    """
    return post.select("term", "doc_id", "tf").repartition("term").groupBy("term").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_id", "tf")))).alias("docs"))


def flatten_index(nested: DataFrame) -> DataFrame:
    """Postings from the nested form. [SNK10]"""
    return nested.select("term", F.explode("docs").alias("doc_id", "tf"))
