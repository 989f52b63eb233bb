"""The seven factors of a result's rank, each an expression, and their weighted sum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions import lexicon as L
from quillmere.operators.index import top_per_query
from quillmere.shared import durable

#: Candidates whose ids are broadcast to pick out their rows, 8 bytes each; more are joined.
BROADCAST_CANDIDATES = 1_000_000


def authority(domain: Column, table: dict[str, float] = L.AUTHORITY) -> Column:
    """An exact domain's boost, else that of the first suffix in order, else 1. [PRJ9, JN6]"""
    exact = reduce(lambda case, k: case.when(domain == k, table[k]), table, F)
    return reduce(lambda case, k: case.when(domain.endswith(k), table[k]), table, exact).otherwise(1.0)


def authority_factor(boost: Column) -> Column:
    """[MTH4]"""
    return F.least(F.lit(1.0), boost / 3.5)


def tfidf_factor(score: Column, n_terms: Column) -> Column:
    """[MTH2]"""
    return F.least(F.lit(1.0), F.when(n_terms > 0, score / n_terms).otherwise(0.0) / 10)


def age_days(moment: Column, as_of: Column) -> Column:
    """Whole days, rounded down. [DT2]"""
    return F.floor((F.unix_seconds(as_of) - F.unix_seconds(moment)) / 86400)


def parse_moment(value: Column) -> Column:
    """A timestamp from ISO text, null where it is none. [DT1]"""
    return F.try_to_timestamp(value)


def recency_factor(moment: Column, as_of: Column) -> Column:
    """exp(-age / 365); 0.5 for an unknown date. [MTH5]"""
    return F.coalesce(F.exp(-age_days(moment, as_of) / L.DECAY_DAYS), F.lit(0.5))


def density_factor(terms: Column, title: Column, snippet: Column) -> Column:
    """Three for a term in the title and one in the snippet, of four for each term. [MTH6]"""
    points = F.aggregate(terms, F.lit(0), lambda a, t: a + F.when(F.lower(title).contains(t), 3).otherwise(0) + F.when(F.lower(snippet).contains(t), 1).otherwise(0))
    return F.when(F.size(terms) > 0, F.least(F.lit(1.0), points / (F.size(terms) * 4))).otherwise(0.0)


def structure_factor(links: Column) -> Column:
    """5 to 50 links are best; 0.3 where nothing is known. [MTH7]"""
    return F.when(links.isNull(), 0.3).when(links < 5, links / 5).when(links <= 50, 1.0).otherwise(50 / links)


def language_factor(domain: Column, title: Column) -> Column:
    """[MTH8]"""
    score = F.when(domain.endswith(".se"), 0.5).otherwise(0.0) + F.when(F.lower(title).rlike("[åäö]"), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), score + F.when(domain.contains(".gov.se") | domain.contains("riksdag"), 0.2).otherwise(0.0))


def final_score(factors: dict[str, Column], weights: dict[str, float] = L.WEIGHTS) -> Column:
    """Weighted sum on 0 to 100. [MTH9]"""
    total = reduce(lambda a, b: a + b, [factors[k] * w for k, w in weights.items()])
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def rank(candidates: DataFrame, documents: DataFrame, pagerank: DataFrame, out_links: DataFrame, queries: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    """Ranked hits of candidates (query_id, doc_id, score). [JN2, JN4, PRJ11, TOP2]

    ``documents`` has doc_id, url, domain, title, snippet, crawled_at, authority;
    ``pagerank`` doc_id, pagerank; ``out_links`` doc_id, links; ``queries`` query_id, terms.
    Candidates without a document are dropped; a missing PageRank is 0.1. ``factors`` holds each factor on 0 to 100.
    """
    held = durable(candidates.select("query_id", "doc_id", "score"))
    if held.count() <= BROADCAST_CANDIDATES:
        # So the tables are read once and what is shuffled of them is what the candidates need.
        ids = F.broadcast(durable(held.select("doc_id").distinct()))
        documents, pagerank, out_links = (t.join(ids, "doc_id", "left_semi") for t in (documents, pagerank, out_links))
    joined = held.join(documents, "doc_id").join(pagerank, "doc_id", "left").join(out_links, "doc_id", "left").join(queries, "query_id")
    factors = {
        "tf_idf": tfidf_factor(F.col("score"), F.size("terms")),
        "pagerank": F.coalesce("pagerank", F.lit(0.1)),
        "authority": authority_factor(F.col("authority")),
        "recency": recency_factor(F.col("crawled_at"), as_of),
        "density": density_factor(F.col("terms"), F.col("title"), F.col("snippet")),
        "structure": structure_factor(F.col("links")),
        "language": language_factor(F.col("domain"), F.col("title")),
    }
    scored = joined.select("query_id", "doc_id", "url", "title", "snippet", *[c.alias(f"f_{k}") for k, c in factors.items()])
    scored = scored.withColumn("final", final_score({k: F.col(f"f_{k}") for k in factors}))
    shown = F.struct(*[F.round(F.col(f"f_{k}") * 100, 1).alias(k) for k in factors])
    return top_per_query(scored, limit, "final").select("query_id", "rank", "doc_id", "url", "title", "snippet", F.round("final", 2).alias("score"), shown.alias("factors"))


def combined_authority(boost: Column, pagerank: Column) -> Column:
    """[MTH18, TOP8]"""
    return 0.5 * boost + 0.5 * pagerank


def backoff(attempt: Column, base: float = 1.0, factor: float = 2.0, most: float = 60.0) -> Column:
    """[MTH17]"""
    return F.least(base * F.pow(F.lit(factor), attempt - 1), F.lit(most))


def safe_divide(a: Column, b: Column) -> Column:
    """0 where the divisor is. [MTH19]"""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def throughput_mb(size: Column, ms: Column) -> Column:
    """[MTH20]"""
    return size / (ms / 1000) / (1 << 20)
