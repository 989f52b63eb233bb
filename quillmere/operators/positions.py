"""Positional postings, trees of words, phrases, AND, OR and NOT over them, and a rank by how close the words stand.

A posting is (term, doc_id, positions), positions counting all tokens of the document from 0. A batch of trees is one plan: the scan gives
the postings of all their words, one shuffle brings a document's postings together, and every tree is an expression over
them. [STR37]
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import text as T
from quillmere.operators.index import top_per_query


@dataclass(frozen=True)
class Word:
    """Documents with a term."""

    term: str


@dataclass(frozen=True)
class Phrase:
    """Documents with terms one right after the other."""

    terms: tuple[str, ...]


@dataclass(frozen=True)
class All:
    """Documents that each part matches."""

    parts: tuple


@dataclass(frozen=True)
class Any:
    """Documents that some part matches."""

    parts: tuple


@dataclass(frozen=True)
class Not:
    """Documents that the part does not match."""

    part: object


Tree = Word | Phrase | All | Any | Not


def words_of(tree: Tree, positive: bool = False) -> list[str]:
    """The tree's terms in order, each once; with ``positive`` only those that are not under a NOT."""

    def walk(node: Tree) -> Iterator[str]:
        match node:
            case Word(term):
                yield term
            case Phrase(terms):
                yield from terms
            case Not(part):
                if not positive:
                    yield from walk(part)
            case _:
                for part in node.parts:
                    yield from walk(part)

    return list(dict.fromkeys(walk(tree)))


def matches_nothing(tree: Tree) -> bool:
    """Whether a document without any of the terms matches, so that no posting leads to it."""
    match tree:
        case Not(part):
            return not matches_nothing(part)
        case All(parts):
            return all(map(matches_nothing, parts))
        case Any(parts):
            return any(map(matches_nothing, parts))
    return False


def positional_postings(docs: DataFrame, stemmed: bool = False, every: bool = True) -> DataFrame:
    """(term, doc_id, positions) of documents (doc_id, text); with ``every`` all tokens are terms, else those that the index takes.

    Null texts have none. Rows of one doc_id have their positions put together.
    """
    tokens = docs.select("doc_id", F.posexplode(T.tokenize(F.col("text"))).alias("position", "token"))
    if not every:
        tokens = tokens.where(F.size(T.remove_stopwords(T.filter_tokens(F.array("token")))) > 0)
    term = T.stem(F.col("token")) if stemmed else F.col("token")
    return tokens.groupBy(term.alias("term"), "doc_id").agg(F.sort_array(F.collect_list("position")).alias("positions"))


def save(post: DataFrame, path: str) -> DataFrame:
    """Written in the order of terms, in small row groups, so that a query's terms as a filter read little."""
    post.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.option("parquet.block.size", 2 << 20).mode("overwrite").parquet(path)
    return post.sparkSession.read.parquet(path)


def _earlier(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def _holds(tree: Tree, at: Column) -> Column:
    """Whether a document with the positions ``at`` (map of term to positions) matches."""
    match tree:
        case Word(term):
            return F.map_contains_key(at, F.lit(term))
        case Phrase(terms):
            # Where the phrase may begin, by each of its terms.
            begins = [_earlier(at[t], k) for k, t in enumerate(terms)]
            return F.coalesce(F.size(reduce(F.array_intersect, begins)) > 0, F.lit(False))
        case Not(part):
            return ~_holds(part, at)
        case All(parts):
            return reduce(lambda a, b: a & b, [_holds(p, at) for p in parts])
        case Any(parts):
            return reduce(lambda a, b: a | b, [_holds(p, at) for p in parts])
    raise TypeError(tree)


def cover_density(words: list[str], at: Column) -> Column:
    """Sum over the covers of words / length; 0 where no word occurs.

    A cover is a shortest run of tokens with all of ``words`` that the document has, one that holds no shorter one; words that stand
    side by side count 1, wider covers the less. One word counts as often as it occurs.
    """
    present = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.map_contains_key(at, w))
    events = F.array_sort(F.flatten(F.transform(present, lambda w, i: F.transform(F.element_at(at, w), lambda p: F.struct(p.alias("p"), i.alias("i"))))))
    start = F.struct(F.transform(present, lambda _: F.lit(-1)).alias("last"), F.lit(-1).alias("begin"), F.lit(0.0).alias("sum"))

    def step(a: Column, e: Column) -> Column:
        last = F.transform(a["last"], lambda x, j: F.when(j == e["i"], e["p"]).otherwise(x))
        begin = F.array_min(last)
        shorter = begin > a["begin"]
        return F.struct(last.alias("last"), F.when(shorter, begin).otherwise(a["begin"]).alias("begin"), (a["sum"] + F.when(shorter, F.size(present) / (e["p"] - begin + 1)).otherwise(0.0)).alias("sum"))

    return F.aggregate(events, start, step, lambda a: a["sum"])


def search(post: DataFrame, trees: dict[int, Tree], documents: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank) of each tree's best documents by cover density, ties to the smaller doc_id.

    ``documents`` (doc_id) is needed only where a tree matches documents that have none of its terms; those score 0. No trees give no rows.
    """
    terms = sorted({w for tree in trees.values() for w in words_of(tree)})
    hit = post.where(F.col("term").isin(terms)).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    if any(matches_nothing(tree) for tree in trees.values()):
        if documents is None:
            raise ValueError("a tree matches documents without its terms: pass documents")
        empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<int>>"))
        hit = documents.select("doc_id").where("doc_id is not null").distinct().join(hit, "doc_id", "left").select("doc_id", F.coalesce("at", empty).alias("at"))
    found = None
    for number, tree in trees.items():
        positive = words_of(tree, positive=True)
        score = cover_density(positive, F.col("at")) if positive else F.lit(0.0)
        one = F.when(_holds(tree, F.col("at")), F.struct(F.lit(number).cast("long").alias("query_id"), score.alias("score")))
        found = [one] if found is None else [*found, one]
    rows = hit.select("doc_id", F.explode(F.filter(F.array(*(found or [F.lit(None).cast("struct<query_id:bigint,score:double>")])), lambda x: x.isNotNull())).alias("q"))
    return top_per_query(rows.select("q.query_id", "doc_id", "q.score"), limit)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
