"""Answers drawn from ranked documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions import lexicon as L
from quillmere.functions import text as T


def classify(query: Column) -> Column:
    """(kind, confidence), kinds in order; FACT 0.5 where none fits. [STR19]"""
    q = F.trim(F.lower(query))
    kind = reduce(lambda case, k: case.when(q.rlike(k[2]), k[0]), L.ANSWER_KINDS, F).otherwise("FACT")
    confidence = reduce(lambda case, k: case.when(q.rlike(k[2]), k[1]), L.ANSWER_KINDS, F).otherwise(0.5)
    return F.struct(kind.alias("kind"), confidence.alias("confidence"))


def verified(url: Column) -> Column:
    """[FLT11]"""
    return T.any_of(F.lower(url), L.VERIFIED)


def agency(url: Column) -> Column:
    """[STR24]"""
    return reduce(lambda case, k: case.when(url.contains(k), L.AGENCY_NAMES[k]), L.AGENCY_NAMES, F).otherwise("Myndighet")


def _quoted(text: Column) -> Column:
    """Text as a literal pattern."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def _extract(text: Column, pattern: Column, group: int) -> Column:
    """regexp_extract by a pattern that is a column."""
    return F.call_function("regexp_extract", text, pattern, F.lit(group))


def _sentence(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))


def definition(query: Column, content: Column) -> Column:
    """The first sentence that says what the asked-for term is; always given with "är". [STR20]"""
    asked = L.ASKED_DEFINITION
    term = F.trim(F.regexp_extract(F.lower(query), asked, 1))
    found = [_extract(content, F.concat(F.lit("(?iu)"), _quoted(term), F.lit(rf" {verb} ([^\.]+\.)")), 1) for verb in L.DEFINITION_VERBS]
    first = F.coalesce(*[F.when(x != "", x) for x in found])
    return F.when(F.lower(query).rlike(asked) & first.isNotNull(), F.concat(_sentence(term), F.lit(" är "), first))


def procedure(content: Column) -> Column:
    """The first five of three or more numbered steps, and how many more there are. [STR21]"""
    pattern = L.STEP
    numbers, texts = (F.regexp_extract_all(content, F.lit(pattern), F.lit(k)) for k in (1, 2))
    steps = F.zip_with(numbers, texts, lambda n, t: F.concat(n, F.lit(". "), F.trim(t)))
    more = F.when(F.size(steps) > 5, F.concat(F.lit("\n\n(+ "), (F.size(steps) - 5).cast("string"), F.lit(" fler steg)"))).otherwise("")
    return F.when(F.size(steps) >= 3, F.concat(F.array_join(F.slice(steps, 1, 5), "\n"), more))


def comparison(query: Column, content: Column) -> Column:
    """The passage that sets the two asked-for terms against each other. [STR22]"""
    asked = L.ASKED_COMPARISON
    a, b = (F.trim(F.regexp_extract(F.lower(query), asked, k)) for k in (1, 2))
    patterns = [
        F.concat(F.lit("(?iu)skillnad(?:en)? mellan "), _quoted(a), F.lit(" och "), _quoted(b), F.lit(r" (?:är|innebär) ([^\.]+\.)")),
        F.concat(F.lit("(?iu)"), _quoted(a), F.lit(r" ([^\.]*?) medan "), _quoted(b), F.lit(r" ([^\.]+\.)")),
    ]
    found = F.coalesce(*[F.nullif(_extract(content, p, 0), F.lit("")) for p in patterns])
    return F.when(F.lower(query).rlike(asked) & found.isNotNull(), F.concat(F.lit("Skillnaden mellan "), a, F.lit(" och "), b, F.lit(":\n\n"), found))


def official_paragraph(url: Column, content: Column) -> Column:
    """The first paragraph of over 50 characters of a verified source, cut at 500. [STR23]"""
    first = F.try_element_at(F.filter(F.transform(F.split(content, "\n\n"), F.trim), lambda p: F.length(p) > 50), F.lit(1))
    return F.when(verified(url) & first.isNotNull(), F.concat(F.substring(first, 1, 500), F.when(F.length(first) > 500, "...").otherwise("")))


def best_answers(ranked: DataFrame) -> DataFrame:
    """One answer a query from its ranked documents (query_id, query, rank, url, title, content). [STR25, TOP9]

    Definitions and procedures look at the first document, comparisons at five,
    other kinds at ``.gov.se`` documents among the first three. min_by keeps the best-ranked one, added up before the shuffle.
    """
    kind = classify(F.col("query"))
    near = ranked.where(F.col("rank") <= 5).withColumn("kind", kind["kind"])
    top, gov = F.col("rank") == 1, (F.col("rank") <= 3) & F.col("url").contains(".gov.se")
    text = (
        F.when(F.col("kind") == "DEFINITION", F.when(top, definition(F.col("query"), F.col("content"))))
        .when(F.col("kind") == "PROCEDURE", F.when(top, procedure(F.col("content"))))
        .when(F.col("kind") == "COMPARISON", comparison(F.col("query"), F.col("content")))
        .otherwise(F.when(gov, official_paragraph(F.col("url"), F.col("content"))))
    )
    sure = F.when(F.col("kind") == "DEFINITION", 0.8).when(F.col("kind") == "PROCEDURE", 0.75).when(F.col("kind") == "COMPARISON", 0.7).otherwise(0.95)
    given = F.when(F.col("kind").isin("DEFINITION", "PROCEDURE", "COMPARISON"), F.col("kind")).otherwise("GOVERNMENT")
    rows = near.withColumn("answer", text).where(F.col("answer").isNotNull())
    box = F.struct(given.alias("kind"), "answer", sure.alias("confidence"), "url", "title", verified(F.col("url")).alias("verified"), agency(F.col("url")).alias("agency"))
    return rows.groupBy("query_id").agg(F.min_by(box, "rank").alias("box")).select("query_id", "box.*")


def answer_json(answer: DataFrame) -> DataFrame:
    """[PRJ14]"""
    body = F.struct(F.col("kind").alias("type"), "answer", F.struct("url", "title").alias("source"), "confidence", "verified", F.lit(None).cast("string").alias("last_updated"))
    return answer.select("query_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))
