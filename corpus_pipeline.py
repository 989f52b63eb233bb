"""A training corpus from documents: five stages, each over all that the one before kept."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.common import durable, remove_path, scratch_path, swept, table, whole_row
from quillmere.llm.decontaminate import find_items
from quillmere.llm.language_id import identify, train_profiles
from quillmere.llm.line_dedup import drop_frequent_lines
from quillmere.llm.near_dedup import near_duplicates
from quillmere.llm.packing import pack_documents
from quillmere.llm.vocabularies import vocabulary_path

#: Ids of documents to drop that may be broadcast, 8 bytes each; more are joined.
BROADCAST_IDS = 1_000_000
#: What a text with words in it holds.
WORDS = r"[\p{L}\p{N}]"
#: Words of the shortest benchmark item that is looked for inside documents: a shorter one is in any number of clean documents, so it must be all that a document says.
LEAST_ITEM = 6
#: A text of fewer words than that, and at least one; longer ones fail at the word too many.
FEW_WORDS = rf"^[^\p{{L}}\p{{N}}]*+(?:[\p{{L}}\p{{N}}]++[^\p{{L}}\p{{N}}]++){{0,{LEAST_ITEM - 2}}}[\p{{L}}\p{{N}}]++[^\p{{L}}\p{{N}}]*+$"
#: Length class from which the cosine decides, and labelled scores that a class needs for a median of its own.
LEAST_CLASS, CLASS_SCORES = 5, 30


def _keyed(docs: DataFrame) -> DataFrame:
    """(_whole, text, _key): the row, its text, and a whole number that only rows alike in doc_id and text share.

    It is the doc_id, but for rows that have none, or share theirs with another text: those get numbers
    beyond all doc_ids, each distinct (doc_id, text) its own. A null text counts as empty.
    """
    whole, doc_id, text = whole_row(docs).alias("_whole"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = {"_i": doc_id, "_h": F.xxhash64(text), "_c": F.crc32(text.cast("binary")), "_n": F.length(text)}
    ids = docs.select(*[c.alias(x) for x, c in same.items()])
    spread = ids.groupBy("_i").agg(F.min("_h").alias("low"), F.max("_h").alias("high"))
    odd = durable(spread.where("_i is null or low <> high").select(F.col("_i").alias("_odd")))
    if not odd.limit(1).count():
        return docs.select(whole, "text", doc_id.alias("_key"))
    kinds = ids.join(odd, ids["_i"].eqNullSafe(odd["_odd"]), "left_semi").distinct()
    top = docs.agg(F.max(doc_id)).first()[0] or 0
    numbers = durable(kinds.select(*[F.col(x).alias(f"{x}2") for x in same], F.monotonically_increasing_id().alias("_own")))
    if top + numbers.agg(F.max("_own")).first()[0] >= 2**63 - 1:
        raise ValueError("doc_ids leave no numbers beyond them")
    numbers = F.broadcast(numbers) if numbers.count() <= BROADCAST_IDS else numbers
    wide = docs.select(whole, "text", *[c.alias(x) for x, c in same.items()])
    hit = wide["_i"].eqNullSafe(numbers["_i2"])
    for x in ("_h", "_c", "_n"):
        hit &= wide[x] == numbers[f"{x}2"]
    return wide.join(numbers, hit, "left").select("_whole", "text", F.coalesce(F.col("_own") + F.lit(top + 1), "_i").alias("_key"))


def _rows(keyed: DataFrame, docs: DataFrame) -> DataFrame:
    return keyed.select(*[F.col("_whole")[c].alias(c) for c in docs.columns])


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is not among ``keys`` (one column, ``_drop``)."""
    keys = durable(keys.distinct())
    dropped = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    return keyed.join(dropped, keyed["_key"] == dropped["_drop"], "left_anti")


def _once(keyed: DataFrame) -> DataFrame:
    """One row of each key; any one of rows that differ in other columns."""
    again = durable(keyed.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_key").alias("_drop")))
    n = again.count()
    if not n:
        return keyed
    again = F.broadcast(again) if n <= BROADCAST_IDS else again
    hit = keyed["_key"] == again["_drop"]
    return keyed.join(again, hit, "left_anti").unionByName(keyed.join(again, hit, "left_semi").dropDuplicates(["_key"]))


def _texts(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col("_key").alias("doc_id"), "text")


def _length_class(text: Column) -> Column:
    """Binary logarithm of the text's characters, cut to a whole number: 5 for 32 to 63. Characters that are no letters count, a run of white space as one."""
    return F.floor(F.log2(F.greatest(F.length(F.regexp_replace(text.cast("string"), r"\s+", " ")), F.lit(1)))).cast("int")


def least_scores(docs: DataFrame, profiles: tuple[list[str], np.ndarray]) -> dict[int, float]:
    """For each length class the score a text of it needs: a quarter of the median score of all labelled rows of that class.

    Copies have one score, so each score counts once. A class of fewer than ``CLASS_SCORES`` scores takes what the next
    shorter one needs, as longer texts score higher. Classes under ``LEAST_CLASS`` are left out.
    """
    scored = identify(docs.where("lang is not null").select("text"), profiles).where(F.col("lang_pred") != "und")
    scores = scored.select(_length_class(F.col("row.text")).alias("class"), F.round("score", 6).alias("score")).where(F.col("class") >= LEAST_CLASS).distinct()
    least, found = 0.0, {}
    medians = scores.groupBy("class").agg(F.count("*").alias("n"), F.percentile_approx("score", 0.5, 10_000).alias("median"))
    for r in sorted(medians.collect()):
        if r["n"] >= CLASS_SCORES:
            least = r["median"] / 4
        found[r["class"]] = least
    return found


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those with a letter whose cosine with the best language is not far under what labelled texts of their length have.

    Null texts and those without a letter go. Rows are judged by their text alone, repeated ones alike; doc_id and other
    columns make no difference, a null lang only means that the row teaches nothing. No documents give none. Texts under 32 characters have too few n-grams for the cosine to tell, so a letter is enough.
    So it is for every text where no row has both a lang and a letter, as there is no language to compare with.
    """
    profiles = train_profiles(docs.select("text", "lang"))
    if not profiles[0]:
        # A prototype of zeros: any text with a letter gets its name, with score 0.
        anything = (["any"], np.zeros((1, profiles[1].shape[1])))
        return identify(docs, anything).where(F.col("lang_pred") != "und").select(*[F.col("row")[c].alias(c) for c in docs.columns])
    found = identify(docs, profiles).where(F.col("lang_pred") != "und")
    known = least_scores(docs, profiles)
    # By length class; one without a score takes that of the next shorter one. The class is worked out once a text.
    needs = [known[max((k for k in known if k <= c), default=c)] if any(k <= c for k in known) else 0.0 for c in range(64)]
    need = F.get(F.array(*[F.lit(float(x)) for x in needs]), _length_class(F.col("row.text")))
    return found.where(F.col("score") >= need).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents share; the first of those keeps its line.

    A group of near duplicates counts as the one document that near dedup keeps, and rows alike in doc_id and
    text as one, so that copies make no line frequent and reach near dedup whole. A document that had letters or digits
    and has none left is dropped; every other stays, empty and null texts too (a null text becomes empty). Rows with a
    null doc_id, or texts that share one, are documents of their own. No documents give none.
    """
    keyed = _keyed(docs)
    copies = near_duplicates(_texts(keyed)).where(~F.col("kept")).select(F.col("doc_id").alias("_drop"))
    counted = _texts(_once(_without(keyed, copies)))
    # The operator knows a document by its doc_id, so the key goes by that name there.
    named = keyed.select(F.col("_key").alias("doc_id"), "text", "_whole")
    found = drop_frequent_lines(named, min_docs=10, keep_first=True, counted=counted)
    emptied = (F.col("n_dropped") > 0) & F.coalesce(F.col("row.text").rlike(WORDS), F.lit(False)) & ~F.col("text").rlike(WORDS)
    found = found.where(~emptied)
    renewed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*[renewed[c].alias(c) if c in renewed else F.col("row._whole")[c].alias(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and all that are in none.

    The one with the smallest doc_id stays (rows without a doc_id, and texts that share one, come after all others).
    Of rows alike in doc_id and text one stays. Texts without words are in no group. No documents give none.
    """
    keyed = _keyed(docs)
    found = near_duplicates(_texts(keyed))
    return _rows(_once(_without(keyed, found.where(~F.col("kept")).select(F.col("doc_id").alias("_drop")))), docs)


def _said(text: Column) -> Column:
    """The words of a text in lower case, one space between; null where it has ``LEAST_ITEM`` of them or more, or none."""
    return F.when(text.rlike(FEW_WORDS), F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " "))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, and are none of fewer words than are looked for inside documents.

    Each row is judged by its own text, whatever its doc_id; repeated rows stay or go together, null and empty texts
    stay, and so do all rows where there are no items. No documents give none.
    """
    keyed = _keyed(docs)
    items = table(spark, sf_dir, "benchmark")
    found = find_items(_texts(keyed), items, least_words=LEAST_ITEM).select(F.col("doc_id").alias("_drop"))
    short = items.select(_said(F.col("text")).alias("_item")).where("_item is not null").distinct()
    brief = keyed.select(_said(F.col("text")).alias("_say"), F.col("_key").alias("_drop")).where("_say is not null")
    found = found.unionByName(brief.join(short, F.col("_say") == F.col("_item"), "left_semi").select("_drop"))
    return _rows(_without(keyed, found), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens, as op1 gives them.

    Null texts are empty and give one piece, repeated and null doc_ids are packed row by row, ties between pieces of one
    length go any way. No documents give no rows.
    """
    return pack_documents(docs, vocabulary_path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Between stages documents are written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_path(spark, before)
        docs, before = spark.read.parquet(path), path
        swept(spark)
    # Packing has kept what it needs of the texts when it returns.
    packed = STAGES[-1][1](spark, docs, sf_dir)
    remove_path(spark, before)
    return packed


#: Learned profiles and a tokenizer library, which SQL has none of.
ORACLE_SQL = None
