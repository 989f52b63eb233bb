"""Spelling variants: words one edit apart, found through a positional q-gram inverted index with a count filter.

1. Words and how often they occur are counted before anything else, on the JVM: what follows grows with the vocabulary.
2. The inverted index is dealt out in shards. One edit leaves the first half of a word intact or the second, so words meet in
   the shards of their halves: a word of ``L`` code points is in four, the two halves by the shorter length ``m`` of a pair,
   which is ``L`` or ``L - 1``. A shard of more than ``BLOCK`` words is dealt in pairs of blocks, so no task holds a shard.
3. In a shard, the rest of each word (what the shard does not hold in common) has postings for its bigrams with their places, one
   set of lists for each length. A word's lists are heap-merged under the limits that one edit sets: equal length
   and equal place, or one longer and the same place or the next. Who appears often enough, two grams short of all, is
   a candidate, and a candidate is verified.
4. Each word takes its most frequent neighbour as form if that is ten times as frequent; roots come by pointer doubling.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import Scratch, bound_batches, durable, partitions_of, released

#: Code points of the shortest word, occurrences it needs, and how many times as frequent a form is.
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: Words of a shard's block that a task holds of either side.
BLOCK = 4096
#: Shards of more than one block that are broadcast with their number of blocks, a key of at most a word each; more are joined.
BROADCAST_SHARDS = 100_000
#: Bigrams that one edit can change.
GRAM, TOUCHED = 2, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: Column) -> Column:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))


def planted(doc_id: Column, run: Column, each: int = 31) -> Column:
    """The run, without one code point where ``each`` divides the crc32 of ``doc_id:run``. A null doc_id is written as nothing."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % each == 0, cut).otherwise(run)


def word_counts(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of a table with one row for each occurrence (column ``word``), counted before the shuffle."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def _grams(rest: str) -> list[str]:
    """Bigrams with both ends marked; one edit changes two of the longer's at most."""
    marked = f"\x02{rest}\x03"
    return [marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1)]


class Postings:
    """Inverted lists of a block: (0 or 1 longer, place, gram) to the ascending numbers of the rests that have it there."""

    def __init__(self, rests: list[str], m: int):
        self.rests, self.lists = rests, defaultdict(list)
        for number, rest in enumerate(rests):
            for place, gram in enumerate(_grams(rest)):
                self.lists[len(rest) - m, place, gram].append(number)

    def near(self, rest: str, after: int = -1) -> Iterator[int]:
        """Numbers of the rests one edit from ``rest``: those as long (of a number above ``after``), and those one longer."""
        grams, lists = _grams(rest), self.lists
        equal = [lists.get((0, p, g), ()) for p, g in enumerate(grams)]
        longer = [lists.get((1, p + s, g), ()) for p, g in enumerate(grams) for s in (0, 1)]
        for found, bound, low in ((equal, len(grams) - TOUCHED, after), (longer, len(grams) + 1 - TOUCHED, -1)):
            found = [x if low < 0 else x[bisect_right(x, low) :] for x in found if x]
            found = [x for x in found if x]
            if len(found) < bound:
                continue
            for number, again in groupby(merge(*found)):
                if sum(1 for _ in again) >= bound and one_edit(rest, self.rests[number]):
                    yield number


def _shards(words: DataFrame) -> DataFrame:
    """(side, m, half, word, n): the four shards of each word. Side 0 has the first half in common, 1 the second."""
    m = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")
    with_m = words.select("word", "n", m).withColumn("h", F.floor(F.col("m") / 2).cast("int"))
    first, last = F.substring("word", F.lit(1), F.col("h")), F.substring(F.col("word"), F.length("word") - (F.col("m") - F.col("h")) + 1, F.col("m") - F.col("h"))
    both = with_m.select("word", "n", "m", F.posexplode(F.array(first, last)).alias("side", "half"))
    return both.select("side", "m", "half", "word", "n")


def _dealt(shards: DataFrame, scratch: Scratch) -> DataFrame:
    """Shards with the blocks (i, j) a word goes to, ``own`` being its own."""
    shard = ["side", "m", "half"]
    large = shards.groupBy(*shard).agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK).select(*shard, F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks"))
    large = scratch.kept(large)
    n = large.count()
    joined = shards.join(F.broadcast(large) if n <= BROADCAST_SHARDS else large, shard, "left") if n else shards.withColumn("blocks", F.lit(1))
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("word"), blocks).cast("int")
    dealt = joined.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.select(*shard, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "word", "n")


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words of ``words`` (word, n; distinct words of five code points or more) one edit apart, once.

    No words give none; what is kept meanwhile is in ``scratch``, which the caller clears.
    """
    bound_batches(words.sparkSession)
    key = ["side", "m", "half", "i", "j"]
    dealt = _dealt(_shards(words), scratch).repartition(partitions_of(words.sparkSession), *key).sortWithinPartitions(*key, "own", "word").select(*key, "own", "word", "n")

    def pairs_of(shard: tuple, held: list[tuple[int, str, int]]) -> Iterator[tuple[str, int, str, int]]:
        side, m, half, i, j = shard
        cut = (lambda w: w[len(half) :]) if side == 0 else (lambda w: w[: len(w) - len(half)])
        rests = [cut(w) for _, w, _ in held]
        index = Postings(rests, m - len(half))
        for number, (own, word, n) in enumerate(held):
            if len(word) != m:
                continue
            for other in index.near(rests[number], number):
                there, near, n2 = held[other]
                # A pair is found in the block pair of its own blocks, and by its second halves only where its first halves differ.
                if (i == j or own != there) and (side == 0 or word[: m // 2] != near[: m // 2]):
                    yield word, n, near, n2

    @released
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)

        names, out = ["a", "a_n", "b", "b_n"], []
        for shard, members in groupby(rows(), key=lambda r: r[:5]):
            held = [r[5:] for r in members]
            if len(held) > 1:
                for pair in pairs_of(shard, held):
                    out.append(pair)
                    if len(out) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)

    return dealt.mapInArrow(found, "a string, a_n long, b string, b_n long")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): where following ``forms`` (word, form) ends, by pointer doubling; a form is always more frequent, so it ends."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        known = scratch.kept(now)
        step = known.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        now = known.join(step, known["root"] == step["_w"], "left")
        if not now.where("_r is not null").limit(1).count():
            return known
        now = now.select("word", F.coalesce("_r", "root").alias("root"))


def spelling_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table of distinct words and their counts (word, n).

    ``form`` is the near word of the largest n (ties: the smallest in code-point order) where that is at least ``times`` the
    word's n, else null with a null ``form_n``; ``root`` is where forms lead, the word itself without one; ``n_near`` is the
    number of near words. Words are of five code points or more and ``times`` is above 1. Rows with a null word or n are left out, other
    columns ignored. No words give no rows.
    """
    scratch = Scratch(words.sparkSession)
    words = scratch.kept(words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")).where("word is not null and n is not null"))
    pairs = near_pairs(words, scratch)
    best = F.min(F.struct((-F.col("other_n")).alias("k"), F.col("other"))).alias("best")
    side = lambda x, y: F.struct(F.col(x).alias("near_word"), F.col(y).alias("other"), F.col(f"{y}_n").alias("other_n"))
    near = pairs.select(F.inline(F.array(side("a", "b"), side("b", "a")))).groupBy("near_word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, words["word"] == near["near_word"], "left")
    enough = -F.col("best.k") >= F.lit(times) * F.col("n")
    placed = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.k")).alias("form_n"))
    placed = scratch.kept(placed)
    ends = roots(placed.where("form is not null").select("word", "form"), scratch).withColumnRenamed("word", "_word")
    found = placed.join(ends, placed["word"] == ends["_word"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    found = durable(found)
    scratch.clear()
    return found
