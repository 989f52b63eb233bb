"""Similar strings through an inverted index of trigrams: joins by threshold and the closest of each, without pairing everything.

Strings with the same trigrams are one class, named by its smallest id, so copies are never compared. Classes are dealt out in blocks, and
two blocks meet in one task. There a matrix product of trigrams counted in ``WIDTH`` columns says what two sets can share at most, as
every shared trigram falls into the same column; what that leaves is compared on whole sets. A candidate never leaves its task, so what is
shuffled is each class once for each block, about a hundred bytes and more a title. [STR36]
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.functions import text as T
from quillmere.shared import durable

#: Trigrams whose counts are broadcast; more are joined.
BROADCAST_TRIGRAMS = 500_000
#: Classes of a block, least number of blocks, rows of a block that are multiplied at once, and columns.
BLOCK, LEAST_BLOCKS, STRIP, WIDTH = 8192, 4, 1024, 1024


@dataclass
class TrigramIndex:
    """``members`` (id, class), ``classes`` (class, grams, size; rarest first), and how often each trigram is in a class (gram, n)."""

    members: DataFrame
    classes: DataFrame
    counts: DataFrame

    @classmethod
    def build(cls, strings: DataFrame, id: str, text: str) -> TrigramIndex:
        """Of the strings of a table. Null ids and strings without a word are left out; of a repeated id the greatest string counts."""
        rows = strings.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("_text")).where("id is not null and _text is not null").groupBy("id").agg(F.max("_text").alias("_text"))
        sets = rows.select("id", F.array_sort(T.trigrams(F.col("_text"))).alias("grams")).where("size(grams) > 0")
        named = sets.groupBy("grams").agg(F.min("id").alias("class"))
        members = sets.join(named, "grams").select("id", "class")
        counts = named.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
        known = F.broadcast(counts) if counts.count() <= BROADCAST_TRIGRAMS else counts
        listed = named.select("class", F.explode("grams").alias("gram")).join(known, "gram")
        ordered = F.array_sort(F.collect_list(F.struct("n", "gram")))["gram"]
        classes = listed.groupBy("class").agg(ordered.alias("grams")).select("class", "grams", F.size("grams").alias("size"))
        return cls(members, classes, counts)

    def save(self, path: str) -> TrigramIndex:
        self.members.write.mode("overwrite").parquet(f"{path}/members")
        self.classes.write.mode("overwrite").parquet(f"{path}/classes")
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        return self.load(self.classes.sparkSession, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TrigramIndex:
        return cls(*(spark.read.parquet(f"{path}/{x}") for x in ("members", "classes", "counts")))


def _codes(packed: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of all sets on one array, each the number that its three code points make, and where every set begins."""
    points = np.frombuffer("".join(packed).encode("utf-32-le"), "<u4").astype(np.int64).reshape(-1, 3)
    return (points[:, 0] << 42) | (points[:, 1] << 21) | points[:, 2], np.concatenate([[0], np.cumsum([len(x) // 3 for x in packed])]).astype(np.int64)


class _Block:
    """Classes in ascending order, and their sets."""

    def __init__(self, classes: np.ndarray, packed: list[str]):
        order = np.argsort(classes)
        self.classes = classes[order]
        self.codes, self.starts = _codes([packed[k] for k in order])
        self.sizes = np.diff(self.starts).astype(np.float32)
        self.columns = ((self.codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % WIDTH
        self._sets: dict[int, frozenset] = {}

    def matrix(self, low: int, high: int) -> np.ndarray:
        a, b = self.starts[low], self.starts[high]
        rows = np.repeat(np.arange(high - low), np.diff(self.starts[low : high + 1]))
        return np.bincount(rows * WIDTH + self.columns[a:b], minlength=(high - low) * WIDTH).astype(np.float32).reshape(-1, WIDTH)

    def set(self, k: int) -> frozenset:
        if k not in self._sets:
            self._sets[k] = frozenset(self.codes[self.starts[k] : self.starts[k + 1]].tolist())
        return self._sets[k]


def _near(left: _Block, right: _Block, threshold: float) -> Iterator[tuple[int, int, float]]:
    """(row of the left, row of the right, similarity), row by row of the left."""
    strips = [(at, to := min(at + STRIP, len(right.classes)), right.matrix(at, to)) for at in range(0, len(right.classes), STRIP)]
    for low in range(0, len(left.classes), STRIP):
        high = min(low + STRIP, len(left.classes))
        rows, found = left.matrix(low, high), []
        for at, to, others in strips:
            shared = rows @ others.T
            # Columns hold small whole numbers, so products are exact; the small term keeps the rest of the rounding on the safe side.
            most = shared * (1 + threshold) >= threshold * (left.sizes[low:high, None] + right.sizes[None, at:to]) - 1e-2
            found += [(low + i, at + j) for i, j in zip(*(x.tolist() for x in np.nonzero(most)), strict=True)]
        for i, j in sorted(found):
            a, b = left.set(i), right.set(j)
            n = len(a & b)
            if (similarity := n / (len(a) + len(b) - n)) >= threshold:
                yield i, j, similarity


def _meeting(left: DataFrame, right: DataFrame, threshold: float, top: int | None) -> DataFrame:
    """(a, b, similarity) of classes of both sides, a and b apart: the ``top`` of each a and pair of blocks, or else all of a < b.

    For the latter both sides are the same and only one of two blocks in either order is gone through.
    """
    both = top is None
    blocked = lambda df, n: durable(df.select("class", F.array_join("grams", "").alias("packed"), F.pmod(F.xxhash64("class"), F.lit(n)).cast("int").alias("block")))
    blocks = lambda df: max(LEAST_BLOCKS, -(-df.count() // BLOCK))
    n = blocks(left)
    rows = blocked(left, n)
    m = n if both else blocks(right)
    others = rows if both else blocked(right, m)
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    lefts = rows.select("class", "packed", F.lit(True).alias("own"), F.col("block").alias("i"), each(m).alias("j"))
    rights = others.select("class", "packed", F.lit(False).alias("own"), each(n).alias("i"), F.col("block").alias("j"))
    dealt = lefts.unionByName(rights)
    dealt = dealt.where("i < j or (i = j and own)") if both else dealt

    def met(group: pa.Table) -> pa.Table:
        own = group["own"].to_numpy()
        classes, packed = group["class"].to_numpy(), group["packed"].to_pylist()
        a = _Block(classes[own], [x for x, o in zip(packed, own, strict=True) if o])
        same = both and group["i"][0].as_py() == group["j"][0].as_py()
        b = a if same else _Block(classes[~own], [x for x, o in zip(packed, own, strict=True) if not o])
        out: list[tuple[int, int, float]] = []
        mine: list[tuple[float, int]] = []
        last = -1
        for i, j, similarity in _near(a, b, threshold):
            x, y = int(a.classes[i]), int(b.classes[j])
            if both:
                if not same or x < y:
                    out.append((min(x, y), max(x, y), similarity))
            elif x != y:
                if x != last:
                    out += [(last, c, -s) for s, c in sorted(mine)[:top]]
                    last, mine = x, []
                mine.append((-similarity, y))
        out += [(last, c, -s) for s, c in sorted(mine)[:top]]
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64()), "similarity": pa.array([x[2] for x in out], pa.float64())})

    return dealt.groupBy("i", "j").applyInArrow(met, "a long, b long, similarity double")


def similar(index: TrigramIndex, threshold: float = 0.5) -> DataFrame:
    """(a, b, similarity): pairs of classes, a the smaller, whose trigram sets have the similarity or more. ``members`` says who is in a class."""
    return _meeting(index.classes, index.classes, threshold, None)


def closest(index: TrigramIndex, queries: DataFrame, top: int = 5, threshold: float = 0.3) -> DataFrame:
    """(query_id, class, similarity, rank) of the ``top`` classes most similar to each query's (query_id, an id of the index), its own left out.

    Ties go to the smaller class. What is below the threshold does not count as similar.
    """
    asked = queries.join(index.members, queries["query_id"] == index.members["id"]).select("query_id", F.col("class").alias("a"))
    left = index.classes.join(asked.select(F.col("a").alias("class")).distinct(), "class", "left_semi")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), F.asc("b")))
    best = _meeting(left, index.classes, threshold, top).withColumn("rank", rank.cast("int")).where(F.col("rank") <= top)
    return asked.join(best, "a").select("query_id", F.col("b").alias("class"), "similarity", "rank")
