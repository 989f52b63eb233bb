"""Near-duplicate documents from bottom-k sketches of one hash function.

1. Each document's distinct 5-word shingles are hashed once; the ``K`` smallest
   hashes are its sketch. Documents with the same set are one class, so copies
   are linked without being compared.
2. Inverted lists of retained values bring classes together. Two sets of
   similarity 0.75 share most of their sketches, at least ``shared_at_least`` values
   (exact for sets kept whole, five and a half standard deviations below the mean for others),
   so it is enough to list each class under all but so many of its values less one, rarest
   first (prefix filtering): a passage that many documents hold is not listed
   where anything rarer is.
3. In each list every class is paired with the smallest one, which is linear
   in the list. The union of two sketches estimates their similarity, and what
   may reach it is verified on the full sets.
4. Links give components. Lists whose classes are still in several components
   have every pair across components estimated, in blocks bounded in classes and in bytes, and what may be
   similar verified; lists of much the same members are gone through as one.
   So each pair that shares a listed value is linked, ruled out, or in one
   component anyway.

No list is capped and no step holds a list in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, floor, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import Scratch, bound_batches, durable, partitions_of, released, swept
from quillmere.llm.components import connected_components

K, WORDS, PERCENT, SIGMAS = 64, 5, 75, 5.5
#: Counters of the table that tells common values from rare ones. Its size is fixed; it only orders values.
COUNTERS = 1 << 20
#: Classes in a block of the pairs across components, and bytes of their full sets; one class at least.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Percent of members by which lists are put together.
ALIKE = 30
#: Ids that may be broadcast to pick out texts; more are joined.
BROADCAST_IDS = 500_000
#: Rows of one key from which on a join deals them out to several tasks.
HOT_ROWS = 50_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordMemo(dict):
    """Word to its 64-bit hash. Emptied when it has grown to ``limit``, which changes speed only."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(memo: _WordMemo, text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of fewer words the whole sequence is one shingle; without words none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter(map(memo.__getitem__, parts), dtype=np.uint64, count=len(parts))
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - words + 1)
    size = min(words, len(hashes))
    mixed = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        mixed = (mixed ^ hashes[k : k + n]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


@cache
def shared_at_least(n: int, k: int = K, percent: int = PERCENT) -> int:
    """Sketch values that a set of ``n`` shares with any set similar enough."""
    t = percent / 100
    if n <= t * k:  # neither set is cut
        return max(1, ceil(t * n - 1e-9))
    kept = min(n, k)
    return max(1, floor(t * kept - SIGMAS * sqrt(t * (1 - t) * kept)))


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n, d1, d2, sketch): set size, 128-bit digest of the set and its K smallest hashes. Empty sets have null digests."""

    @released
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordMemo()
        for rows in batches:
            n, d1, d2, sketches = [], [], [], []
            for value in rows.column(1):
                found = shingle_set(memo, value.as_py())
                n.append(len(found))
                if len(found):
                    a, b = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), dtype=">i8").tolist()
                    d1.append(a)
                    d2.append(b)
                    sketches.append(found[:K].tobytes())
                else:
                    d1.append(None)
                    d2.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "n", "d1", "d2", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sketched, "doc_id long, n long, d1 long, d2 long, sketch binary")


def _common_values(classes: DataFrame):
    """A broadcast table of fixed size: how often values of each hash bucket repeat within tasks."""

    @released
    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for rows in batches:
            values = np.frombuffer(b"".join(rows.column(0).to_pylist()), dtype=np.uint64)
            counts += np.bincount((values * _MIX >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(counts > 3)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    rows = classes.select("sketch").mapInArrow(repeated, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(COUNTERS, dtype=np.int64)
    table[rows["at"].to_numpy(np.int64)] = rows["n"]
    return classes.sparkSession.sparkContext.broadcast(table)


def _rarest(own: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """The retained values that a class of set size ``n`` is listed under."""
    take = len(own) - shared_at_least(min(n, 4 * K)) + 1
    return own[np.lexsort((own, table[(own * _MIX >> np.uint64(44)).astype(np.int64)]))[:take]]


def _listed(classes: DataFrame, common) -> DataFrame:
    """(value, c): each class under its rarest retained values."""

    @released
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, values = [], []
            for c, n, kept in zip(*(rows.column(i).to_pylist() for i in range(3)), strict=True):
                values.append(_rarest(np.frombuffer(kept, dtype=np.uint64), n, common.value).view(np.int64))
                ids.append(np.full(len(values[-1]), c))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values)), pa.array(np.concatenate(ids))], names=["value", "c"])

    return classes.select("c", "n", "sketch").mapInArrow(listed, "value long, c long")


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of both in order, and where one repeats the one before."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return both, both[1:] == both[:-1]


def may_be_similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether the K smallest values of two sketches' union leave the similarity possible."""
    both, again = _merged(a, b)
    new = np.flatnonzero(~again)[: K - 1] + 1  # places of the union's values after the first
    n = len(new) + 1
    end = int(new[-1]) if len(new) else 0
    hits = int(again[: end + 1].sum())
    t = percent / 100
    return hits >= t * n - SIGMAS * sqrt(t * (1 - t) * n)


def shared_values(sketches: list[np.ndarray], step: int = 2048) -> np.ndarray:
    """How many values each pair of sketches shares, by matrix products over the values that repeat, some at a time."""
    sizes = np.array([len(x) for x in sketches])
    _, column, counts = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    again = counts > 1
    place = np.cumsum(again) - 1
    use = again[column]
    row, at = np.repeat(np.arange(len(sketches)), sizes)[use], place[column[use]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    shared = np.zeros((len(sketches), len(sketches)), dtype=np.float32)
    for low in range(0, int(again.sum()), step):
        part = slice(*np.searchsorted(at, [low, low + step]))
        holds = np.zeros((len(sketches), step), dtype=np.float32)
        holds[row[part], at[part] - low] = 1
        shared += holds @ holds.T
    return shared


def enough_shared(shared: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which pairs share so many values that ``may_be_similar`` can hold."""
    t, larger = percent / 100, np.maximum(sizes[:, None], sizes[None, :])
    return shared >= t * larger - SIGMAS * np.sqrt(t * (1 - t) * larger)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = int(_merged(a, b)[1].sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def salted_join(big: DataFrame, small: DataFrame, key: list[str], counts: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` (a row a key at most) on ``key``; keys with many rows are dealt out by ``spread`` to several tasks.

    ``counts`` (key, m) says how many rows of ``big`` a key has. Those beyond ``HOT_ROWS`` are few, a row in so many, and broadcast with their parts.
    """
    hot = counts.where(F.col("m") > HOT_ROWS).select(*key, F.ceil(F.col("m") / HOT_ROWS).cast("int").alias("_parts"))
    if not hot.count():
        return big.join(small, key, how)
    hot = F.broadcast(hot)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = big.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    copied = small.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [*key, "_salt"], how).drop("_salt")


def _judge(pairs: DataFrame, hubs: DataFrame, sides: DataFrame, column: str, judge) -> DataFrame:
    """Pairs (a, b) that ``judge`` lets pass on both sides' ``column``; the pairs are joined with each side in turn.

    ``hubs`` (a, m): a may be in any number of pairs, so its are dealt out; b is in as many as there are values it is listed under.
    """

    @released
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = [judge(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(rows.column(2), rows.column(3), strict=True)]
            yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sides.select(F.col("c").alias("b"), F.col(column).alias("_y")), "b")
    both = salted_join(first, sides.select(F.col("c").alias("a"), F.col(column).alias("_x")), ["a"], hubs, "b")
    return both.select("a", "b", "_x", "_y").mapInArrow(judged, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(c, shingles): full sets of the documents whose id is in ``ids`` (one distinct column, ``_id``), computed from their texts again."""
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    @released
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordMemo()
        for rows in batches:
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([shingle_set(memo, x.as_py()).tobytes() for x in rows.column(1)], pa.binary())], names=["c", "shingles"])

    return text.join(wanted, F.col("doc_id") == F.col("_id"), "left_semi").mapInArrow(full, "c long, shingles binary")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes (a, b) whose sketches allow it and whose full sets are similar."""
    scratch = Scratch(docs.sparkSession)
    hubs = pairs.groupBy("a").agg(F.count("*").alias("m"))
    likely = scratch.kept(_judge(pairs, hubs, classes, "sketch", may_be_similar).distinct())
    ids = scratch.kept(likely.select(F.col("a").alias("_id")).union(likely.select("b")).distinct())
    sets = scratch.kept(_sets(docs, ids))
    found = durable(_judge(likely, hubs, sets, "shingles", similar).distinct())
    scratch.clear()
    del likely, ids, sets, hubs
    swept(docs.sparkSession)
    return found


def _groups(members: DataFrame) -> DataFrame:
    """(group, c, component): lists that have much the same members are one group, so that a pair is not met again in each.

    Lists that follow each other in a class, the longest first, are put
    together if ``ALIKE`` percent of the longer one's members have them so. Two members of a list
    are in one group whatever is put together.
    """
    ordered = members.groupBy("c").agg(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("k"), "value"))).alias("own")).where(F.size("own") > 1)
    steps = F.transform(F.sequence(F.lit(0), F.size("own") - 2), lambda i: F.struct(F.col("own")[i].alias("x"), F.col("own")[i + 1].alias("y")))
    met = ordered.select(F.explode(steps).alias("s")).groupBy(F.col("s.x.value").alias("u"), F.col("s.y.value").alias("v")).agg(F.count("*").alias("n"), F.max(-F.col("s.x.k")).alias("m"))
    labels = connected_components(met.where(F.col("n") * 100 >= F.col("m") * ALIKE).select("u", "v"))
    labels = labels.select(F.col("node").alias("value"), F.col("component").alias("label"))
    return members.join(labels, "value", "left").select(F.coalesce("label", "value").alias("group"), "c", "component").distinct()


def _across(lists: DataFrame, docs: DataFrame, classes: DataFrame, components: DataFrame) -> DataFrame:
    """Links (a, b) between different components of one list, as many as it takes to join what belongs together.

    Every pair of a list and of different components is estimated, and what may be similar verified on the full sets,
    in blocks of a bounded number of classes and of bytes; a pair that links of its block have joined meanwhile is passed over.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    placed = lists.join(components, lists["c"] == components["node"], "left").select("value", "c", F.coalesce("component", "c").alias("component"))
    # In a list of two the only pair was tested.
    open_lists = scratch.kept(placed.groupBy("value").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high and m > 2").select("value", "m"))
    members = scratch.kept(salted_join(placed, open_lists, ["value"], open_lists, "c"))
    grouped = scratch.kept(_groups(members).join(classes.select("c", "n"), "c"))
    wanted = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    # Kept apart, so that the join with them is one that Spark deals out anew where a group is large.
    sizes = scratch.kept(grouped.groupBy("group").agg(wanted.alias("blocks"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("group", "blocks"))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes
    own = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    dealt = (
        grouped.join(sizes, "group").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", "component")
        .join(_sets(docs, scratch.kept(grouped.select(F.col("c").alias("_id")).distinct())), "c")
        .repartition(partitions_of(spark), "group", "i", "j").sortWithinPartitions("group", "i", "j", "own", "c")
        .select("group", "i", "j", "own", "c", "component", "shingles")
    )

    @released
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for rows in batches:
            for row in zip(*(rows.column(k).to_pylist() for k in range(7)), strict=True):
                if row[:3] != key:
                    if len(held) > 1:
                        yield _link_block(key[1] != key[2], held)
                    key, held = row[:3], []
                held.append((*row[3:6], np.frombuffer(row[6], np.uint64)))
        if len(held) > 1:
            yield _link_block(key[1] != key[2], held)

    found = durable(dealt.mapInArrow(joined, "a long, b long").distinct())
    scratch.clear()
    swept(spark)
    return found


def _link_block(two: bool, held: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
    """Links of a block of (own, c, component, set); of two blocks only those between them."""
    own, ids, of = (np.array([x[k] for x in held]) for k in range(3))
    root = {int(x): int(x) for x in of}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    links: tuple[list[int], list[int]] = ([], [])
    may = np.triu(of[:, None] != of[None, :], 1)
    if two:
        may &= own[:, None] != own[None, :]
    sizes = np.array([len(x[3]) for x in held])
    may &= 100 * np.minimum(sizes[:, None], sizes[None, :]) >= PERCENT * np.maximum(sizes[:, None], sizes[None, :])
    if may.any():
        shared = shared_values([x[3][:K] for x in held])
        may &= enough_shared(shared, np.minimum(sizes, K))
        x, y = np.nonzero(may)
        order = np.argsort(-shared[x, y], kind="stable")
        for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
            p, q = find(int(of[i])), find(int(of[j]))
            a, b = held[i][3], held[j][3]
            if p != q and may_be_similar(a[:K], b[:K]) and similar(a, b):
                root[max(p, q)] = min(p, q)
                links[0].append(int(min(ids[i], ids[j])))
                links[1].append(int(max(ids[i], ids[j])))
    return pa.RecordBatch.from_arrays([pa.array(links[0], pa.int64()), pa.array(links[1], pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Documents are linked if their shingle sets have a similarity of 0.75 or
    more; component_id is the smallest doc_id that links reach, kept whether that is the
    document itself. A null text, or one without words, has an empty set and no
    links. A doc_id on several rows stands for all their texts. A row with a
    null doc_id is a document by itself: null component_id, kept. Other columns
    are ignored; no rows give none.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark)
    all_sketches = scratch.kept(sketch(docs))
    sized = all_sketches.where("n > 0 and doc_id is not null")
    # Rows of one digest have one sketch; the aggregation keeps one before the shuffle, however many copies there are.
    reps = scratch.kept(sized.groupBy("d1", "d2").agg(F.min("doc_id").alias("c"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("m")))
    classes = reps.select("c", "n", "sketch")
    common = _common_values(classes)
    brief = Scratch(spark)
    lists = brief.kept(_listed(classes, common))
    hubs = brief.kept(lists.groupBy("value").agg(F.min("c").alias("a"), F.count("*").alias("m")).where("m > 1"))
    multi = scratch.kept(salted_join(lists, hubs.select("value", "a"), ["value"], hubs, "c"))
    brief.clear()
    pairs = brief.kept(multi.where("a <> c").select("a", F.col("c").alias("b")).distinct())
    del lists, hubs
    swept(spark)
    links = _verified(pairs, docs, classes)
    brief.clear()
    # A doc_id with several texts links their classes.
    several = sized.groupBy("doc_id").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low <> high").select("doc_id")
    own = sized.select("doc_id", "d1", "d2").join(several, "doc_id").join(reps.select("d1", "d2", "c"), ["d1", "d2"]).select(F.col("doc_id").alias("u"), F.col("c").alias("v"))
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(own)
    components = durable(connected_components(edges))
    more = _across(multi.select("value", "c"), docs, classes, components)
    if more.limit(1).count():
        components = durable(connected_components(edges.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))))
    # A class has one row, so its component is found before the rows of copies are, which a large class has dealt out.
    named = reps.join(components, reps["c"] == components["node"], "left").select("d1", "d2", F.coalesce("component", "c").alias("component"))
    rows = all_sketches.select("doc_id", "n", "d1", "d2", F.monotonically_increasing_id().alias("_row"))
    reached = salted_join(rows, named, ["d1", "d2"], reps.select("d1", "d2", "m"), "_row", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    found = durable(reached.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")))
    scratch.clear()
    swept(spark)
    return found
