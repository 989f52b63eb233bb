"""Lines that many documents share, found with levelled sorted runs of line hashes.

``LineRuns`` holds what is known of line keys as sorted runs: bucketed, sorted
tables of (h1, h2, n, first), h1 and h2 being the 128-bit hash of a key, n the
documents that hold it, first where it came first: batch, whether the id is null, id. A new batch merge-anti-joins the
run of settled keys (those found in ``min_docs`` documents, about which nothing
can change) and adds the rest as a run of level 0. A level with ``fanout`` runs
is compacted into one run of the next level, and keys that reach ``min_docs``
on the way move to the settled run. All runs share their buckets, so merges and
joins need no exchange. Runs live in the shared folder and are deleted by
``close``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.common import SPACE_BYTES, bound_batches, durable, partitions_of, released, remove_path, scratch_path, whole_row

KEYS = ["h1", "h2"]
#: Line keys that a task gathers before it counts them and passes them on, 40 bytes each; those of one document at least.
FLUSH = 300_000
FIRST = "first struct<b:int,u:boolean,d:long>"
#: Settled keys that may be broadcast, 16 bytes each; more are joined.
BROADCAST_KEYS = 1_000_000


def line_keys(text: str | None) -> list[bytes]:
    """The hash of each line's key, b"" for lines without one. A null text is one empty line."""
    digest = xxhash.xxh3_128_digest
    lines = (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")
    return [digest(key) if (key := line.strip(SPACE_BYTES)) else b"" for line in lines]


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=">i8").reshape(-1, 2).astype(np.int64)


class LineRuns:
    """Counts of line keys over batches of documents; see the module."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 3):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = partitions_of(spark)
        self.levels: list[list[str]] = []
        self.settled: list[str] = []
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        name, path = f"quillmere_run_{uuid.uuid4().hex}", scratch_path(self.spark, "run")
        self.paths[name] = path
        rows.write.format("parquet").option("path", path).bucketBy(self.buckets, *KEYS).sortBy(*KEYS).saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_path(self.spark, self.paths.pop(name))

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs merged by key. Their buckets are sorted and alike, so each step is a merge without an exchange."""
        merged = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).select(*KEYS, F.col("n").alias("_n"), F.col("first").alias("_first"))
            n = F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))
            merged = merged.join(other, KEYS, "full_outer").select(*KEYS, n.alias("n"), F.least("first", "_first").alias("first"))
        return merged

    def add(self, counts: DataFrame) -> None:
        """Adds a batch (h1, h2, n, first); a key may come more than once."""
        batch = counts.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        for name in self.settled:
            batch = batch.join(self.spark.table(name).select(*KEYS), KEYS, "left_anti")
        self._place(0, self._write(batch))

    def _place(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            names, self.levels[level] = self.levels[level], []
            self._place(level + 1, self._compact(names))

    def _compact(self, names: list[str], last: bool = False) -> str | None:
        merged = self._merged(names)
        whole = self._write(merged) if len(names) > 1 else names[0]
        new = self.spark.table(whole).where(F.col("n") >= self.min_docs)
        self.settled = [*self.settled, self._write(new)]
        rest = None if last else self._write(self.spark.table(whole).where(F.col("n") < self.min_docs))
        self._drop([*(names if len(names) > 1 else []), whole])
        return rest

    def frequent(self) -> DataFrame:
        """Keys of at least ``min_docs`` documents so far as (h1, h2, first), kept apart from the runs."""
        names = [x for level in self.levels for x in level]
        self.levels = []
        if names:
            self._compact(names, last=True)
        found = [self.spark.table(x).select(*KEYS, "first") for x in self.settled]
        union = found[0]
        for other in found[1:]:
            union = union.unionByName(other)
        return durable(union)

    def close(self) -> None:
        self._drop(list(self.paths))


def _counted(batch: list[int], doc_ids: list[int | None], keys: list[bytes], sizes: list[int]) -> pa.RecordBatch:
    """Counts of the distinct keys of documents, given by document and laid end to end."""
    halves = _halves(keys)
    of = np.repeat(np.arange(len(sizes)), sizes)
    b, unknown = np.array(batch, np.int32)[of], np.array([x is None for x in doc_ids])[of]
    d = np.array([x or 0 for x in doc_ids], np.int64)[of]
    order = np.lexsort((d, unknown, halves[:, 1], halves[:, 0], b))
    b, d, unknown, halves = b[order], d[order], unknown[order], halves[order]
    new = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (halves[1:] != halves[:-1]).any(axis=1))))
    n = np.diff(np.append(new, len(b)))
    first = pa.StructArray.from_arrays([pa.array(b[new]), pa.array(unknown[new]), pa.array(d[new], mask=unknown[new])], names=["b", "u", "d"])
    columns = [pa.array(b[new]), pa.array(halves[new, 0]), pa.array(halves[new, 1]), pa.array(n.astype(np.int64)), first]
    return pa.RecordBatch.from_arrays(columns, names=["batch", "h1", "h2", "n", "first"])


def count_line_keys(docs: DataFrame, batches: int) -> DataFrame:
    """(batch, h1, h2, n, first) of the keys of each task's documents. Rows with a null id are in the last batch."""

    @released
    def counted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        n = 0
        for rows in stream:
            for doc_id, b, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), strict=True):
                keys = set(line_keys(text.as_py()))
                keys.discard(b"")
                if not keys:
                    continue
                for own, x in zip(held, (b, doc_id, b"".join(keys), len(keys)), strict=True):
                    own.append(x)
                n += len(keys)
                if n >= FLUSH:
                    yield _counted(*held)
                    held, n = ([], [], [], []), 0
        if n:
            yield _counted(*held)

    batch = F.when(F.col("doc_id").isNull(), batches - 1).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), batch.alias("batch"), F.col("text").cast("string").alias("text")).mapInArrow(
        counted, "batch int, h1 long, h2 long, n long, " + FIRST
    )


def frequent_line_keys(docs: DataFrame, min_docs: int, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Keys found in at least ``min_docs`` documents as (h1, h2, first). The text is read once."""
    spark = docs.sparkSession
    bound_batches(spark)
    path = scratch_path(spark, "lines")
    runs = LineRuns(spark, min_docs, fanout)
    try:
        count_line_keys(docs, batches).write.partitionBy("batch").parquet(path)
        counts = spark.read.schema(f"h1 long, h2 long, n long, {FIRST}, batch int").parquet(path)
        for b in range(batches):
            runs.add(counts.where(F.col("batch") == b).drop("batch"))
        return runs.frequent()
    finally:
        runs.close()
        remove_path(spark, path)


def _member(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Position in ``table`` (sorted rows h1, h2) of each key, or -1."""
    if not len(table) or not len(keys):
        return np.full(len(keys), -1)
    at = np.searchsorted(table[:, 0], keys[:, 0])
    found = np.full(len(keys), -1)
    for step in range(3):  # equal first halves, should there be any
        here = np.minimum(at + step, len(table) - 1)
        hit = (table[here] == keys).all(axis=1)
        found[hit] = here[hit]
    return found


def _apply(docs: DataFrame, lookup: DataFrame | None, known, keep_first: bool) -> DataFrame:
    """(row, text, n_lines, n_dropped). ``known``: broadcast (table, first ids); or else ``lookup`` has brought an array of dropped positions.

    Rows stay with Spark: Python is given a document's id and text and gives back a text only where lines go.
    """

    def dropped(text: str, doc_id: int | None) -> set[int]:
        table, first = known.value
        keys = line_keys(text)
        at = [k for k, key in enumerate(keys) if key]
        if not at:
            return set()
        found = _member(_halves([keys[k] for k in at]), table)
        if not keep_first or doc_id is None:
            return {k for k, f in zip(at, found, strict=True) if f >= 0}
        # The first document keeps its first line of each key.
        seen, drop = set(), set()
        for k, f in zip(at, found, strict=True):
            if f >= 0 and (first[f] != doc_id or f in seen):
                drop.add(k)
            seen.add(f)
        return drop

    @released
    def applied(stream: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for ids, values, positions in stream:
            texts, n_lines, n_dropped = [], [], []
            for doc_id, value, own in zip(ids.to_pylist(), values, positions.to_pylist(), strict=True):
                text = value.as_py() or ""
                drop = set(own or ()) if known is None else dropped(text, doc_id)
                n_lines.append(text.count("\n") + 1)
                n_dropped.append(len(drop))
                texts.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop) if drop else None)
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["text", "n_lines", "n_dropped"])

    # Not to be worked out again for each use of its result.
    found = F.arrow_udf(applied, "text string, n_lines long, n_dropped long").asNondeterministic()
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(whole_row(docs).alias("row"), doc_id.alias("_i"), text.alias("_t"), F.xxhash64(text).alias("_h"))
    positions = F.lit(None).cast("array<int>")
    if known is None:
        rows = rows.join(lookup, rows["_i"].eqNullSafe(lookup["_id"]) & (rows["_h"] == lookup["_hash"]), "left")
        positions = F.col("positions")
    done = rows.select("row", "_t", found(F.col("_i"), F.col("_t"), positions).alias("_f"))
    return done.select("row", F.coalesce("_f.text", "_t", F.lit("")).alias("text"), "_f.n_lines", "_f.n_dropped")


def _positions(docs: DataFrame, frequent: DataFrame, keep_first: bool) -> DataFrame:
    """(_id, _hash, positions) of the lines to drop, by joining line hashes with the frequent keys."""

    @released
    def hashed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in stream:
            for doc_id, text_hash, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), strict=True):
                keys = line_keys(text.as_py())
                at = [k for k, key in enumerate(keys) if key]
                if not at:
                    continue
                seen, again = set(), []
                for k in at:
                    again.append(keys[k] in seen)
                    seen.add(keys[k])
                halves = _halves([keys[k] for k in at])
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * n, pa.int64()), pa.array([text_hash] * n, pa.int64()), pa.array(at, pa.int32()), pa.array(again), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                    names=["_id", "_hash", "position", "again", "h1", "h2"],
                )

    text = F.col("text").cast("string")
    # Rows alike in id and text have the same lines to drop; one of them is enough.
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(hashed, "_id long, _hash long, position int, again boolean, h1 long, h2 long")
    hit = lines.join(frequent, KEYS)
    if keep_first:
        hit = hit.where(~F.col("_id").eqNullSafe(F.col("first.d")) | F.col("_id").isNull() | F.col("again"))
    return hit.groupBy("_id", "_hash").agg(F.collect_set("position").alias("positions"))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, batches: int = 4, broadcast_keys: int = BROADCAST_KEYS, counted: DataFrame | None = None) -> DataFrame:
    """Documents without the lines that at least ``min_docs`` documents share.

    Returns (row, text, n_lines, n_dropped): ``row`` is the whole input row, so
    no column of it can clash; ``text`` what is left, lines joined by newline.
    A line's key is the line without white space at its ends, A-Z lower-cased;
    lines without a key always stay. ``keep_first`` lets the first document of a
    key keep its first such line. A null text is one empty line. A row is a
    document: repeated rows count each, rows with a null id too (and never keep
    a line as first: one that only such rows hold goes from all of them). The first
    is the smallest by (hash of the id, cut to ``batches`` values; id). No rows give no rows. ``counted``: the documents whose lines
    are counted and among which the first is sought, where these are not all.
    """
    bound_batches(docs.sparkSession)
    frequent = frequent_line_keys(docs if counted is None else counted, min_docs, batches)
    if frequent.count() <= broadcast_keys:
        found = frequent.select("h1", "h2", F.col("first.d").alias("d")).toPandas().sort_values(["h1", "h2"])
        known = (found[["h1", "h2"]].to_numpy(np.int64).copy(), found["d"].astype("Int64").fillna(-(1 << 63)).to_numpy(np.int64))
        return _apply(docs, None, docs.sparkSession.sparkContext.broadcast(known), keep_first)
    return _apply(docs, _positions(docs, frequent, keep_first), None, keep_first)
