"""Best-fit packing planned over a histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. Full pieces are
sequences by themselves. The other lengths, of which there are fewer than
``capacity``, are counted; best-fit decreasing runs over those counts on the
driver, and each piece takes the planned slot of its rank among the pieces of
its length. The plan holds runs of equal slots, never documents.

Size of the plan: a step of one length either uses up a group of like sequences
or splits one, so there are at most three new groups a length, and a group can
change at most as often as distinct lengths fit into ``capacity`` together
(about 90 for 4096). The plan does not grow with the documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.llm.common import bound_batches, durable, partitions_of, released
from quillmere.llm.memo import WordMemo

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of every document: (doc_id, piece, start, length, ids_crc32).

    A document's ids are those of its text, then ``end_id``; a null text counts
    as empty, so every row gives one piece at least. Rows with the same or a null
    doc_id are packed like any other row. Only documents longer than ``capacity`` are
    cut. Other columns of ``docs`` are ignored.
    """
    bound_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    @released
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordMemo.shared(vocabulary)
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = memo.ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(tokens), 4 * capacity)):
                    part = tokens[at : at + 4 * capacity]
                    ids.append(doc_id)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, PIECE_SCHEMA)


def plan_slots(counts: dict[int, int], capacity: int = 4096) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts of lengths.

    Returns runs (length, rank, n, sequence, per_sequence, offset) and the number
    of sequences: the pieces of ``length`` ranked ``rank`` to ``rank + n - 1`` go
    to sequences from ``sequence`` on, ``per_sequence`` to each, the first of
    each at ``offset``.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # space left -> ranges (first sequence, how many)
    n_sequences = 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            groups.setdefault(left, []).append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 to {capacity}")
        for left in sorted(x for x in groups if x >= length):
            ranges = groups.pop(left)
            while ranges and todo:
                first, n = ranges.pop()
                per = left // length
                whole = min(n, todo // per)
                if whole:
                    runs.append((length, rank, whole * per, first, per, capacity - left))
                    put(left - per * length, first, whole)
                    rank, todo = rank + whole * per, todo - whole * per
                rest = min(todo, per - 1) if whole < n else 0
                if rest:
                    runs.append((length, rank, rest, first + whole, rest, capacity - left))
                    put(left - rest * length, first + whole, 1)
                    rank, todo = rank + rest, todo - rest
                if n - whole - bool(rest):
                    ranges.append((first + whole + bool(rest), n - whole - bool(rest)))
            if ranges:
                groups[left] = [*groups.get(left, []), *ranges]
            if not todo:
                break
        if todo:
            per = capacity // length
            whole, rest = divmod(todo, per)
            if whole:
                runs.append((length, rank, whole * per, n_sequences, per, 0))
                put(capacity - per * length, n_sequences, whole)
                rank, n_sequences = rank + whole * per, n_sequences + whole
            if rest:
                runs.append((length, rank, rest, n_sequences, rest, 0))
                put(capacity - rest * length, n_sequences, 1)
                n_sequences += 1
    return runs, n_sequences


def _ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """Adds ``rank``, from 0 within each length. Ties have no order among themselves that matters.

    A length may hold a third of all pieces, so each length is ranked in
    ``salts`` parts and the parts' counts give where each part begins.
    """
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    part = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    begun = (
        salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    own = salted.withColumn("_rank", F.row_number().over(part) - 1)
    return own.join(begun, ["length", "_salt"]).withColumn("rank", F.col("_before") + F.col("_rank")).drop("_salt", "_before", "_rank")


def pack_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    spark = pieces.sparkSession
    pieces = durable(pieces)
    # At most `capacity` rows whatever the input.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan_slots(counts, capacity)
    runs.sort()
    told = np.array(runs, dtype=np.int64).reshape(-1, 6)
    # The plan's size is bounded by `capacity` alone (see above), so it may be broadcast.
    plan = spark.sparkContext.broadcast((told[:, 0] << 48 | told[:, 1], told))

    @released
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, planned = plan.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            _, first, _, sequence, per, at = planned[np.searchsorted(keys, length << 48 | rank, "right") - 1].T
            nth = rank - first
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence + nth // per), pa.array(at + nth % per * length)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    ranked = _ranked(pieces, max(16, partitions_of(spark)))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(slots, PIECE_SCHEMA + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """All documents packed into sequences of at most ``capacity`` tokens.

    Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset). No
    documents give no rows.
    """
    return pack_pieces(tokenize_pieces(docs, vocabulary, capacity, end_id), capacity)
