"""Shards by extendible hashing.

The directory is a trie over the bits of a hash of doc_id. A bucket over the
byte limit is split on one more bit, others are not, so a shard is the shortest
prefix whose documents fit. Sizes of all prefixes come from one histogram of
cells some bits finer than the shards will be; cells that are over the limit
themselves get a finer histogram of their own, down to 60 bits.

Documents that 60 bits do not part (one doc_id on many rows) are cut into chunks
by running sums of their bytes, each salt by itself, so such a group is no one task's.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.llm.common import durable, partitions_of, whole_row

BITS = 60
#: Bits a histogram's cells have beyond what evenly spread documents would need.
FINER = 5


def hash60(doc_id: Column) -> Column:
    """The first 60 bits of the md5 of the id as text (null: empty)."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, bits: int) -> Column:
    return F.shiftright(h, BITS - bits)


def _leaves(cells: DataFrame, low: int, bits: int, limit: int) -> DataFrame:
    """(cell, depth, prefix): for each cell the shortest prefix of at least ``low`` bits that fits; cells that do not fit are left out."""
    depths = F.sequence(F.lit(low), F.lit(bits))
    nodes = cells.select("cell", "bytes", F.explode(depths).alias("depth"))
    # Shift by a column: multiply out instead of shiftright, whose count must be a literal.
    nodes = nodes.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    sizes = nodes.groupBy("depth", "prefix").agg(F.sum("bytes").alias("size")).where(F.col("size") <= limit)
    return nodes.join(sizes, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix")).alias("leaf")).select("cell", "leaf.depth", "leaf.prefix")


def _rows(docs: DataFrame, carry: bool) -> DataFrame:
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    own = [F.col("doc_id").cast("long").alias("doc_id"), hash60(F.col("doc_id")).alias("h"), size.alias("n_bytes")]
    return docs.select(*own, *([whole_row(docs).alias("row")] if carry else []))


def _placed(rows: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """``rows`` with depth, prefix and chunk of each. ``sizes``: (h, n_bytes) of the same rows, from which the directory is made."""
    keep = [c for c in rows.columns if c != "h"]
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    done: list[DataFrame] = []
    todo, low = sizes, 0
    bits = min(BITS, max(0, ceil(log2(max(1, total / limit)))) + FINER)
    while True:
        cells = durable(todo.groupBy(_prefix(F.col("h"), bits).alias("cell")).agg(F.sum("n_bytes").alias("bytes")))
        leaves = _leaves(cells, low, bits, limit)
        celled = rows.withColumn("cell", _prefix(F.col("h"), bits))
        # Rows of cells that this pass does not place find no leaf here.
        done.append(celled.join(leaves, "cell").select(*keep, "depth", "prefix", F.lit(0).cast("long").alias("chunk")))
        over = durable(cells.where(F.col("bytes") > limit).select("cell"))
        if not over.limit(1).count():
            break
        rows = celled.join(over, "cell", "left_semi").drop("cell")
        if bits == BITS:
            done.append(_chunks(rows, limit, max(16, partitions_of(sizes.sparkSession))))
            break
        todo = durable(todo.withColumn("cell", _prefix(F.col("h"), bits)).join(over, "cell", "left_semi").drop("cell"))
        low, bits = bits + 1, min(BITS, bits + 12)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def assign_shards(docs: DataFrame, limit: int = 16 << 20) -> DataFrame:
    """(doc_id, n_bytes, depth, prefix, chunk) of every row; the last three name its shard.

    n_bytes is the text's length in UTF-8 (null: 0). Every shard has at most
    ``limit`` bytes, except for a document that is larger by itself, which is
    alone in its shard. Chunk is 0 but for rows that share one hash beyond the limit.
    Rows with a null or the same id are documents of their own; other columns
    are ignored; no rows give none.
    """
    rows = durable(_rows(docs, carry=False))
    return _placed(rows, rows.select("h", "n_bytes"), limit)


def _chunks(rows: DataFrame, limit: int, salts: int) -> DataFrame:
    """Rows of one hash that together are over the limit, cut into chunks.

    A row begins at the sum of the bytes before it in its salt. Those that begin in the
    same half limit, none larger than a half itself, fit together; larger ones are alone.
    """
    keep = [c for c in rows.columns if c != "h"]
    numbered = durable(rows.withColumn("at", F.monotonically_increasing_id()))
    salted = numbered.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(salts)))
    before = F.coalesce(F.sum("n_bytes").over(Window.partitionBy("h", "large", "salt").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    half = limit // 2
    chunk = F.when(F.col("large"), -1 - F.col("at")).otherwise(F.floor(before / half) * salts + F.col("salt"))
    return salted.withColumn("large", F.col("n_bytes") > half).withColumn("chunk", chunk.cast("long")).select(*keep, F.lit(BITS).alias("depth"), F.col("h").alias("prefix"), "chunk")


def write_shards(docs: DataFrame, path: str, limit: int = 16 << 20, column: str = "shard") -> str:
    """Writes documents as Parquet, one folder a shard, one task a shard at a time; returns the name of the shard column.

    Every row is written once, those with a null or repeated id too, with all its columns. Where a column has the
    name ``column`` already, underscores are put after the shard's.
    """
    while column in docs.columns:
        column += "_"
    sizes = durable(_rows(docs, carry=False).select("h", "n_bytes"))
    shard = F.concat_ws("-", F.lpad(F.col("depth").cast("string"), 2, "0"), F.lower(F.hex("prefix")), F.col("chunk").cast("string"))
    placed = _placed(_rows(docs, carry=True), sizes, limit)
    placed.select(*[F.col("row")[c].alias(c) for c in docs.columns], shard.alias(column)).repartition(F.col(column)).write.partitionBy(column).parquet(path)
    return column
