"""Exact top-k inner products over vectors sorted by length.

Candidates are cut into blocks by descending length (norm), queries into tiles. Every tile
first meets the longest block, which gives each query a score its k-th best
cannot fall below. A block whose longest vector cannot reach any such score
(Cauchy-Schwarz) is not sent to the tile at all. A task holds one tile and lets
the blocks go past it, the longest first, so that each query's k-th best so far rules out ever more:
scores are bounded by the inner product of the first rotated components plus the product
of the lengths of what is left (Cauchy-Schwarz again); the rotation comes from the
singular vectors of the whole table, so the first components carry most of the
product. Only what survives gets its exact integer product.

So a candidate is sent once for each tile that it may matter to, and a tile once for each
lane (a share of the blocks); there are lanes only where tiles are fewer than tasks.

Bounds are floating-point with a margin above their error; scores are integers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import frexp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.llm.common import bound_batches, durable, partitions_of, released

BLOCK_SCHEMA = "block long, top double, wide boolean, ids binary, vectors binary"
#: Bytes of a tile's vectors, and of the vectors sorted by a task.
TILE_BYTES, SORT_BYTES = 8 << 20, 64 << 20
#: Tiles whose thresholds are gathered and broadcast at once, 16 bytes each; more are searched for in groups.
TILES = 100_000
#: Tasks of a search at most; a task takes one tile and lane after the other.
TASKS = 10_000
_NAMES = ["block", "top", "wide", "ids", "vectors"]


def quantize(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, for the rows that take part.

    Components are doubles that hold whole numbers. Rows with a null id, a null
    vector, a null or a non-finite component take no part. Rows that share an id are vectors of their own.
    """

    def floor(x):
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # a larger double is whole already

    whole = F.forall(F.col("embedding"), lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", floor).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``dims`` components."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(column), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def rotation(quantized: DataFrame, dims: int, unit: float = 1.0) -> np.ndarray:
    """Right singular vectors of the whole table, strongest first, from its Gram matrix (dims x dims, added up by the executors)."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for rows in batches:
            x = _matrix(rows.column(0), dims) * unit
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(dims), dims)), pa.array(np.tile(np.arange(dims), dims)), pa.array(total.ravel())], names=["i", "j", "s"])

    sums = quantized.select("v").mapInArrow(grams, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    gram = np.zeros((dims, dims))
    gram[sums["i"], sums["j"]] = sums["s"]
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def _blocks(quantized: DataFrame, n: int, dims: int, size: int, unit: float) -> DataFrame:
    """Blocks of at most ``size`` of the ``n`` vectors by descending length: (block, top, wide, ids, vectors).

    Range partitioning orders the vectors over the whole cluster; block numbers
    rise with falling length and need not be dense. Vectors are kept as 32-bit numbers, or as doubles where some are ``wide``.
    """
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x * unit) * (x * unit))
    parts = max(1, min(-(-n // size), max(partitions_of(quantized.sparkSession), -(-n * dims * 8 // SORT_BYTES))))
    order = [F.desc("norm2"), F.asc("vec_id")]
    ordered = quantized.withColumn("norm2", norm2).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        vectors = _matrix(rows.column(1).chunk(0), dims)
        wide = bool(np.abs(vectors).max(initial=0) >= 1 << 31)
        values = [0, float(np.sqrt(rows.column(2)[0].as_py())), wide, rows.column(0).to_numpy().tobytes(), vectors.astype(np.float64 if wide else np.int32).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64(), pa.float64(), pa.bool_(), pa.binary(), pa.binary()], strict=True)], names=_NAMES)

    @released
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for rows in batches:
            held.append(rows)
            n += rows.num_rows
            while n >= size:
                whole = pa.Table.from_batches(held)
                yield block(whole.slice(0, size))
                held, n = whole.slice(size).to_batches(), n - size
        if n:
            yield block(pa.Table.from_batches(held))

    made = ordered.select("vec_id", "v", "norm2").mapInArrow(packed, BLOCK_SCHEMA)
    # Increases with the partition and the place in it, that is with falling length.
    return made.withColumn("block", F.monotonically_increasing_id())


class _Block:
    def __init__(self, ids: np.ndarray, whole: np.ndarray, turn: np.ndarray, head: int, unit: float):
        self.ids, self.whole = ids, whole
        bounded = whole * unit
        turned = bounded @ turn
        self.head = turned[:, :head].copy()
        self.rest = np.sqrt((turned[:, head:] ** 2).sum(axis=1))
        self.norm = np.sqrt((bounded**2).sum(axis=1))


def _vectors(ids: bytes, vectors: bytes, wide: bool, dims: int) -> tuple[np.ndarray, np.ndarray]:
    whole = np.frombuffer(vectors, np.float64 if wide else np.int32).reshape(-1, dims).astype(np.float64)
    if not np.isfinite(whole).all():
        raise OverflowError("a component times the scale is beyond what a double holds")
    return np.frombuffer(ids, np.int64), whole


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows: in doubles while sums stay below 2**53, in 64-bit integers below 2**63, or else in Python's."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if top < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    return exact(a) @ exact(b).T


def _below(score: int) -> float:
    """A double not above the score."""
    return float(score) if abs(score) <= 1 << 53 else float(np.nextafter(float(score), -np.inf))


class _Search:
    """Some queries, what each has found, and a score its k-th best cannot fall below (floors)."""

    def __init__(self, q: _Block, k: int, floors: np.ndarray, unit: float):
        self.q, self.k, self.floors, self.unit = q, k, floors, unit
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q.ids)

    def meet(self, c: _Block, step: int = 512) -> None:
        """Candidates of one block, the longest first."""
        q, k, slack = self.q, self.k, 1e-9
        for at in range(0, len(c.ids), step):
            part = slice(at, at + step)
            least = self.floors * self.unit * self.unit  # the unit squared may be too small for a double
            live = np.flatnonzero(q.norm * c.norm[at] * (1 + slack) + 1e-3 >= least)
            if not len(live):
                break
            bound = q.head[live] @ c.head[part].T + np.outer(q.rest[live], c.rest[part])
            margin = slack * np.outer(q.norm[live], c.norm[part]) + 1e-3
            may = bound + margin >= least[live][:, None]
            columns = np.flatnonzero(may.any(axis=0))
            if not len(columns):
                continue
            scores = _products(q.whole[live], c.whole[part][columns])
            may = may[:, columns] & (scores >= self.floors[live][:, None])
            ids = c.ids[part][columns]
            may &= ids[None, :] != q.ids[live][:, None]
            for i in np.flatnonzero(may.any(axis=1)):
                row, hit = live[i], np.flatnonzero(may[i])
                found, score = np.concatenate([self.best[row][0], ids[hit]]), np.concatenate([self.best[row][1], scores[i, hit]])
                if len(found) > k:
                    order = np.lexsort((found, -score)) if score.dtype != object else np.array(sorted(range(len(found)), key=lambda x: (-score[x], found[x])))
                    found, score = found[order[:k]], score[order[:k]]
                self.best[row] = (found, score)
                if len(found) == k:
                    self.floors[row] = max(self.floors[row], _below(int(score.min())))


def top_products(queries: DataFrame, vectors: DataFrame, k: int = 20, tile: int | None = None, block: int = 4096, head: int = 32) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's ``k`` highest integer inner products, ties to the smaller vec_id.

    Both sides are (vec_id, v) as ``quantize`` gives them. A query never meets
    vectors of its own id; rows that share an id are queries, and candidates, of their own. Vectors of fewer components count as padded with
    zeros. With fewer candidates than ``k`` all are returned; without queries or
    candidates, nothing. A score beyond 64 bits among a query's best is an error. ``tile``: queries that a task holds
    (by default as many as ``TILE_BYTES`` hold).
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    sizes = lambda df: df.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    (n, wide_v, top_v), (n_asked, wide_q, top_q) = sizes(vectors), sizes(queries)
    if not n or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, top = max(wide_v, wide_q, 1), max(top_v or 0.0, top_q or 0.0)
    # Bounds are worked out in units in which squares cannot overflow.
    unit = 2.0 ** -frexp(top)[1] if top > 2.0**100 else 1.0
    turn, head = rotation(vectors, dims, unit), min(head, dims)
    candidates = durable(_blocks(vectors, n, dims, block, unit))
    tile = tile or max(512, TILE_BYTES // (4 * dims))
    asked = _blocks(queries, n_asked, dims, tile, unit)
    # One block, so of bounded size whatever the table's.
    longest = candidates.orderBy("block").limit(1).collect()[0]
    first = (longest["ids"], longest["vectors"], longest["wide"])

    def parts(ids: np.ndarray, whole: np.ndarray, floors: np.ndarray, size: int = 512) -> list[_Search]:
        return [_Search(_Block(ids[at : at + size], whole[at : at + size], turn, head, unit), k, floors[at : at + size].copy(), unit) for at in range(0, len(ids), size)]

    @released
    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _Block(*_vectors(*first, dims), turn, head, unit)
        for rows in batches:
            for number, wide, ids, vectors in zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True):
                own = _vectors(ids, vectors, wide, dims)
                floors, least = [], np.inf
                for search in parts(*own, np.full(len(own[0]), -np.inf)):
                    search.meet(c)
                    floors.append(search.floors)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        needs = np.where(search.floors <= 0, 0.0, (search.floors * unit * unit - 1e-3) / search.q.norm)
                    least = min(least, float(needs.min()))
                values = [number, wide, ids, vectors, np.concatenate(floors).tobytes(), least * (1 - 1e-9) if least > 0 else 0.0]
                kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["tile", "wide", "ids", "vectors", "floors", "least"])

    tiles = durable(asked.select("block", "wide", "ids", "vectors").mapInArrow(seeded, "tile long, wide boolean, ids binary, vectors binary, floors binary, least double"))
    # Thresholds of tiles, 16 bytes for each ``TILE_BYTES`` of queries, a bounded number of tiles at a time.
    groups = -(-tiles.count() // TILES)
    found = None
    for group in range(groups):
        own = tiles.where(F.pmod(F.xxhash64("tile"), F.lit(groups)) == group) if groups > 1 else tiles
        hits = _search(own, candidates, -(-n // block), parts, lambda *x: _Block(*_vectors(*x, dims), turn, head, unit), dims)
        found = hits if found is None else found.unionByName(hits)
    # Of each query there are at most ``k`` rows a lane.
    rank = F.row_number().over(Window.partitionBy("tile", "row").orderBy(F.desc("score"), F.asc("vec_id"))).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(tiles: DataFrame, candidates: DataFrame, n_blocks: int, parts, block_of, dims: int) -> DataFrame:
    """(tile, row, query_id, vec_id, score): what each query of the tiles finds best in each lane."""
    spark = tiles.sparkSession
    ranked = sorted((r["least"], r["tile"]) for r in tiles.select("least", "tile").collect())
    if not ranked:
        return spark.createDataFrame([], "tile long, row long, query_id long, vec_id long, score long")
    lanes = max(1, min(-(-partitions_of(spark) // len(ranked)), n_blocks))
    needs = spark.sparkContext.broadcast(np.array([x for x, _ in ranked]))
    places = F.broadcast(spark.createDataFrame([(t, i) for i, (_, t) in enumerate(ranked)], "tile long, place int"))

    def reached(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for tops in batches:
            yield pa.array(np.searchsorted(needs.value, tops.to_numpy(zero_copy_only=False), "right").astype(np.int32))

    # Tiles stand by rising threshold; a block goes to those whose threshold its longest vector reaches.
    each = candidates.withColumn("n", F.arrow_udf(reached, "int")("top")).where("n > 0")
    sent = each.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int"))
    held = tiles.join(places, "tile").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    both = held.select("place", "lane", F.lit(0).alias("kind"), F.col("tile").alias("block"), "wide", "ids", "vectors", "floors").unionByName(
        sent.select("place", "lane", F.lit(1).alias("kind"), "block", "wide", "ids", "vectors", F.lit(None).cast("binary").alias("floors"))
    )
    tasks = min(len(ranked) * lanes, TASKS)
    slot = F.pmod(F.col("place") * lanes + F.col("lane"), F.lit(tasks)).cast("int")
    dealt = both.repartitionById(tasks, slot).sortWithinPartitions("place", "lane", "kind", "block")

    @released
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches: list[_Search] = []
        number = 0

        def results() -> Iterator[pa.RecordBatch]:
            at = 0
            for search in searches:
                some = [(at + i, search.q.ids[i], *x) for i, x in enumerate(search.best) if len(x[0])]
                at += len(search.q.ids)
                if some:
                    sizes = [len(x[2]) for x in some]
                    scores = np.concatenate([x[3] for x in some])
                    if scores.dtype == object and any(abs(x) >= 1 << 63 for x in scores):
                        raise OverflowError("a score is beyond 64 bits")
                    columns = [np.full(sum(sizes), number), np.repeat([x[0] for x in some], sizes), np.repeat([x[1] for x in some], sizes), np.concatenate([x[2] for x in some]), scores.astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["tile", "row", "query_id", "vec_id", "score"])

        for rows in batches:
            for kind, block, wide, ids, vectors, floors in zip(*(rows.column(i).to_pylist() for i in range(6)), strict=True):
                if kind == 0:
                    yield from results()
                    number, searches = block, parts(*_vectors(ids, vectors, wide, dims), np.frombuffer(floors, np.float64))
                else:
                    c = block_of(ids, vectors, wide)
                    for search in searches:
                        search.meet(c)
        yield from results()

    return dealt.select("kind", "block", "wide", "ids", "vectors", "floors").mapInArrow(searched, "tile long, row long, query_id long, vec_id long, score long")
