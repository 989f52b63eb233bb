"""An approximate vector index: vectors in cells around centres, a search that reads the cells nearest to a query and scores what they hold exactly. [SEM12]

Centres are fitted on a bounded sample; every vector is in the index, in the cell of its nearest centre. Cells are folders, so a search reads
no file of any other cell. How many cells to probe is measured: ``tune`` raises it until the asked share of the true neighbours is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.operators import vector
from quillmere.shared import durable, local_table

#: Vectors that centres are fitted on at most, centres at most, turns of the fit, and queries that a task meets at once.
SAMPLE, CELLS, TURNS, QUERY_BLOCK = 20_000, 4096, 12, 1000


def nearest_centres(units: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each unit vector its nearest centre and the product with it, a tile of products at a time."""
    own, best = np.empty(len(units), np.int64), np.empty(len(units))
    for i in range(0, len(units), vector.TILE[0]):
        near = units[i : i + vector.TILE[0]] @ centres.T
        own[i : i + len(near)], best[i : i + len(near)] = near.argmax(axis=1), near.max(axis=1)
    return own, best


def probed_centres(units: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """Of each unit vector its ``probes`` nearest centres."""
    if not len(units):
        return np.empty((0, 0), np.int64)
    return np.concatenate([np.argsort(-(units[i : i + vector.TILE[0]] @ centres.T), axis=1, kind="stable")[:, :probes] for i in range(0, len(units), vector.TILE[0])])


def fit_centres(units: np.ndarray, cells: int, turns: int = TURNS, seed: int = 7) -> np.ndarray:
    """Unit centres of unit vectors, by spherical k-means; an empty cell is begun anew at the vector that lies worst."""
    rng = np.random.default_rng(seed)
    centres = units[rng.choice(len(units), min(cells, len(units)), replace=False)]
    for _ in range(turns):
        own, near = nearest_centres(units, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        worst = iter(np.argsort(near, kind="stable"))
        for empty in np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0):
            sums[empty] = units[next(worst)]
        centres = vector.unit(sums)
    return centres


@dataclass
class CellIndex:
    """``vectors`` (vec_id, embedding, cell) in folders by cell, and the centres, which are bounded by ``CELLS``."""

    vectors: DataFrame
    centres: np.ndarray

    @classmethod
    def save(cls, vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> CellIndex:
        """Of (vec_id, embedding). Without ``cells`` their number is the root of the vectors' number, ``CELLS`` at most.

        Rows without an id, and vectors that are null, of another length than most, or hold what is no finite number, are left out.
        """
        spark = vectors.sparkSession
        sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & vector.finite("embedding"))
        lengths = sound.groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").first()
        length, n = (lengths["length"], lengths["n"]) if lengths else (0, 0)
        sound = sound.where(F.size("embedding") == length)
        drawn = sound.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()["embedding"]
        units = vector.unit(np.array(drawn.tolist(), np.float64).reshape(len(drawn), length))
        centres = fit_centres(units, cells or min(CELLS, max(1, int(n**0.5)))) if len(units) else units
        shared = spark.sparkContext.broadcast(centres)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, _ = nearest_centres(vector.unit(vector.matrix(batch.column(1))), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["vec_id", "embedding", "cell"])

        dealt = sound.mapInArrow(placed, "vec_id long, embedding array<double>, cell int")
        # By range, so a cell that holds much is several files, written by several tasks.
        dealt.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id").write.partitionBy("cell").mode("overwrite").parquet(f"{path}/vectors")
        local_table(spark, {"cell": list(range(len(centres))), "centre": centres.tolist()}, "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CellIndex:
        held = spark.read.parquet(f"{path}/centres").orderBy("cell").toPandas()["centre"]
        read = spark.read.schema("vec_id long, embedding array<double>, cell int").parquet(f"{path}/vectors") if len(held) else spark.createDataFrame([], "vec_id long, embedding array<double>, cell int")
        return cls(read, np.array(held.tolist(), np.float64))

    def search(self, queries: DataFrame, top: int = 10, probes: int = 8, block: int = QUERY_BLOCK) -> DataFrame:
        """(query_id, vec_id, score, rank) of the nearest among the vectors of each query's ``probes`` cells; scores and ties as ``vector.search`` has them."""
        spark = self.vectors.sparkSession
        sound = durable(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where(F.col("query_id").isNotNull() & vector.finite("vector")).where(F.size("vector") == self.centres.shape[-1]))
        blocks = -(-sound.count() // block) or 1
        found = None
        for k in range(blocks):
            asked = sound.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).toPandas()
            ids, units = asked["query_id"].to_numpy(np.int64), vector.unit(np.array(asked["vector"].tolist(), np.float64).reshape(len(asked), self.centres.shape[-1]))
            probed = probed_centres(units, self.centres, probes)
            by_cell: dict[int, list[int]] = {}
            for row, own in enumerate(probed.tolist()):
                for cell in own:
                    by_cell.setdefault(cell, []).append(row)
            shared = spark.sparkContext.broadcast((ids, units, {c: np.array(r) for c, r in by_cell.items()}))

            def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                ids, units, rows_of = shared.value
                best = vector.Best(len(ids), top)
                for batch in batches:
                    cells, held = np.asarray(batch.column(2)), vector.unit(vector.matrix(batch.column(1)))
                    for cell in np.unique(cells):
                        at = np.flatnonzero(cells == cell)
                        best.meet(units, batch.column(0).to_numpy()[at], held[at], rows_of[int(cell)])
                yield best.batch(ids)

            part = self.vectors.where(F.col("cell").isin([int(c) for c in by_cell])).select("vec_id", "embedding", "cell").mapInArrow(nearest, "query_id long, vec_id long, score double")
            found = part if found is None else found.unionByName(part)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
        return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= top)

    def read_for(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, read): vectors in the cells that a query probes."""
        centres = self.centres

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = probed_centres(vector.unit(vector.matrix(batch.column(1))), centres, probes)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), own.shape[1])), pa.array(own.ravel().astype(np.int32))], names=["query_id", "cell"])

        asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where(F.col("query_id").isNotNull() & vector.finite("vector") & (F.size("vector") == centres.shape[-1]))
        # A row for each cell, of which there are `CELLS` at most.
        sizes = F.broadcast(self.vectors.groupBy("cell").agg(F.count("*").alias("n")))
        return asked.mapInArrow(probed, "query_id long, cell int").join(sizes, "cell").groupBy("query_id").agg(F.sum("n").alias("read"))

    def tune(self, queries: DataFrame, top: int = 10, recall: float = 0.9) -> int:
        """Probes, a power of two or all cells, with which the queries' ``top`` true neighbours are found to the share ``recall`` on average."""
        true = durable(vector.search(self.vectors, queries, top).select("query_id", "vec_id"))
        n, probes = true.count(), 1
        while probes < len(self.centres):
            if true.join(self.search(queries, top, probes), ["query_id", "vec_id"], "left_semi").count() >= recall * n:
                return probes
            probes *= 2
        return max(1, len(self.centres))

