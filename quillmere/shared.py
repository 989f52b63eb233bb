"""What lies between jobs: intermediate tables in the folder that all executors share, and small local tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of rows that a Python worker is handed at once (one row at least).
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on this session hands Python workers at most ``BATCH_BYTES`` at once, however long its rows are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.rstrip("bB").isdigit() or not 0 < int(now.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder on one machine (tests), and an error on a cluster,
    whose executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not told:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = "file://" + tempfile.mkdtemp(prefix="quillmere-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(told)
    # Read by Spark whenever it checkpoints; without it nothing is ever deleted.
    spark._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return told


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, with its lineage cut.

    Spark's cleaner deletes the files when nothing refers to them any more (``shared_folder`` sees to its switch; ``swept``
    has it look at once), and a lost executor takes nothing with it.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table the caller deletes with ``remove_path``."""
    return f"{shared_folder(spark).rstrip('/')}/quillmere-{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables that a job keeps in the shared folder while it runs, deleted together when it is over."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def path(self, name: str = "kept") -> str:
        self.paths.append(scratch_path(self.spark, name))
        return self.paths[-1]

    def kept(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        while self.paths:
            remove_path(self.spark, self.paths.pop())


def swept(spark: SparkSession) -> None:
    """Has both sides look for what nothing refers to any more, so that checkpoints and shuffle files of a finished step go."""
    gc.collect()
    spark._jvm.System.gc()


def changed(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Files, bytes and the time of the last change under a path: other content is another triple."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    about = fs.getContentSummary(target)
    return about.getFileCount(), about.getLength(), fs.getFileStatus(target).getModificationTime()


def local_table(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A small table that is part of the plan, so that no task has to make it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return spark.createDataFrame(pa.table(columns, schema=to_arrow_schema(StructType.fromDDL(schema))), schema)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one, whatever their names."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in df.columns])


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
