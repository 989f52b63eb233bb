"""What several operators of this subpackage share: batches bounded in bytes, held-out ids and input tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.shared import BATCH_BYTES, Scratch, bound_batches, durable, partitions_of, quoted, remove_path, scratch_path, shared_folder, swept, whole_row

__all__ = ["BATCH_BYTES", "SPACE_BYTES", "Scratch", "bound_batches", "durable", "held_out", "partitions_of", "quoted", "released", "remove_path", "scratch_path", "shared_folder", "swept", "table", "whole_row"]

#: White space of the contracts: space and the control characters tab to carriage return.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def released(f: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task's function that gives what it no longer needs back to the system when it ends.

    Python workers serve one task after the other, and the C library keeps freed blocks of a few megabytes, so that without
    this a worker holds the largest amount that any task before has needed.
    """

    @wraps(f)
    def run(*streams):
        try:
            yield from f(*streams)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 2 by 4. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

