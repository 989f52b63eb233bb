"""Folders of crawled pages as a data source of Spark's: ``<path>/<domain>/<file>.json``, one page to a file, in batch and as a stream.

    register(spark)
    spark.read.format("crawled_pages").load("crawl")                              # a task for each domain, large ones in parts
    spark.readStream.format("crawled_pages").option("domains", "a.se,b.se").load("crawl")

A stream's offset is the latest (time of change, path) that it has taken, so a file is read once, again if it is written anew, and a
stream that is started again goes on where it was. Files change names or come with other clocks at one's own risk: ``settle`` seconds
must have passed since a file's change before a stream takes it, so that none of an earlier time can follow. What is no JSON object with url and content is passed over. [SRC1, SRC5, SRC7]
"""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quillmere.session import ship_package

#: Files of a domain that one task reads.
PART = 2000
_TEXTS = ("url", "domain", "title", "content", "html", "meta_description", "meta_keywords", "language", "crawled_at", "content_hash")
SCHEMA = StructType([*(StructField(x, StringType()) for x in _TEXTS), StructField("links", ArrayType(StringType())), StructField("status_code", IntegerType()), StructField("word_count", IntegerType())])


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


def _opened(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(path: str, domains: set[str] | None) -> list[tuple[str, int, str]]:
    """(domain, time of change in nanoseconds, path) of the JSON files."""
    from pyarrow import fs

    system, root = _opened(path)
    found = []
    for folder in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if folder.type == fs.FileType.Directory and (domains is None or folder.base_name in domains):
            found += [(folder.base_name, f.mtime_ns or 0, f.path) for f in system.get_file_info(fs.FileSelector(folder.path)) if f.type == fs.FileType.File and f.extension == "json"]
    return sorted(found)


def _parts(files: list[tuple[str, int, str]]) -> list[Files]:
    by_domain: dict[str, list[str]] = {}
    for domain, _, path in files:
        by_domain.setdefault(domain, []).append(path)
    return [Files(paths[low : low + PART]) for paths in by_domain.values() for low in range(0, len(paths), PART)]


def _whole(value: object) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and -(2**31) <= value < 2**31 else None


def page_row(data: bytes) -> tuple | None:
    """A page from its file, or None where that is no JSON object with url and content. Fields of another kind are null."""
    try:
        page = json.loads(data)
    except ValueError:
        return None
    if not isinstance(page, dict) or not isinstance(page.get("url"), str) or not isinstance(page.get("content"), str):
        return None
    texts = [page.get(x) if isinstance(page.get(x), str) else None for x in _TEXTS]
    links = [x for x in page["links"] if isinstance(x, str)] if isinstance(page.get("links"), list) else None
    return (*texts, links, _whole(page.get("status_code")), _whole(page.get("word_count")))


def _read(path: str, files: Files | None) -> Iterator[tuple]:
    if files is None:  # what Spark asks for where there is no part
        return
    system, _ = _opened(path)
    for name in files.paths:
        try:
            with system.open_input_stream(name) as stream:
                row = page_row(stream.read())
        except FileNotFoundError:  # gone since it was listed
            continue
        if row:
            yield row


class _Batch(DataSourceReader):
    def __init__(self, path: str, domains: set[str] | None):
        self.path, self.domains = path, domains

    def partitions(self) -> list[InputPartition]:
        return _parts(_listed(self.path, self.domains))

    def read(self, partition: Files) -> Iterator[tuple]:
        return _read(self.path, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, domains: set[str] | None, settle: float):
        self.path, self.domains, self.settle = path, domains, settle

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        until = time.time_ns() - int(self.settle * 1e9)
        at, path = max(((at, path) for _, at, path in _listed(self.path, self.domains) if at <= until), default=(-1, ""))
        return {"at": at, "path": path}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = (start["at"], start["path"]), (end["at"], end["path"])
        return _parts([f for f in _listed(self.path, self.domains) if low < (f[1], f[2]) <= high])

    def read(self, partition: Files) -> Iterator[tuple]:
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class CrawledPages(DataSource):
    """Options: ``path``; ``domains``, a list with commas; ``settle`` seconds for streams (2)."""

    @classmethod
    def name(cls) -> str:
        return "crawled_pages"

    def schema(self) -> StructType:
        return SCHEMA

    def _asked(self) -> tuple[str, set[str] | None]:
        named = self.options.get("domains")
        return self.options["path"], {d.strip() for d in named.split(",")} if named else None

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(*self._asked())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(*self._asked(), float(self.options.get("settle", 2)))


def compared(batch: DataFrame, stream: DataFrame, marked: str) -> DataFrame:
    """The rows that both hold, as often as both do; of what one holds more of, the rest with the ``marked`` column saying which. Each side is read once."""
    sides = batch.withColumn("_more", F.lit(1)).unionByName(stream.withColumn("_more", F.lit(-1)))
    counted = sides.groupBy(*batch.columns).agg(F.count("*").alias("_n"), F.sum("_more").alias("_more"))
    both = ((F.col("_n") - F.abs("_more")) / 2).cast("int")
    rest = F.when(F.col("_more") > 0, "only in batch").otherwise("only in the stream")
    told = counted.withColumn("_told", F.explode(F.concat(F.array_repeat(F.col(marked), both), F.array_repeat(rest, F.abs("_more").cast("int")))))
    return told.select(*[F.col("_told" if c == marked else c).alias(c) for c in batch.columns])


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(CrawledPages)


# The workers that plan a read know nothing of files that were added to the session, so what is here goes to them whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
