"""An inverted index in segments that are never changed, so that keeping it up costs what has changed.

A folder holds ``segments/<id>`` (documents, postings, terms of what one call added), ``deletes/<id>`` (rows of older segments that no
longer count, and what their terms lose) and ``manifests/<version>``, which names what belongs together. A change writes new
files and then one manifest: who reads stays with the manifest they opened and sees all of a change or none; of two changes made
at once the second fails with ``Conflict`` and can be made again. Document frequencies are sums of what segments and deletes say.
When several segments are of like size they are merged into one; the files of others are left as they are.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce
from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import text as T
from quillmere.operators.index import Index, idf_smooth, postings
from quillmere.shared import remove_path

#: Ids of deleted rows that are broadcast, 16 bytes each; more are joined.
BROADCAST_DELETED = 1_000_000
#: Ids of changed documents that go to the scan of older segments as a filter; more are joined.
FILTER_IDS = 1000
#: Segments of like size (a power of this in postings) that are merged, and the share of deleted rows at which one is written anew.
FAN, WORN = 4, 0.5


class Conflict(RuntimeError):
    """Someone else has committed since this version was opened."""


@dataclass(frozen=True)
class Segment:
    """What the manifest says of a segment; ``deletes`` are folders, ``gone`` what they take away, by the same names as ``counts``."""

    id: str
    counts: dict[str, int]
    deletes: list[str] = field(default_factory=list)
    gone: dict[str, int] = field(default_factory=dict)

    def left(self, what: str) -> int:
        return self.counts[what] - self.gone.get(what, 0)


_COUNTED = ("documents", "filled", "tokens", "postings")


class SegmentedIndex:
    """One version of the index. Changes give the next one; this one goes on reading what it has."""

    def __init__(self, spark: SparkSession, path: str, version: int, segments: list[Segment], stemmed: bool):
        self.spark, self.path, self.version, self.segments, self.stemmed = spark, path.rstrip("/"), version, segments, stemmed

    # --- versions ---------------------------------------------------------------------------------------------
    @classmethod
    def create(cls, spark: SparkSession, path: str, stemmed: bool = True) -> SegmentedIndex:
        """An empty index in a folder that has none."""
        return cls(spark, path, 0, [], stemmed)._commit([])

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> SegmentedIndex:
        """The newest version, or a stated one."""
        version = max(_versions(spark, path)) if version is None else version
        told = json.loads("".join(r[0] for r in spark.read.text(_manifest(path, version), wholetext=True).collect()))
        return cls(spark, path, version, [Segment(**s) for s in told["segments"]], told["stemmed"])

    def _commit(self, segments: list[Segment]) -> SegmentedIndex:
        """Writes the next manifest, which must not be there yet."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(_manifest(self.path, self.version + 1))
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        told = json.dumps({"stemmed": self.stemmed, "segments": [vars(s) for s in segments]})
        try:
            out = fs.create(target, False)
        except Exception as e:
            if not fs.exists(target):
                raise
            raise Conflict(f"version {self.version + 1} of {self.path} is there already") from e
        out.write(told.encode())
        out.close()
        return SegmentedIndex(self.spark, self.path, self.version + 1, segments, self.stemmed)

    def _read(self, kind: str, name: str, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}/{name}/{part}")

    # --- reading ----------------------------------------------------------------------------------------------
    def _deleted(self, segment: Segment) -> DataFrame | None:
        """Ids of the segment's rows that no longer count."""
        if not segment.deletes:
            return None
        ids = reduce(DataFrame.unionByName, [self._read("deletes", d, "ids").where(F.col("segment") == segment.id).select("doc_id") for d in segment.deletes])
        return F.broadcast(ids) if segment.gone["documents"] <= BROADCAST_DELETED else ids

    def _live(self, segment: Segment, part: str) -> DataFrame:
        rows, gone = self._read("segments", segment.id, part), self._deleted(segment)
        return rows if gone is None else rows.join(gone, "doc_id", "left_anti")

    def _all(self, part: str, schema: str) -> DataFrame:
        live = [self._live(s, part) for s in self.segments]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), live) if live else self.spark.createDataFrame([], schema)

    def documents(self) -> DataFrame:
        return self._all("documents", "doc_id long, text string, head string")

    def postings(self) -> DataFrame:
        return self._all("postings", "term string, doc_id long, tf long, dl long")

    def frequencies(self) -> DataFrame:
        """(term, df): what segments have, less what deletes take. [AGG4, AGG7]"""
        parts = [self._read("segments", s.id, "terms") for s in self.segments]
        parts += [self._read("deletes", d, "terms").where(F.col("segment") == s.id).select("term", "df") for s in self.segments for d in s.deletes]
        if not parts:
            return self.spark.createDataFrame([], "term string, df long")
        return reduce(DataFrame.unionByName, parts).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def sizes(self) -> dict[str, int]:
        return {k: sum(s.left(k) for s in self.segments) for k in _COUNTED}

    def index(self) -> Index:
        """This version for the searches of ``index``: the tables, the number of documents and their mean length."""
        n = self.sizes()
        terms = self.frequencies().withColumn("idf", idf_smooth(F.lit(n["documents"]), F.col("df")))
        return Index(self.documents(), self.postings(), terms, n["documents"], n["tokens"] / n["filled"] if n["filled"] else 0.0)

    # --- changing ---------------------------------------------------------------------------------------------
    def _write_segment(self, docs: DataFrame | None, post: DataFrame | None = None, documents: DataFrame | None = None) -> Segment | None:
        """A new segment of documents, whose postings come from what was written, or of live rows that are merged; None where there are no rows."""
        name = uuid.uuid4().hex
        at = f"{self.path}/segments/{name}"
        rows = documents if docs is None else docs.withColumn("head", F.substring("text", 1, 200))
        rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.option("parquet.block.size", 8 << 20).parquet(f"{at}/documents")
        post = postings(self._read("segments", name, "documents"), stemmed=self.stemmed) if post is None else post
        post.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.option("parquet.block.size", 2 << 20).parquet(f"{at}/postings")
        saved = self._read("segments", name, "postings")
        saved.groupBy("term").agg(F.count("*").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/terms")
        sums = saved.agg(F.count("*"), F.coalesce(F.sum("tf"), F.lit(0)), F.count_distinct("doc_id")).first()
        counts = {"documents": self._read("segments", name, "documents").count(), "filled": sums[2], "tokens": sums[1], "postings": sums[0]}
        if not counts["documents"]:
            remove_path(self.spark, at)
            return None
        return Segment(name, counts)

    def _without(self, ids: DataFrame) -> list[Segment]:
        """The segments, with rows of these ids deleted wherever they still count. Only the deleted rows' own texts are read."""
        if not self.segments:
            return []
        few = [r["doc_id"] for r in ids.limit(FILTER_IDS + 1).collect()]
        wanted = (lambda df: df.where(F.col("doc_id").isin(few))) if len(few) <= FILTER_IDS else (lambda df: df.join(ids, "doc_id", "left_semi"))
        hit = reduce(DataFrame.unionByName, [wanted(self._live(s, "documents").select("doc_id", "text")).withColumn("segment", F.lit(s.id)) for s in self.segments])
        name = uuid.uuid4().hex
        at = f"{self.path}/deletes/{name}"
        lost = postings(hit.select(F.struct("segment", "doc_id").alias("doc_id"), "text"), stemmed=self.stemmed)
        hit.select("segment", "doc_id").repartition("segment").write.parquet(f"{at}/ids")
        lost.groupBy(F.col("doc_id.segment").alias("segment"), "term").agg((-F.count("*")).alias("df")).write.parquet(f"{at}/terms")
        by_doc = hit.select("segment", F.size(T.terms(F.col("text"))).alias("dl"))
        sums = {r["segment"]: r for r in by_doc.groupBy("segment").agg(F.count("*").alias("documents"), F.count(F.when(F.col("dl") > 0, 1)).alias("filled"), F.sum("dl").alias("tokens")).collect()}
        entries = {r["segment"]: -r["n"] for r in self._read("deletes", name, "terms").groupBy("segment").agg(F.sum("df").alias("n")).collect()}
        if not sums:
            remove_path(self.spark, at)
            return list(self.segments)
        found = []
        for s in self.segments:
            if s.id in sums:
                lost_here = {k: sums[s.id][k] for k in ("documents", "filled", "tokens")} | {"postings": entries.get(s.id, 0)}
                s = Segment(s.id, s.counts, [*s.deletes, name], {k: s.gone.get(k, 0) + lost_here[k] for k in _COUNTED})
            found.append(s)
        return [s for s in found if s.left("documents")]

    def add(self, docs: DataFrame) -> SegmentedIndex:
        """The next version, with these documents (doc_id, text, any other columns); one whose doc_id is known takes the old one's place. [SNK4]

        Rows with a null doc_id are left out; of rows with one doc_id the one with the greatest text counts. No rows change nothing but the version.
        """
        rows = docs.where("doc_id is not null").withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
        rows = rows.groupBy("doc_id").agg(F.max_by(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]), "text").alias("_r")).select("_r.*")
        new = self._write_segment(rows)
        if new is None:
            return self._commit(self.segments)
        old = self._without(self._read("segments", new.id, "documents").select("doc_id"))
        return self._commit(self._merged([*old, new]))

    def remove(self, ids: DataFrame) -> SegmentedIndex:
        """The next version, without the documents of these ids (doc_id); unknown and null ids change nothing."""
        return self._commit(self._merged(self._without(ids.select("doc_id").where("doc_id is not null").distinct())))

    def _merged(self, segments: list[Segment]) -> list[Segment]:
        """Segments after the merge policy: ``FAN`` of like size become one, and one that is mostly deleted is written anew."""
        while True:
            tiers: dict[int, list[Segment]] = {}
            for s in segments:
                tiers.setdefault(int(log(max(s.left("postings"), 1), FAN)), []).append(s)
            group = next((g for _, g in sorted(tiers.items()) if len(g) >= FAN), None) or next(([s] for s in segments if s.gone.get("documents", 0) > WORN * s.counts["documents"]), None)
            if group is None:
                return segments
            parts = lambda x: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self._live(s, x) for s in group])
            one = self._write_segment(None, parts("postings"), parts("documents"))
            segments = [*[s for s in segments if s not in group], *([one] if one else [])]

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what none of the newest ``keep`` versions names, older manifests too; gives the number of folders and manifests deleted.

        Readers of older versions lose them, and a change that is under way its new files, so this is for when there is neither.
        """
        versions = sorted(_versions(self.spark, self.path))
        kept = [SegmentedIndex.open(self.spark, self.path, v) for v in versions[-keep:]]
        named = {f"segments/{s.id}" for v in kept for s in v.segments} | {f"deletes/{d}" for v in kept for s in v.segments for d in s.deletes}
        stale = [f"{kind}/{x}" for kind in ("segments", "deletes") for x in _listed(self.spark, f"{self.path}/{kind}") if f"{kind}/{x}" not in named]
        for x in stale:
            remove_path(self.spark, f"{self.path}/{x}")
        for v in versions[:-keep]:
            remove_path(self.spark, _manifest(self.path, v))
        return len(stale) + len(versions[:-keep])


def _manifest(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/manifests/{version:08d}.json"


def _listed(spark: SparkSession, path: str) -> list[str]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose manifest has been written whole (an empty one has not)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/manifests")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [int(s.getPath().getName()[:8]) for s in fs.listStatus(target) if s.getLen() > 0 and s.getPath().getName().endswith(".json")]
