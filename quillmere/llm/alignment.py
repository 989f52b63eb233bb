"""Alignment of two tokenizers' tokens, and how often each pair of token ids is linked in the whole corpus.

1. Each text is encoded by both libraries; byte offsets where tokens of both end part it into groups. Between two
   neighbouring ends, of either side, lies what one A token and one B token have in common: those are the links, each packed into
   one int64, the B id above the A id.
2. Tasks count their keys with np.unique; the partial counts are sorted in one global order by a range partitioning, and
   run lengths are summed in each range. A range is written as a shard of sorted keys and counts.
3. Tasks map the shards into memory and look the keys of their documents up by searchsorted. The highest count of each B id,
   one number an id of the vocabulary, is all that the driver sees.

A text is cut at single spaces between other characters: there a token begins on both sides (the byte-level pre-tokenizer starts a piece
with the space, and no piece of B holds a space after another character), so groups never cross it, and what has been found for a short
piece is remembered. A single line feed, and closing punctuation between a Latin-1 letter and a space, are parts by themselves where no piece of B has a
line feed or such punctuation after a letter. ``Aligner`` checks the vocabulary for all that and cuts less, or not at all, otherwise.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import Scratch, bound_batches, durable, partitions_of, released
from quillmere.llm.memo import CLOSING, SpaceMemo, library_tokenizer

#: Characters of a piece that is remembered, and bytes of the memory.
LONGEST, LIMIT = 64, 64 << 20
#: Distinct keys that a task adds up before it hands them on.
HELD = 4 << 20
_CUT = re.compile("(?<=[^\\s▁᠎]) (?=[^\\s▁᠎])")

#: What a part begins with that has no space before it.
BARE = "\0"
_CLOSED = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff][.,;:!?]")
_OPEN = re.compile("^[\\s▁\u180e]|[\\s▁\u180e]\\Z|^\\Z")


def _byte_level() -> dict[str, int]:
    """What a byte-level vocabulary writes for each byte: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(other)}


class Aligner:
    """Both libraries with their tokens' bytes, and a memory of pieces."""

    def __init__(self, byte_level: str, pieces: str):
        from sentencepiece import SentencePieceProcessor

        self.a = library_tokenizer(byte_level)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=pieces)
        table = _byte_level()
        self.a_bytes = [bytes(map(table.__getitem__, t)) if all(c in table for c in t) else t.encode() for t in map(self.a.id_to_token, range(self.a.get_vocab_size()))]
        written = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(written)]
        self.cut = not any("▁" in p.lstrip("▁") for p in written) and self.b_bytes[self.b.encode("a")[0]][:1] == b" "
        self.a_length, self.b_length = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.memory, self.old, self.size = {}, {}, 0
        #: What a piece that has no space before it is encoded after, and its value.
        self.before = {k: self._together([k])[k] for k in ("a", "a\n")}
        self.fine = self.cut and not any("\n" in p or _CLOSED.search(p) for p in written) and all(self.before.values())

    @classmethod
    @lru_cache(maxsize=1)
    def shared(cls, byte_level: str, pieces: str) -> Aligner:
        """The aligner of this process."""
        return cls(byte_level, pieces)

    def align(self, pieces: list[str]) -> dict[str, tuple | bool]:
        """Each piece with (A tokens, B tokens, groups, keys of its links, groups in writing) of a space and it, or of it alone where it begins with ``BARE``; False where bytes differ."""
        bare = {p: "a" if p == BARE + "\n" else "a\n" for p in pieces if p[:1] == BARE}
        found = self._together(list(dict.fromkeys([*(x + p[1:] for p, x in bare.items()), *(p for p in pieces if p not in bare)])))
        return {p: self._after(found[bare[p] + p[1:]], self.before[bare[p]]) if p in bare else found[p] for p in pieces}

    def _together(self, pieces: list[str]) -> dict[str, tuple | bool]:
        """The same without marks. Pieces are encoded as one text, which has a boundary of both sides after each; those with white space at an end alone."""
        if len(pieces) > 1 and any(map(_OPEN.search, pieces)):
            whole = [p for p in pieces if not _OPEN.search(p)]
            found = self._together(whole) if whole else {}
            return found | {p: v for x in pieces if x not in found for p, v in self._together([x]).items()}
        text = " ".join(pieces)
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        real = (" " + text).encode("utf-8", "surrogatepass")
        if b"".join(map(self.a_bytes.__getitem__, a)) != real or b"".join(map(self.b_bytes.__getitem__, b)) != real:
            return {pieces[0]: False} if len(pieces) == 1 else {p: found for x in pieces for p, found in self._together([x]).items()}
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_length[a_ids]), np.cumsum(self.b_length[b_ids])
        ends = np.union1d(a_ends, b_ends)
        keys = b_ids[np.searchsorted(b_ends, ends)] << 32 | a_ids[np.searchsorted(a_ends, ends)]
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_stops, b_stops = (np.searchsorted(a_ends, common) + 1).tolist(), (np.searchsorted(b_ends, common) + 1).tolist()
        a_text, b_text, groups, i, j = list(map(str, a)), list(map(str, b)), [], 0, 0
        for p, q in zip(a_stops, b_stops, strict=True):
            groups.append(f"{a_text[i] if p == i + 1 else ','.join(a_text[i:p])}|{b_text[j] if q == j + 1 else ','.join(b_text[j:q])}")
            i, j = p, q
        stops = np.cumsum([1 + len(x.encode("utf-8", "surrogatepass")) for x in pieces])
        places = [np.searchsorted(x, stops, side="right").tolist() for x in (a_ends, b_ends, common, ends)]
        found, (i, j, g, k), data = {}, (0, 0, 0, 0), keys.tobytes()
        for piece, p, q, h, m in zip(pieces, *places, strict=True):
            found[piece] = p - i, q - j, h - g, data[8 * k : 8 * m], ";".join(groups[g:h])
            i, j, g, k = p, q, h, m
        return found

    @staticmethod
    def _after(whole: tuple | bool, first: tuple) -> tuple | bool:
        """The value of what stands after ``first``, of which no token reaches beyond."""
        if not whole:
            return False
        return whole[0] - first[0], whole[1] - first[1], whole[2] - first[2], whole[3][len(first[3]) :], whole[4][len(first[4]) + 1 :]

    def pieces(self, text: str) -> list[str]:
        """Parts of a text with a space before each that does not begin with ``BARE``."""
        if self.fine and "▁" not in text and SpaceMemo.plain(text):
            text = CLOSING.sub(f" {BARE}\\1", text)
            if "\n\n" not in text and "\t" not in text and "\r" not in text and text[:1] != "\n" and text[-1:] != "\n":
                text = text.replace("\n", f" {BARE}\n {BARE}")
            return text.split(" ")
        return _CUT.split(text) if self.cut else [text]

    def known(self, pieces: set[str]) -> dict[str, tuple | bool]:
        """What is remembered of the pieces, and the rest aligned; those that are not too long are remembered from now on."""
        if self.size >= LIMIT:
            self.memory, self.old, self.size = {}, self.memory, 0
        found, memory, old = {}, self.memory, self.old
        new = []
        for piece in pieces:
            value = memory.get(piece)
            if value is None:
                new.append(piece)
            else:
                found[piece] = value
        if new:
            values = {p: old[p] for p in new if p in old}
            if missing := [p for p in new if p not in values]:
                values |= self.align(missing)
            found |= values
            for piece, value in values.items():
                if len(piece) <= LONGEST:
                    memory[piece] = value
                    self.size += 400 + 2 * len(piece) + (len(value[3]) + len(value[4]) if value else 0)
        return found

    def text(self, text: str | None) -> tuple[int, int, int, str, np.ndarray]:
        """(A tokens, B tokens, groups, digest of the groups, keys of the links) of a whole text; zeros, an empty digest and no keys where it has no tokens."""
        none = 0, 0, 0, "", np.empty(0, np.int64)
        if not text:
            return none
        pieces = self.pieces(text) if BARE not in text else [text]
        known = self.known(set(pieces)) if BARE not in text else self._together(pieces)
        if False in known.values():
            return none
        n_a, n_b, n_groups, keys, groups = zip(*map(known.__getitem__, pieces), strict=True)
        return sum(n_a), sum(n_b), sum(n_groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), np.frombuffer(b"".join(keys), np.int64)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return found, total


def _links(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """A row a document: counts, digest, and its distinct keys (as differences) and their counts as int64 in bytes."""

    @released
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.shared(byte_level, pieces)
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "counts"]
        for batch in batches:
            rows = []
            for value in batch.column(1):
                n_a, n_b, n_groups, digest, links = aligner.text(value.as_py())
                keys, counts = np.unique(links, return_counts=True)
                rows.append((n_a, n_b, n_groups, len(links), digest, np.diff(keys, prepend=np.int64(0)).tobytes(), counts.astype(np.int64).tobytes()))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, counts binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(aligned, schema)


def _unpacked(batch: pa.RecordBatch, keys: str = "keys", counts: str = "counts") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for k, c in zip(batch.column(keys), batch.column(counts), strict=True):
        yield np.cumsum(np.frombuffer(k.as_py(), np.int64)), np.frombuffer(c.as_py(), np.int64)


def _partial(links: DataFrame) -> DataFrame:
    """(key, n): each task's sums, in parts of a bounded number of keys."""

    @released
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            found, total = summed(keys, counts)
            for low in range(0, len(found), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(found[low : low + (1 << 18)]), pa.array(total[low : low + (1 << 18)])], names=["key", "n"])

        for batch in batches:
            for k, c in _unpacked(batch):
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held >= HELD:
                    found, total = summed(keys, counts)
                    keys, counts, held = [found], [total], len(found)
                    if held >= HELD // 2:
                        yield from out()
                        keys, counts, held = [], [], 0
        yield from out()

    return links.select("keys", "counts").mapInArrow(added, "key long, n long")


def _shards(partial: DataFrame, folder: str) -> DataFrame:
    """Writes each range of the sorted keys as a shard; gives (shard, low, size, b, best), a row for each B id of a shard.

    A shard is two files of int64, keys in order and their counts. They get their name when they are whole, so a task that is
    run again, or twice, changes nothing.
    """

    @released
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        names = [f"{folder}/{number:06d}.{x}" for x in ("keys", "counts")]
        low, size, last_key, last_n = None, 0, None, 0
        best = {}
        with open(f"{names[0]}.{attempt}", "wb") as key_file, open(f"{names[1]}.{attempt}", "wb") as count_file:

            def put(keys: np.ndarray, counts: np.ndarray) -> None:
                nonlocal low, size
                if len(keys):
                    low = int(keys[0]) if low is None else low
                    size += len(keys)
                    key_file.write(keys.tobytes())
                    count_file.write(counts.tobytes())
                    ids, first = np.unique(keys >> 32, return_index=True)
                    for b, n in zip(ids.tolist(), np.maximum.reduceat(counts, first).tolist(), strict=True):
                        best[b] = max(best.get(b, 0), n)

            for batch in batches:
                keys, n = (np.asarray(batch.column(i)) for i in range(2))
                if not len(keys):
                    continue
                if last_key is not None:
                    keys, n = np.concatenate(([last_key], keys)), np.concatenate(([last_n], n))
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                keys, n = keys[first], np.add.reduceat(n, first)
                # The last run may go on in the next batch.
                last_key, last_n = int(keys[-1]), int(n[-1])
                put(keys[:-1], n[:-1])
            if last_key is not None:
                put(np.array([last_key], np.int64), np.array([last_n], np.int64))
        for name in names:
            os.replace(f"{name}.{attempt}", name)
        if best:
            k = len(best)
            columns = [pa.array([number] * k, pa.int64()), pa.array([low] * k, pa.int64()), pa.array([size] * k, pa.int64()), pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "low", "size", "b", "best"])

    ranged = partial.repartitionByRange(partitions_of(partial.sparkSession), "key").sortWithinPartitions("key")
    return ranged.mapInArrow(written, "shard long, low long, size long, b long, best long")


class Shards:
    """Counts of keys from sorted shards that are mapped into memory when they are first asked."""

    def __init__(self, folder: str, about: list[tuple[int, int, int]]):
        self.folder, self.about = folder, sorted(about, key=lambda x: x[1])
        self.lows, self.open = np.array([x[1] for x in self.about], np.int64), {}

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Of ascending keys, all of which some shard has."""
        found = np.empty(len(keys), np.int64)
        cuts = np.append(np.searchsorted(keys, self.lows), len(keys))
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            if k not in self.open:
                number, _, size = self.about[k]
                self.open[k] = tuple(np.memmap(f"{self.folder}/{number:06d}.{x}", np.int64, "r", shape=(size,)) for x in ("keys", "counts"))
            own, counts = self.open[k]
            part = slice(cuts[k], cuts[k + 1])
            found[part] = counts[np.searchsorted(own, keys[part])]
        return found


def _looked_up(links: DataFrame, partial: DataFrame, scratch: Scratch, folder: str) -> DataFrame:
    """(doc_id, ..., n_best, count_sum) by shards in a folder that all tasks can open."""
    os.makedirs(folder, exist_ok=True)
    written = scratch.kept(_shards(partial, folder))
    about = [tuple(r) for r in written.select("shard", "low", "size").distinct().collect()]
    # One number for each id of B's vocabulary.
    best = {r["b"]: r["best"] for r in written.groupBy("b").agg(F.max("best").alias("best")).collect()}
    highest = np.zeros(max(best, default=0) + 1, np.int64)
    highest[list(best)] = list(best.values())
    sent = links.sparkSession.sparkContext.broadcast(highest)

    @released
    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder, about)
        for batch in batches:
            rows = list(_unpacked(batch))
            ends = np.cumsum([len(k) for k, _ in rows], dtype=np.int64)
            keys, n = (np.concatenate([r[i] for r in rows] or [np.empty(0, np.int64)]) for i in range(2))
            asked, at = np.unique(keys, return_inverse=True)
            counts = shards.counts(asked)[at]
            sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[ends], prepend=0) for x in (np.where(counts == sent.value[keys >> 32], n, 0), n * counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *map(pa.array, sums)], names=[*batch.schema.names[:6], "n_best", "count_sum"])

    return links.mapInArrow(looked_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def _joined(links: DataFrame, partial: DataFrame, scratch: Scratch) -> DataFrame:
    """The same by joins, for a shared folder that Python cannot open: keys go out as rows and come back as sums."""
    counts = scratch.kept(partial.groupBy("key").agg(F.sum("n").alias("count")))
    best = counts.groupBy(F.shiftright("key", 32).alias("b")).agg(F.max("count").alias("best"))
    counts = counts.withColumn("b", F.shiftright("key", 32)).join(F.broadcast(best), "b").select("key", "count", (F.col("count") == F.col("best")).cast("long").alias("is_best"))
    # The numbers of rows are fixed by writing them down.
    numbered = scratch.kept(links.withColumn("_row", F.monotonically_increasing_id()))

    @released
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, (keys, n) in zip(batch.column("_row"), _unpacked(batch), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number.as_py())), pa.array(keys), pa.array(n)], names=["_row", "key", "links"])

    asked = numbered.select("_row", "keys", "counts").mapInArrow(rows, "_row long, key long, links long")
    sums = asked.join(counts, "key").groupBy("_row").agg(F.sum(F.col("links") * F.col("is_best")).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    found = numbered.drop("keys", "counts").join(sums, "_row", "left").drop("_row")
    return found.fillna(0, ["n_best", "count_sum"])


def align_tokens(docs: DataFrame, byte_level: str, pieces: str, mapped: bool | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of ``docs``.

    A is the byte-level vocabulary, given a space and the text, B the one of pieces, which adds that space itself. Null and empty texts, and those
    that either side does not give back byte for byte, have zeros and an empty digest. Repeated texts count each time,
    repeated and null ids keep one result a row; other columns are ignored; no rows give none. ``mapped``: whether counts are looked up in shards mapped into
    memory or joined; by default the first where the shared folder is one that Python can open.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark)
    links = scratch.kept(_links(docs, byte_level, pieces))
    partial = scratch.kept(_partial(links))
    place = urlparse(scratch.path("shards"))
    mapped = place.scheme in ("", "file") if mapped is None else mapped
    found = _looked_up(links, partial, scratch, unquote(place.path)) if mapped else _joined(links, partial, scratch)
    found = durable(found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
    scratch.clear()
    return found
