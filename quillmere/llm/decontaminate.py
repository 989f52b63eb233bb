"""Benchmark passages in documents, found by pigeonhole and Myers' bit-parallel distance.

Texts are sequences of words: runs of letters, marks and digits of any script, composed and lower-cased; everything else,
punctuation and symbols of any script, parts them. In scripts that are written without spaces (Chinese, Japanese, Thai and their
like) each character is a word. A document contains an item if some run of its words is
within the item's budget of word edits (insert, delete, replace). An item of n
words has a budget of ``rate`` * n. It is cut into budget + 1 pieces; an edit
touches one piece at most, so one piece stands unchanged in the document. Pieces
are found by hashes of word windows, all windows of a length at once; each hit is
verified by Myers' bit-parallel distance over the words around it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import bound_batches, durable, released, remove_path, scratch_path

RATE = 0.2
#: Items, and bytes of their texts, that a task holds at once; more are searched for in blocks, an item of more bytes in one of its own.
ITEMS, ITEM_BYTES = 20_000, 8 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Blocks of scripts without spaces between words.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]


class _Letters(dict):
    """Code point to what it stands for: itself in lower case, in unspaced scripts with a space on both sides, or a space."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        if unicodedata.category(c)[0] not in "LMN":
            value = " "
        elif any(a <= cp <= b for a, b in UNSPACED):
            value = f" {c} "
        else:
            value = c.lower()
        self[cp] = value
        return value


_LETTERS = _Letters()
#: The same for one-byte characters, none of which becomes several.
_TABLE = bytes(ord(_LETTERS[b]) for b in range(256))


def words_of(text: str | None) -> list[bytes] | list[str]:
    """Words in order; of a text of one-byte characters as Latin-1, for speed (``either`` gives the other form)."""
    text = text or ""
    try:
        return text.encode("latin-1").translate(_TABLE).split()
    except UnicodeEncodeError:
        pass
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.translate(_LETTERS).split()


def either(word: bytes | str) -> list[bytes | str]:
    """Both forms that a word may have, if it has two."""
    if isinstance(word, bytes):
        return [word, word.decode("latin-1")]
    try:
        return [word, word.encode("latin-1")]
    except UnicodeEncodeError:
        return [word]


def budget(n: int, rate: float) -> int:
    return int(n * rate + 1e-9)


def myers_ends(item: list[int], text: list[int], k: int) -> list[tuple[int, int]]:
    """(end, distance) of each end in ``text`` at which a run of it is within ``k`` edits of ``item``.

    Bits of a Python integer stand for the item's words, so an item may have any number.
    """
    m = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    every, top = (1 << m) - 1, 1 << m - 1
    up, down, score, found = every, 0, m, []
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq | down
        hp = down | ~(d | up) & every
        hn = up & d
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & every  # a run may begin anywhere, so nothing is carried in
        hn = hn << 1 & every
        up = hn | ~(x | hp) & every
        down = hp & x
        if score <= k:
            found.append((j + 1, score))
    return found


@dataclass
class Items:
    """Benchmark items by word numbers, and their pieces by length in words."""

    vocabulary: dict[bytes | str, int] = field(default_factory=dict)
    items: list[tuple[int, list[int], int]] = field(default_factory=list)  # id, words, budget
    #: Length to sorted hashes, and for each hash its (item, place) list.
    tables: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], rate: float, least: int = 1) -> Items:
        self = cls()
        n = 0
        by_length: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for item_id, text in rows:
            words = []
            for w in words_of(text):
                if w not in self.vocabulary:
                    n += 1
                    self.vocabulary.update(dict.fromkeys(either(w), n))
                words.append(self.vocabulary[w])
            if len(words) < max(1, least):
                continue
            k = budget(len(words), rate)
            number = len(self.items)
            self.items.append((item_id, words, k))
            edges = [len(words) * i // (k + 1) for i in range(k + 2)]
            ids = np.array(words, dtype=np.uint64)
            for begin, end in zip(edges, edges[1:]):
                value = int(window_hashes(ids[begin:end], end - begin)[0])
                by_length.setdefault(end - begin, {}).setdefault(value, []).append((number, begin))
        for length, pieces in by_length.items():
            hashes = np.array(sorted(pieces), dtype=np.uint64)
            self.tables[length] = (hashes, [pieces[int(h)] for h in hashes])
        return self

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, begin, end) of each item in the text: its best run, in words."""
        words = list(map(self.vocabulary.get, words_of(text)))
        ids = np.array([w or 0 for w in words], dtype=np.uint64)
        spans: dict[int, list[tuple[int, int]]] = {}
        for length, (hashes, where) in self.tables.items():
            if len(ids) < length:
                continue
            windows = window_hashes(ids, length)
            at = np.minimum(np.searchsorted(hashes, windows), len(hashes) - 1)
            for i in np.flatnonzero(hashes[at] == windows):
                for number, place in where[at[i]]:
                    _, item, k = self.items[number]
                    begin = int(i) - place
                    spans.setdefault(number, []).append((max(0, begin - k), min(len(words), begin + len(item) + k)))
        found = []
        listed = ids.tolist() if spans else []
        for number, parts in spans.items():
            item_id, item, k = self.items[number]
            best = None
            parts.sort()
            low, high = parts[0]
            merged = []
            for a, b in parts[1:]:
                if a <= high:
                    high = max(high, b)
                else:
                    merged.append((low, high))
                    low, high = a, b
            for a, b in [*merged, (low, high)]:
                for end, distance in myers_ends(item, listed[a:b], k):
                    if best is None or distance < best[0]:
                        best = (distance, a + end)
            if best:
                distance, end = best
                # The run's begin: the same search backwards from its end.
                low = max(0, end - len(item) - k)
                begin = next(end - e for e, d in myers_ends(item[::-1], listed[low:end][::-1], k) if d == distance)
                found.append((item_id, distance, begin, end))
        return found


def window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    n = len(ids) - length + 1
    mixed = np.full(n, length, dtype=np.uint64)
    for k in range(length):
        mixed = (mixed ^ ids[k : k + n]) * _MIX
        mixed ^= mixed >> np.uint64(32)
    return mixed


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least_words: int = 1, items_at_once: int = ITEMS, bytes_at_once: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, begin, end): each item that a document contains, with its best run in words of the document.

    Whole texts are searched. Null texts, and items or texts without words,
    contain nothing and are in nothing, and items of fewer than ``least_words`` words are not searched for. Rows with a null or the same id are searched
    each; ties go to the run that ends first. Other columns are ignored.
    ``benchmark`` is (item_id, text); beyond ``items_at_once`` rows or ``bytes_at_once`` bytes it is searched for in
    blocks, each with one pass over the documents.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    text = F.col("text").cast("string")
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).where("text is not null")
    n, size = bench.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # Twice as many as would do if they were dealt evenly; the hash only deals them.
    n_blocks = max(-(-n // items_at_once), -(-size // bytes_at_once), 1)
    n_blocks = 2 * n_blocks if n_blocks > 1 else 1
    bench = durable(bench.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))))
    searched = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    if n_blocks == 1:
        return _find(searched, bench, rate, least_words)
    # Each block's finds are written, so that no more than one block's items are in memory.
    path = scratch_path(spark, "found")
    for block in range(n_blocks):
        _find(searched, bench.where(F.col("block") == block), rate, least_words).write.mode("append").parquet(path)
    found = durable(spark.read.parquet(path))
    remove_path(spark, path)
    return found


def _find(docs: DataFrame, bench: DataFrame, rate: float, least: int) -> DataFrame:
    """The finds of one block of items."""
    rows = [tuple(r) for r in bench.select("item_id", "text").collect()]
    shared = docs.sparkSession.sparkContext.broadcast(Items.of(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), rate, least))

    @released
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for rows in batches:
            out = []
            for doc_id, value in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                out.extend((doc_id, *x) for x in items.search(value.as_py()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()], strict=True)], names=["doc_id", "item_id", "distance", "begin", "end"])

    return docs.mapInArrow(searched, "doc_id long, item_id long, distance int, begin long, end long")
