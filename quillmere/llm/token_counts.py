"""Token counts of whole texts; huge texts by overlapping chunks that are spliced where they agree.

A text of more than ``window`` characters is encoded in chunks that overlap. The library gives each token's
offset and the word (the pre-tokenizer's piece) that it belongs to, so each chunk says where words begin.
Two neighbouring chunks are spliced at a position where words begin in both. Such a position is proven stable:

* no token crosses the begin of a word, and the pre-tokenizer's pattern looks at nothing to its left, so from a
  position on where a word of the whole text begins, any chunk that begins a word there goes on as the whole text does;
* the left chunk is right up to ``MARGIN`` characters before its end, by induction from the last splice: what ends there
  has been decided by the characters that follow, and no special string that crosses the chunk's end can begin earlier.

Where the overlap holds no common position the alignment has failed, and it is widened fourfold, as far as the whole rest of
the text: a run of letters without any end is one word, which the library merges as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import bound_batches, released
from quillmere.llm.memo import SpaceMemo

WINDOW, OVERLAP = 32_768, 256
#: More than the characters of the vocabulary's longest special string and what its pattern looks ahead.
MARGIN = 16


def encode_words(tokenizer, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where words of ``text`` begin, in characters, and the tokens of each."""
    found = tokenizer.encode(text, add_special_tokens=False)
    words = np.array(found.word_ids, dtype=np.int64)
    if not len(words):
        return words, words
    first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
    offsets = found.offsets
    return np.array([offsets[i][0] for i in first], dtype=np.int64), np.diff(np.append(first, len(words)))


def count_spliced(tokenizer, text: str, window: int = WINDOW, overlap: int = OVERLAP) -> int:
    """Tokens of one text, encoded chunk by chunk and spliced."""

    def encoded(low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        begins, counts = encode_words(tokenizer, text[low:high])
        return begins + low, counts

    size, total, begin = len(text), 0, 0
    end = min(size, window + overlap)
    left = encoded(0, end)
    while end < size:
        wide = overlap
        while True:
            right_end = min(size, max(end - wide + window + overlap, end))
            right = encoded(max(begin, end - wide), right_end)
            common = np.intersect1d(left[0][(left[0] > begin) & (left[0] <= end - MARGIN)], right[0], assume_unique=True)
            if len(common):
                break
            wide *= 4
            end = min(size, max(end, begin + wide))
            left = encoded(begin, end)
            if end == size:
                return total + int(left[1].sum())
        point = int(common[-1])
        total += int(left[1][left[0] < point].sum())
        later = right[0] >= point
        left, end, begin = (right[0][later], right[1][later]), right_end, point
    return total + int(left[1].sum())


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, in bytes of UTF-8 and tokens of ``vocabulary``.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated and null ids keep
    one result a row; other columns of ``docs`` are ignored; no rows give none.
    """

    bound_batches(docs.sparkSession)

    @released
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = SpaceMemo.shared(vocabulary)
        for batch in batches:
            n_tokens = []
            for value in batch.column(1):
                text = value.as_py() or ""
                n_tokens.append(memo.count(text) if len(text) <= window else count_spliced(memo.tokenizer, text, window, overlap))
            tokens = np.array(n_tokens, dtype=np.int64)
            n_bytes = batch.column(2)
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(
        counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
