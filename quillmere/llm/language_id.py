"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds
(multiplies) its letters' vectors, each permuted (rotated) by its place; a text's
vector bundles (adds) the vectors of all its n-grams; a language's prototype
bundles those of its texts. A text gets the language whose prototype has the
highest cosine with it.

As bundling is a sum, a bundle is a sum over n-gram counts: a task counts first and
then adds up each n-gram's vector as often as it occurs, and scoring multiplies a
batch's count matrix with the vectors of the n-grams that the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import bound_batches, released, whole_row

#: Symbols: 0 for what is no letter, 1 to 26 for a to z, the rest for other letters by their code point.
SYMBOLS, N = 64, 3
#: Characters of a text that are worked on at once.
PIECE = 250_000
#: Languages whose counts a task holds at once, 2 MB each.
LANGUAGES = 32
#: Cells of a dense count matrix that are held at once.
MATRIX = 4_000_000


def _symbol_table() -> np.ndarray:
    """Symbol of every code point, by lower-cased letter."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            lower = ord(c.lower()[0])
            table[cp] = lower - 96 if 97 <= lower <= 122 else 27 + lower * 40503 % 65536 % (SYMBOLS - 27)
    return table


_TABLE: list[np.ndarray] = []


def symbols(text: str) -> Iterator[np.ndarray]:
    """Symbols of a text in pieces, runs of non-letters as one, with one at either end. A text without letters gives none."""
    if not _TABLE:
        _TABLE.append(_symbol_table())
    last, begun = 0, False
    for at in range(0, len(text), PIECE):
        codes = _TABLE[0][np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        keep = codes != 0
        keep[1:] |= codes[:-1] != 0
        keep[0] |= last != 0
        last, codes = codes[-1], codes[keep]
        if len(codes):
            yield codes if begun else np.concatenate([[0], codes]).astype(np.uint8)
            begun = True
    if last:
        yield np.zeros(1, np.uint8)


def gram_ids(codes: np.ndarray) -> np.ndarray:
    """Number of each n-gram. A text of at least one letter has at least one."""
    wide = codes.astype(np.int32)
    return (wide[:-2] * SYMBOLS + wide[1:-1]) * SYMBOLS + wide[2:]


def text_grams(text: str | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Number of each n-gram of a text, one for each place; or of a text of several pieces the distinct ones and how often each occurs."""
    text = text or ""
    if len(text) <= PIECE:
        return gram_ids(np.concatenate([np.empty(0, np.uint8), *symbols(text)])), None
    totals, carry = np.zeros(SYMBOLS**N, dtype=np.int64), np.empty(0, np.uint8)
    for codes in symbols(text):
        codes = np.concatenate([carry, codes])
        totals += np.bincount(gram_ids(codes), minlength=SYMBOLS**N)
        carry = codes[1 - N :]
    grams = np.flatnonzero(totals)
    return grams, totals[grams]


class Letters:
    """The random vectors of letters, rotated by place, and so those of n-grams."""

    def __init__(self, dims: int, seed: int):
        base = np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dims), dtype=np.int8) * 2 - 1
        self.placed = [np.roll(base, place, axis=1) for place in range(N - 1, -1, -1)]

    def grams(self, ids: np.ndarray) -> np.ndarray:
        first, second, third = ids // SYMBOLS // SYMBOLS, ids // SYMBOLS % SYMBOLS, ids % SYMBOLS
        return (self.placed[0][first] * self.placed[1][second] * self.placed[2][third]).astype(np.float32)

    def bundle(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The sum of n-grams' vectors, each as often as it occurs: whole numbers, exact to 2**53."""
        total = np.zeros(self.placed[0].shape[1])
        for at in range(0, len(ids), 4096):
            total += n[at : at + 4096].astype(np.float64) @ self.grams(ids[at : at + 4096])
        return total.astype(np.int64)


def _text(docs: DataFrame) -> Column:
    return F.col("text").cast("string").alias("text")


def train_profiles(docs: DataFrame, dims: int = 1024, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes of length 1, from (text, lang).

    All rows with a lang and a text count, repeated ones each time; a language whose texts have no letter is left out,
    and so is a null lang. Tasks bundle what they count, and the sums of their bundles, whole numbers, are the prototypes.
    What reaches the driver, and each worker, is ``dims`` numbers for each language.
    """
    bound_batches(docs.sparkSession)

    @released
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, totals = Letters(dims, seed), {}

        def bundles() -> Iterator[pa.RecordBatch]:
            for lang, counts in totals.items():
                bundle = letters.bundle(np.flatnonzero(counts), counts[counts > 0])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * dims, pa.string()), pa.array(np.arange(dims, dtype=np.int32)), pa.array(bundle)], names=["lang", "dim", "v"])
            totals.clear()

        for rows in batches:
            for lang, value in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                grams, n = text_grams(value.as_py())
                if not len(grams):
                    continue
                if lang not in totals:
                    if len(totals) >= LANGUAGES:
                        yield from bundles()
                    totals[lang] = np.zeros(SYMBOLS**N, dtype=np.int64)
                if n is None:
                    np.add.at(totals[lang], grams, 1)
                else:
                    totals[lang][grams] += n
        yield from bundles()

    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), _text(docs))
    found = labelled.mapInArrow(counted, "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v")).toPandas()
    names, prototypes = [], []
    for lang, rows in found.groupby("lang", sort=True):
        bundle = np.zeros(dims)
        bundle[rows["dim"]] = rows["v"]
        if norm := np.linalg.norm(bundle):
            names.append(lang)
            prototypes.append(bundle / norm)
    return names, np.array(prototypes).reshape(-1, dims)


def _scores(batch: list[tuple[np.ndarray, np.ndarray | None]], letters: Letters, prototypes: np.ndarray) -> np.ndarray:
    """Cosines of texts, as ``text_grams`` gives them, with the prototypes."""
    grams = np.flatnonzero(np.bincount(np.concatenate([x for x, _ in batch]), minlength=SYMBOLS**N))
    place = np.zeros(SYMBOLS**N, dtype=np.int64)
    place[grams] = np.arange(len(grams))
    bundles = np.zeros((len(batch), prototypes.shape[1]), dtype=np.float32)
    step = max(1, MATRIX // len(grams))
    for low in range(0, len(batch), step):
        part = batch[low : low + step]
        cells = np.repeat(np.arange(len(part)), [len(x) for x, _ in part]) * len(grams) + place[np.concatenate([x for x, _ in part])]
        weights = None if all(n is None for _, n in part) else np.concatenate([np.ones(len(x)) if n is None else n for x, n in part])
        counts = np.bincount(cells, weights=weights, minlength=len(part) * len(grams)).reshape(len(part), -1).astype(np.float32)
        for at in range(0, len(grams), 4096):
            bundles[low : low + step] += counts[:, at : at + 4096] @ letters.grams(grams[at : at + 4096])
    norms = np.linalg.norm(bundles, axis=1)
    return (bundles @ prototypes.T.astype(np.float32)) / np.maximum(norms, 1e-9)[:, None]


def identify(docs: DataFrame, profiles: tuple[list[str], np.ndarray], seed: int = 7) -> DataFrame:
    """(row, lang_pred, score): ``row`` is the whole input row, score the cosine cut to 0..1.

    ``und`` with score 0 where the text is null or has no letter, or where there
    are no profiles. Ties go to the language first in order. Texts of any length are used
    whole; repeated rows and ids make no difference; no rows give none.
    """
    bound_batches(docs.sparkSession)
    names, prototypes = profiles
    shared = docs.sparkSession.sparkContext.broadcast((names, prototypes))

    @released
    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, prototypes = shared.value
        letters = Letters(prototypes.shape[1], seed)
        for texts in batches:
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            held: list[tuple[int, tuple[np.ndarray, np.ndarray | None]]] = []
            size = 0

            def settle() -> None:
                if held and names:
                    found = _scores([x for _, x in held], letters, prototypes)
                    for (i, _), cosines in zip(held, found, strict=True):
                        best = int(cosines.argmax())
                        langs[i], scores[i] = names[best], min(1.0, max(0.0, float(cosines[best])))
                held.clear()

            for i, value in enumerate(texts):
                grams = text_grams(value.as_py())
                if not len(grams[0]):
                    continue
                held.append((i, grams))
                size += len(grams[0])
                if size > 500_000 or len(held) >= 256:
                    settle()
                    size = 0
            settle()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], names=["lang_pred", "score"])

    # Rows stay with Spark; not to be worked out again for each use of its result.
    found = F.arrow_udf(identified, "lang_pred string, score double").asNondeterministic()
    done = docs.select(whole_row(docs).alias("row"), found(F.col("text").cast("string")).alias("_f"))
    return done.select("row", "_f.lang_pred", "_f.score")
