"""Toxicity scores from a factorization machine over hashed terms.

A text's features are its distinct terms, hashed: words, and the beginnings of words (an insult takes
many endings in some languages). The machine adds to the usual
linear weights a vector for each term; the inner product of two terms' vectors
is the weight of their meeting in one text, so a pair (an insult and the mention
of a group, say) can count for more than its parts.

The machine is fitted on a bounded sample of labelled rows: those whose ids hash lowest, ``sample`` of them at most and with ``entries`` terms
in all at most, so the sample is bounded in rows and in bytes, for everything that is learned.
Executors hash the sample's terms and count them with the label. Terms must be in ``min_docs`` texts of the sample. Used are

* the ``terms`` strongest of those whose tie to the label is ``least_tie`` standard deviations or more, and
* the ``terms`` strongest of those that are tied to the label by ``pair_tie`` among the texts of another term, which
  itself need only have a hint of a tie (``least_hint``; the ``hints`` strongest are gone through).

So both parts of a pair are found where each by itself is harmless. The search for pairs goes over the sample as one
matrix of its places, which tasks share. The terms of pairs are kept only where they pay: a machine with them and one without are fitted on three
fourths of the sample, and the one with the lower loss on the other fourth says which terms the last fit has. Only the chosen terms of the sample's texts
come to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import bound_batches, durable, partitions_of, released, whole_row

#: Rows of the labelled sample at most, and terms of its texts at most, four bytes each.
SAMPLE, ENTRIES = 20_000, 12_000_000
_WORD = re.compile(r"[^\W\d_]+")


#: Lengths of the beginnings that are terms of their own.
BEGINNINGS = range(3, 9)


class _TermMemo(dict):
    """Word to the hashes of its terms. Emptied when it has grown to ``limit``, which changes speed only."""

    limit = 200_000

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        terms = [word, *(word[:n] + "*" for n in BEGINNINGS if n < len(word))]
        value = self[word] = tuple(xxhash.xxh3_64_intdigest(t) >> 33 for t in terms)  # 31 bits
        return value


def term_hashes(memo: _TermMemo, text: str | None) -> np.ndarray:
    """Sorted distinct term hashes of a whole text; words are runs of letters, lower-cased."""
    words = {m[0] for m in _WORD.finditer((text or "").lower())}
    return np.unique(np.fromiter(chain.from_iterable(map(memo.__getitem__, words)), dtype=np.int32))


@dataclass
class Machine:
    """Term hashes in order, and for each its weight and its vector; ``bias`` for all texts."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def raw(self, features: list[np.ndarray]) -> np.ndarray:
        """Scores before the logistic function, of texts given by places in ``terms``."""
        sizes = np.array([len(x) for x in features])
        out = np.full(len(features), self.bias)
        some = sizes > 0
        if some.any():
            at = np.concatenate(features)
            begins = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            v = self.vectors[at]
            out[some] += np.add.reduceat(self.weights[at], begins)
            out[some] += 0.5 * (np.add.reduceat(v, begins) ** 2 - np.add.reduceat(v**2, begins)).sum(axis=1)
        return out

    def places(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.terms) or not len(hashes):
            return np.empty(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return at[self.terms[at] == hashes]


def _mapped(rows: DataFrame, column: str, f) -> DataFrame:
    """(doc_id, y, places): ``f`` of each row's array of 32-bit numbers."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f(np.frombuffer(x.as_py(), np.int32)).astype(np.int32).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "y", "places"])

    return rows.select("doc_id", "y", column).mapInArrow(mapped, "doc_id long, y int, places binary")


def sample_terms(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES) -> DataFrame:
    """(doc_id, y, terms) of labelled documents, those whose ids hash lowest: at most ``sample``, with at most ``entries`` terms in all (the first has any number); kept in the shared folder.

    A null id or label teaches nothing. Of several labels of one id the highest counts, of several texts of one id the one
    whose term hashes come first as bytes. Null and empty texts have no terms. Clashing column names make no difference.
    """
    bound_batches(docs.sparkSession)
    label = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("_y"))
    chosen = label.orderBy(F.xxhash64("_id"), "_id").limit(sample)

    @released
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _TermMemo()
        for rows in batches:
            terms = [term_hashes(memo, x.as_py()).tobytes() for x in rows.column(1)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(terms, pa.binary()), rows.column(2)], names=["doc_id", "terms", "y"])

    # `sample` rows of two numbers: bounded, so it may be broadcast.
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = text.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = joined.select("doc_id", "text", "_y").mapInArrow(hashed, "doc_id long, terms binary, y int").groupBy("doc_id").agg(F.min(F.struct("terms", "y")).alias("s"))
    rows = durable(rows.select("doc_id", "s.y", "s.terms"))
    # Two numbers a row of the sample.
    sizes = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", (F.octet_length("terms") / 4).cast("long").alias("n")).toPandas().sort_values(["h", "doc_id"])
    fits = sizes["n"].cumsum() <= entries
    if fits.all() or not len(sizes):
        return rows
    last = sizes[fits].tail(1) if fits.any() else sizes.head(1)
    edge = F.struct(F.lit(int(last["h"].iloc[0])).alias("h"), F.lit(int(last["doc_id"].iloc[0])).alias("doc_id"))
    return durable(rows.where(F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id")) <= edge))


def count_terms(rows: DataFrame) -> DataFrame:
    """(term, n, positive): texts of the sample that hold a term, and the toxic ones of these."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [np.frombuffer(x.as_py(), np.int32) for x in batch.column(1)]
            if not sum(map(len, terms)):
                continue
            toxic = np.repeat(np.array(batch.column(0).to_pylist()), [len(t) for t in terms])
            values, slot, n = np.unique(np.concatenate(terms), return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64)), pa.array(np.bincount(slot, weights=toxic).astype(np.int64))], names=["term", "n", "positive"])

    return rows.select("y", "terms").mapInArrow(counted, "term int, n long, positive long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))


def _tie(n: np.ndarray, positive: np.ndarray, share: float) -> np.ndarray:
    """Standard deviations between the toxic texts of terms in ``n`` texts each and what their share would give."""
    return np.abs(positive - n * share) / np.sqrt(n * (share * (1 - share)))


@dataclass
class Matrix:
    """Places of the sample's terms, text after text, with where each text begins and its label."""

    places: np.ndarray
    begins: np.ndarray
    y: np.ndarray
    n_terms: int

    def partners(self, hints: np.ndarray, min_docs: int, least_tie: float) -> tuple[np.ndarray, np.ndarray]:
        """Terms tied to the label among the texts of one of the terms ``hints``, and how strongly at most.

        So a term that by itself says nothing, but turns the texts of another one toxic or harmless, is found; the
        other one is given too.
        """
        best = np.zeros(self.n_terms)
        wanted = np.zeros(self.n_terms, dtype=bool)
        wanted[hints] = True
        at = np.flatnonzero(wanted[self.places])
        text = np.searchsorted(self.begins, at, "right") - 1
        order = np.argsort(self.places[at], kind="stable")
        of, text = self.places[at][order], text[order]
        for part in np.split(np.arange(len(of)), np.flatnonzero(of[1:] != of[:-1]) + 1):
            texts = text[part]
            toxic = self.y[texts] > 0
            if not 0 < toxic.sum() < len(texts):
                continue
            held = [self.places[self.begins[i] : self.begins[i + 1]] for i in texts]
            n = np.bincount(np.concatenate(held), minlength=self.n_terms)
            positive = np.bincount(np.concatenate([x for x, y in zip(held, toxic, strict=True) if y]), minlength=self.n_terms)
            u = of[part[0]]
            common = np.flatnonzero((n >= min_docs) & (n < len(texts)))
            tie = _tie(n[common], positive[common], toxic.mean())
            hit = tie >= least_tie
            best[common[hit]] = np.maximum(best[common[hit]], tie[hit])
            if hit.any():
                best[u] = max(best[u], tie[hit].max())
        found = np.flatnonzero(best)
        return found, best[found]


def pair_terms(rows: DataFrame, common: np.ndarray, hints: np.ndarray, most: int, min_docs: int, least_tie: float) -> np.ndarray:
    """The ``most`` strongest of the terms ``common`` that ``Matrix.partners`` finds; blocks of ``hints`` are dealt to tasks."""
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(common)
    placed = durable(_mapped(rows, "terms", lambda t: np.searchsorted(known.value, t[np.isin(t, known.value, assume_unique=True)])))
    got = placed.select("doc_id", "y", "places").toPandas().sort_values("doc_id")
    parts = [np.frombuffer(x, np.int32) for x in got["places"]]
    if not parts or not len(hints):
        return np.empty(0, np.int32)
    matrix = spark.sparkContext.broadcast(Matrix(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), got["y"].to_numpy(), len(common)))
    blocks = max(1, min(len(hints), 4 * spark.sparkContext.defaultParallelism))
    dealt = spark.createDataFrame([(np.ascontiguousarray(hints[b::blocks]).astype(np.int64).tobytes(),) for b in range(blocks)], "hints binary").repartition(min(blocks, max(1, partitions_of(spark))))

    @released
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                found, tie = matrix.value.partners(np.frombuffer(x.as_py(), np.int64), min_docs, least_tie)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(tie)], names=["place", "tie"])

    best = dealt.mapInArrow(searched, "place long, tie double").groupBy("place").agg(F.max("tie").alias("tie")).orderBy(F.desc("tie"), "place").limit(most)
    return common[np.array([r["place"] for r in best.collect()], dtype=np.int64)]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = 5_000, hints: int = 5_000, min_docs: int = 6, least_tie: float = 4.0, least_hint: float = 1.5, pair_tie: float = 8.0, entries: int = ENTRIES, **how) -> Machine:
    """A machine from (doc_id, text) and (doc_id, toxic); see the module. Without both labels, or without terms, it scores every text by the label's share.

    Of terms tied equally the one of the smaller hash is stronger. Texts of any length count as a whole, each distinct term once. Null ids, labels and texts as
    ``sample_terms`` has them.
    """
    rows = sample_terms(docs, labels, sample, entries)
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    chosen = paired = np.empty(0, np.int32)
    if 0 < toxic < n:
        share = toxic / n
        tie = F.abs(F.col("positive") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
        counts = durable(count_terms(rows).where(F.col("n") >= min_docs).withColumn("tie", tie))
        strongest = lambda least, most: np.array([r["term"] for r in counts.where(F.col("tie") >= least).orderBy(F.desc("tie"), "term").limit(most).collect()], dtype=np.int32)
        # Every term is in `min_docs` texts of the sample, so their number is bounded with the sample.
        common = np.sort(counts.select("term").toPandas()["term"].to_numpy(np.int32))
        hinted = np.searchsorted(common, strongest(least_hint, hints))
        chosen = np.sort(strongest(least_tie, terms)).astype(np.int32)
        paired = np.union1d(chosen, pair_terms(rows, common, hinted, terms, min_docs, pair_tie)).astype(np.int32)
    own = rows.sparkSession.sparkContext.broadcast(paired)
    got = _mapped(rows, "terms", lambda t: np.searchsorted(own.value, t[np.isin(t, own.value, assume_unique=True)])).toPandas().sort_values("doc_id")
    y, features = got["y"].to_numpy(np.float64), [np.frombuffer(x, np.int32) for x in got["places"]]
    if len(paired) == len(chosen):
        return fit(paired, features, y, **how)
    alone = np.searchsorted(paired, chosen)
    fewer = [np.searchsorted(alone, x[np.isin(x, alone, assume_unique=True)]) for x in features]
    tested = np.random.default_rng(3).permutation(len(y)) % 4 == 0
    losses = [held_loss(t, f, y, tested, **how) for t, f in ((paired, features), (chosen, fewer))]
    return fit(paired, features, y, **how) if losses[0] < losses[1] else fit(chosen, fewer, y, **how)


def held_loss(terms: np.ndarray, features: list[np.ndarray], y: np.ndarray, tested: np.ndarray, **how) -> float:
    """Mean logistic loss on the texts ``tested`` of a machine fitted on the others."""
    machine = fit(terms, [x for x, t in zip(features, tested, strict=True) if not t], y[~tested], **how)
    places = features if len(machine.terms) else [np.empty(0, np.int64)] * len(features)
    raw = machine.raw([x for x, t in zip(places, tested, strict=True) if t])
    return float(np.logaddexp(0, np.where(y[tested] > 0, -raw, raw)).mean())


def fit(terms: np.ndarray, features: list[np.ndarray], y: np.ndarray, factors: int = 4, epochs: int = 12, seed: int = 11) -> Machine:
    """A machine over ``terms`` fitted by AdaGrad on logistic loss, from texts as places in ``terms``. Without both labels, or without terms, it scores every text by their share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    rng = np.random.default_rng(seed)
    machine = Machine(terms, float(np.log(share / (1 - share))), np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), factors)))
    if not 0 < y.sum() < len(y) or not len(terms):
        return Machine(np.empty(0, np.int32), machine.bias, np.empty(0), np.empty((0, factors)))
    g_w, g_v, g_b = np.full(len(terms), 1e-6), np.full((len(terms), factors), 1e-6), 1e-6
    rate, l2_w, l2_v, batch = 0.1, 2e-4, 2e-3, 64
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for low in range(0, len(order), batch):
            part = order[low : low + batch]
            own = [features[i] for i in part]
            error = 1 / (1 + np.exp(-np.clip(machine.raw(own), -30, 30))) - y[part]
            g_b += error.mean() ** 2
            machine.bias -= rate * error.mean() / np.sqrt(g_b)
            sizes = np.array([len(x) for x in own])
            if not sizes.sum():
                continue
            at = np.concatenate(own)
            row = np.repeat(np.arange(len(own)), sizes)
            v = machine.vectors[at]
            sums = np.zeros((len(own), factors))
            np.add.at(sums, row, v)
            seen, slot = np.unique(at, return_inverse=True)
            d_w = np.bincount(slot, weights=error[row]) / len(own) + l2_w * machine.weights[seen]
            d_v = np.stack([np.bincount(slot, weights=error[row] * (sums[row, f] - v[:, f])) for f in range(factors)], axis=1) / len(own) + l2_v * machine.vectors[seen]
            g_w[seen] += d_w**2
            g_v[seen] += d_v**2
            machine.weights[seen] -= rate * d_w / np.sqrt(g_w[seen])
            machine.vectors[seen] -= rate * d_v / np.sqrt(g_v[seen])
    return machine


def score_toxicity(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """(row, score, predicted): ``row`` is the whole input row, score from 0 to 1.

    A null or empty text has no terms and gets the score of the bias. Whole texts of any length
    are used; repeated rows and ids make no difference; no rows give none.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @released
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo, own = _TermMemo(), shared.value
        for texts in batches:
            features = [own.places(term_hashes(memo, x.as_py())) for x in texts]
            score = 1 / (1 + np.exp(-np.clip(own.raw(features), -30, 30)))
            yield pa.StructArray.from_arrays([pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["score", "predicted"])

    # Rows stay with Spark; not to be worked out again for each use of its result.
    found = F.arrow_udf(scored, "score double, predicted int").asNondeterministic()
    done = docs.select(whole_row(docs).alias("row"), found(F.col("text").cast("string")).alias("_f"))
    return done.select("row", "_f.score", "_f.predicted")
