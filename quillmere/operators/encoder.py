"""The hook for an encoder: texts to vectors a batch at a time, by a hashed projection unless another is given. [SEM11, SEM12]

An encoder is a function that makes a predictor, once for each worker; the predictor takes an array of texts and gives a matrix. So a
model is loaded where it is used and never sent. The default needs no model: each token adds signs at a few places that its hash names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quillmere.shared import bound_batches

#: Numbers of a vector, places that a token adds to, and texts of a batch.
DIMS, PLACES, BATCH = 64, 4, 256
_TOKEN = re.compile(r"\w+(?:-\w+)*")


def hashed_projection(dims: int = DIMS, places: int = PLACES) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Makes predictors of unit vectors: sums over tokens of plus or minus one at hashed places; zeros for a text without tokens."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        known: dict[str, bytes] = {}

        def token(word: str) -> bytes:
            if word not in known:
                if len(known) >= 200_000:
                    known.clear()
                known[word] = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=4 * places).digest()
            return known[word]

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dims))
            for row, text in zip(out, texts, strict=True):
                drawn = np.frombuffer(b"".join(map(token, _TOKEN.findall((text or "").lower()))), "<u4")
                row += np.bincount((drawn >> 1) % dims, np.where(drawn & 1, 1.0, -1.0), dims)
            norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return np.divide(out, norm, out=out, where=norm > 0).astype(np.float32)

        return predict

    return make


def encode(text: Column, make: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None, batch: int = BATCH) -> Column:
    """The vector of each text; a null text counts as empty. ``make`` makes a predictor, the default the hashed projection."""
    udf = predict_batch_udf(make or hashed_projection(), return_type=ArrayType(FloatType()), batch_size=batch)
    return udf(F.coalesce(text.cast("string"), F.lit("")))


def embed(docs: DataFrame, id: str = "doc_id", text: str = "text", make=None) -> DataFrame:
    """(vec_id, embedding) of documents, as ``vector.search`` and the cells take them. Rows without an id are left out."""
    bound_batches(docs.sparkSession)
    return docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("vec_id"), encode(F.col(text), make).alias("embedding"))
