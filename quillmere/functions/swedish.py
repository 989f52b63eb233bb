"""Compound splitters. They recurse, so they run as Arrow UDFs, best over distinct terms that are joined back."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions import lexicon as L

_JOINERS = ("s", "e", "o", "")
_VOWELS = set("aeiouyäåö")


def _cuts(word: str, low: int, high: int):
    """(left, right) of each cut, the joiners in order; a joiner is dropped where it stands at the cut."""
    for at in range(low, high):
        for joiner in _JOINERS:
            if joiner and at + len(joiner) < len(word):
                if word.startswith(joiner, at):
                    yield word[:at], word[at + len(joiner) :]
            else:
                yield word[:at], word[at:]


def split_balanced(word: str, known: frozenset[str] = frozenset(L.COMPONENTS_V1)) -> list[str]:
    """The most balanced cut into likely parts, the right one cut again. Words under 8 letters stay. [STR4]"""
    if len(word) < 8:
        return [word]
    likely = lambda part: len(part) >= 4 or (len(part) >= 3 and part in known)
    lowered, best, result = word.lower(), 0, [word]
    for left, right in _cuts(lowered, 3, len(lowered) - 3):
        balance = min(len(left), len(right))
        if balance > best and likely(left) and likely(right):
            best, result = balance, [left, *split_balanced(right, known)]
    return result


def split_marked(word: str, markers: dict[str, float] | None = None) -> list[str]:
    """The cut after the strongest joining letter, each part of three letters at least. [STR5]"""
    markers = L.MARKERS_V2 if markers is None else markers
    w = word.lower().strip()
    if len(w) < 6:
        return [w]
    cuts = [(markers[w[at - 1]], -at, at) for at in range(3, len(w) - 2) if w[at - 1] in markers and at - 1 >= 3]
    if not cuts or max(cuts)[0] <= 0.5:
        return [w]
    at = max(cuts)[2]
    return [w[: at - 1], w[at:]]


def _word_like(part: str, known: frozenset[str]) -> bool:
    if len(part) < 3:
        return False
    letters = set(part)
    if part in known or (letters & _VOWELS and letters - _VOWELS):
        return True
    return any(part.endswith(s) and len(part) - len(s) >= 3 and part[: -len(s)] in known for s in ("erna", "et", "en", "a", "e", "ar", "er", "or"))


@lru_cache(maxsize=4)
def _longest_first(known: frozenset[str]) -> tuple[str, ...]:
    """Ties in alphabetical order."""
    return tuple(sorted(known, key=lambda c: (-len(c), c)))


def split_known(word: str, known: frozenset[str] = frozenset(L.COMPONENTS_V3), depth: int = 0, deepest: int = 2) -> list[str]:
    """Known components at either end, the longest first; joining letters where none is known. [STR7]"""
    if depth >= deepest or len(word) < 6:
        return [word]
    base = word.lower()
    for suffix in ("erna", "et", "en", "a", "e"):
        if base.endswith(suffix) and len(base) > len(suffix) + 3:
            base = base[: -len(suffix)]
            break
    for part in _longest_first(known):
        if len(base) <= len(part):
            continue
        if base.startswith(part) and _word_like(base[len(part) :], known):
            return [part, *split_known(base[len(part) :], known, depth + 1, deepest)]
        if base.endswith(part) and _word_like(base[: -len(part)], known):
            return [*split_known(base[: -len(part)], known, depth + 1, deepest), part]
    best, result = 0, [word]
    for left, right in _cuts(base, 3, len(base) - 3):
        balance = min(len(left), len(right))
        if balance > best and _word_like(left, known) and _word_like(right, known):
            best, result = balance, [left, *split_known(right, known, depth + 1, deepest)]
    return result


SPLITTERS = {"balanced": split_balanced, "marked": split_marked, "known": split_known}


def split_udf(kind: str):
    """An Arrow UDF from a word to its parts."""
    splitter = SPLITTERS[kind]

    @F.pandas_udf("array<string>")
    def split(words: pd.Series) -> pd.Series:
        return words.map(lambda w: splitter(w) if w is not None else None)

    return split


def split_terms(df: DataFrame, term: str, kind: str = "balanced", parts: str = "parts") -> DataFrame:
    """``df`` with the parts of its terms; each distinct term is split once and joined back."""
    distinct = df.select(term).where(F.col(term).isNotNull()).distinct()
    return df.join(distinct.withColumn(parts, split_udf(kind)(F.col(term))), term, "left")


def split_all(tokens: Column, kind: str = "marked") -> Column:
    """Parts of all tokens of an array, in order. [STR6, COL2]"""
    splitter = SPLITTERS[kind]

    @F.pandas_udf("array<string>")
    def split(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ws: None if ws is None else [p for w in ws for p in splitter(w)])

    return split(tokens)


def registered() -> dict:
    """The splitters by the names that SQL knows them by."""
    return {f"split_{kind}": split_udf(kind) for kind in SPLITTERS}
