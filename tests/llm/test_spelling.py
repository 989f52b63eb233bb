"""op13 against comparing all words, on small and odd tables."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillmere.llm import spelling
from quillmere.llm.common import Scratch
from quillmere.llm.query_spelling import counted_words
from quillmere.llm.spelling import near_pairs, one_edit, spelling_variants


def distance_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    cut = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return (a in cut(b)) if len(a) < len(b) else (b in cut(a))


def model(words: dict[str, int], times: int = 10) -> dict:
    near = {w: [v for v in words if distance_one(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    rows = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return rows


@pytest.mark.parametrize("block", [3, 4096])
def test_variants_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(block)
    words = {}
    for _ in range(25):
        word = "".join(rng.choices("abé", k=rng.randrange(7, 11)))
        words[word] = rng.choice([2, 30, 500, 9000])
        for _ in range(12):
            k, c = rng.randrange(len(word)), rng.choice("abéz")
            other = rng.choice([word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + c + word[k + 1 :], word + c])
            if len(other) >= 7:
                words.setdefault(other, rng.choice([2, 2, 3, 40, 500]))
    df = spark.createDataFrame([(w, n, "x") for w, n in words.items()] + [(None, 5, "x"), ("nullcount", None, "x")], "word string, n long, form string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(df).collect()}
    assert got == model(words)


def test_pairs_come_once(spark):
    words = ["aaaaaaa", "aaaaaaaa", "aaaaaaab", "baaaaaa", "aaabaaa"]
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    scratch = Scratch(spark)
    found = [tuple(sorted((r.a, r.b))) for r in near_pairs(df, scratch).collect()]
    scratch.clear()
    assert sorted(found) == sorted({(a, b) for a in words for b in words if a < b and distance_one(a, b)})


def test_one_edit():
    rng = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randrange(0, 6))) for _ in range(2))
        assert one_edit(a, b) == distance_one(a, b)


def test_runs_and_planted_deletions(spark):
    texts = {1: "ÅRSMÖTE Årsmöte-årsmöte x÷y×zzzzzz ŁŁŁŁŁŁŁ abcdefgh2abcdefgh", 2: None, 3: "", None: "Wordless wordless", 62: " ".join(f"planted{chr(97 + k)}{chr(97 + k)}" for k in range(26)) * 2}
    rows = [(i, t, "x") for i, t in texts.items()]
    got = {r.word: r.n for r in counted_words(spark.createDataFrame(rows, "doc_id long, text string, word string")).collect()}
    want = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in texts.items():
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c
                continue
            word, run = run.translate(lower), ""
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if word and h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                want[word] = want.get(word, 0) + 1
    assert got == {w: n for w, n in want.items() if n >= 2}


def test_empty(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling_variants(none).count() == 0
    assert counted_words(spark.createDataFrame([], "doc_id long, text string")).select(F.col("word")).count() == 0
