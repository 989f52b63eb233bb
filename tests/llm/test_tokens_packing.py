"""op1 and op8 against the tokenizer library itself."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillmere.llm import token_counts
from quillmere.llm.memo import SpaceMemo, WordMemo, library_tokenizer
from quillmere.llm.packing import pack_documents, plan_slots
from quillmere.llm.token_counts import count_spliced, count_tokens
from quillmere.llm.vocabularies import vocabulary_path

TEXTS = [
    None, "", " ", "one", "  two  spaces ", "it's we'll DON'T \n\n new\tline", "a\x1cb c\x1d d", "x\xa0y z", "é ́x",
    "Ångström straße İstanbul ΣΑΣ", "<|endoftext|> in <|startoftext|>text <|endoftext|>", "12 345 6!?", "中文 字 😀😀 ok", "tab\t x \r\n y",
    "end ", " begin", "a b   c", "long" * 300 + " " + "word " * 700,
]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, length string")


def test_memos_agree_with_library():
    words, spaces = library_tokenizer(vocabulary_path("word_bpe_49k.json")), library_tokenizer(vocabulary_path("byte_bpe_50k.json"))
    word_memo, space_memo = WordMemo(vocabulary_path("word_bpe_49k.json"), 4000), SpaceMemo(vocabulary_path("byte_bpe_50k.json"), 4000)
    rng = random.Random(5)
    parts = ["a", "The", " ", "  ", "\n", "é", "é", "\xa0", "\x1c", "'s", "1", "23", "!", "<|endoftext|>", "　", "ß", "中", "Word", "ÉTÉ", ".", ",", "!!", "ĉ", "µ", "\x00", "\x01", "\t", "a.\n", "b, "]
    for text in [t or "" for t in TEXTS] + ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(4000)]:
        assert word_memo.ids(text) == np.array(words.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
        n = len(spaces.encode(text, add_special_tokens=False).ids)
        assert space_memo.count(text) == n, repr(text)
        assert count_spliced(spaces, text, 7, 2) == n and count_spliced(spaces, text, 20, 17) == n, repr(text)


def test_plain_chunks_are_encoded_without_the_librarys_normaliser():
    words = library_tokenizer(vocabulary_path("word_bpe_49k.json"))
    memo, rng = WordMemo(vocabulary_path("word_bpe_49k.json")), random.Random(3)
    letters = [chr(c) for c in [*range(0x61, 0x7B), *range(0xDF, 0x100)] if c != 0xF7]
    chunks = letters + ["".join(rng.choices(letters, k=rng.randrange(1, 12))) + "".join(rng.choices(".,;:!?$%&#<|>\"'@`~^_", k=rng.randrange(4))) for _ in range(3000)]
    wanted = [np.array(words.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in chunks]
    assert [memo.memory[c] for c in chunks] == wanted
    # Only what holds an apostrophe goes to the whole library.
    seen, memo.tokenizer = [], None
    for chunk in chunks:
        if "'" not in chunk:
            seen.append(memo._encode(chunk))
    assert seen == [w for c, w in zip(chunks, wanted, strict=True) if "'" not in c]


def _without_spaces(rng, n):
    """Texts of kinds that have no white space, of about ``n`` characters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    return {
        "base64": "".join(rng.choices(letters, k=n)),
        "chinese": "".join("".join(rng.choices("中文字母本在这里的是不了人我他有大来上国", k=12)) + rng.choice("。，！") for _ in range(n // 13)),
        "japanese": "".join(rng.choices("これはテストです日本語の文章がぎゃ", k=n)),
        "one run": "a" * n,
        "special": "".join(rng.choices(["<|endoftext|>", "<|endof", "text|>", "x"], k=n // 8)),
        "marks": "".join(rng.choices(["e\u0301", "!", "'s", "7", "か\u3099", "。"], k=n)),
    }


@pytest.mark.parametrize("kind", ["base64", "chinese", "japanese", "one run", "special", "marks"])
def test_texts_without_white_space(kind):
    text = _without_spaces(random.Random(1), 60_000 if kind != "one run" else 9_000)[kind]
    words, spaces = library_tokenizer(vocabulary_path("word_bpe_49k.json")), library_tokenizer(vocabulary_path("byte_bpe_50k.json"))
    n = len(spaces.encode(text, add_special_tokens=False).ids)
    assert count_spliced(spaces, text, 4000, 64) == n and count_spliced(spaces, text) == n
    memo, counter = WordMemo(vocabulary_path("word_bpe_49k.json")), SpaceMemo(vocabulary_path("byte_bpe_50k.json"))
    assert counter.count(text) == n
    assert memo.ids(text) == np.array(words.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert all(len(c) <= 64 for c in [*memo.memory, *counter.memory])


def test_memory_is_bounded_in_bytes():
    memo = WordMemo(vocabulary_path("word_bpe_49k.json"), 50_000)
    memo.ids(" ".join(f"word{i}" for i in range(20_000)))
    assert memo.memory.size <= 51_000 and len(memo.memory) + len(memo.memory.old) < 1000


def test_splices_where_alignment_fails_at_first(monkeypatch):
    spaces, spans = library_tokenizer(vocabulary_path("byte_bpe_50k.json")), []
    real = token_counts.encode_words
    monkeypatch.setattr(token_counts, "encode_words", lambda t, x: spans.append(len(x)) or real(t, x))
    text = "word " * 50 + "z" * 900 + " word" * 600
    assert count_spliced(spaces, text, 200, 20) == len(spaces.encode(text, add_special_tokens=False).ids)
    assert 900 < max(spans) < len(text) and spans.count(max(spans)) <= 2


def test_count_tokens(spark):
    tokenizer = library_tokenizer(vocabulary_path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in count_tokens(documents(spark, TEXTS), vocabulary_path("byte_bpe_50k.json"), window=50, overlap=4).collect()}
    for i, text in enumerate(TEXTS):
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 512)
    assert count_tokens(documents(spark, TEXTS).limit(0), vocabulary_path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100])
    counts = {n: rng.randrange(1, 60) for n in rng.sample(range(1, capacity + 1), rng.randrange(1, capacity + 1))}
    runs, n_sequences = plan_slots(counts, capacity)
    placed, spans = Counter(), defaultdict(list)
    for length, rank, n, sequence, per, at in runs:
        placed[length] += n
        for k in range(n):
            spans[sequence + k // per].append((at + k % per * length, length))
    assert placed == Counter(counts) and len(spans) == n_sequences
    for x in spans.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and sum(x[-1]) <= capacity
    left = []  # plain best fit, one by one
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = min((x for x in left if x >= length), default=None)
            if fit is None:
                left.append(capacity - length)
            else:
                left[left.index(fit)] = fit - length
    assert n_sequences == len(left)


def test_pack_documents(spark):
    texts = TEXTS + ["same text here"] * 40 + [None] * 9
    docs = documents(spark, texts)
    docs = docs.union(docs.where("doc_id < 3")).unionByName(docs.limit(1).selectExpr("cast(null as long) doc_id", "text", "length"))
    tokenizer = library_tokenizer(vocabulary_path("word_bpe_49k.json"))
    rows = pack_documents(docs, vocabulary_path("word_bpe_49k.json"), capacity=64).collect()
    spans, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for x in spans.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and sum(x[-1]) <= 64
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)[:: 2 if i < 3 else 1]
        assert [(r.start, r.length, r.ids_crc32) for r in pieces] == [(a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for a in range(0, len(ids), 64)]
    total = sum(r.length for r in rows)
    assert len(spans) <= total // 64 + 2
    assert pack_documents(docs.limit(0), vocabulary_path("word_bpe_49k.json")).count() == 0
