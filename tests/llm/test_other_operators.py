"""op3, op4, op5, op9, op10 and the pipeline on small tables."""

import hashlib
import math
import random

import numpy as np
import pytest

import corpus_pipeline
from quillmere.llm.chat_format import END, format_conversations, parse_turns, unescape
from quillmere.llm import language_id
from quillmere.llm.decontaminate import Items, find_items, myers_ends, words_of
from quillmere.llm.language_id import identify, train_profiles
from quillmere.llm.query_chat import digest_conversations
from quillmere.llm.topk import quantize, top_products
from quillmere.llm.toxicity import Machine, fit, learn, sample_terms, score_toxicity

ODD = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<s", "[[INST]", "", None, "é<s>ü", "a\\[/INST]b", "</s></s>", "plain", "[", "[/INST", "x" * 5000]


@pytest.mark.parametrize("part_bytes", [1, 200, 1 << 20])
def test_chat_round_trip(spark, part_bytes):
    rng = random.Random(part_bytes)
    rows = [(c, t, rng.choice(["user", "assistant", "[INST]", None]), rng.choice(ODD)) for c in [1, 2, 3, None] for t in range(rng.randrange(1, 30))]
    rows += [(1, 0, "assistant", "again"), (1, 0, "assistant", "again"), (4, None, "assistant", "</s>")]
    parts = format_conversations(spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, part long"), part_bytes=part_bytes)
    turns, loss = {}, {}
    for r in sorted(parts.collect(), key=lambda r: r.part):
        data = r.formatted.encode()
        assert data.count(END) == r.n_turns
        turns.setdefault(r.conv_id, []).extend(parse_turns(data))
        loss.setdefault(r.conv_id, []).extend(unescape(data[a : a + n]) for a, n in zip(r.loss_begin, r.loss_length))
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        own = [((r[2] or "").encode(), (r[3] or "").encode()) for r in sorted((r for r in rows if r[0] == c), key=order)]
        assert turns[c] == own and loss[c] == [t for role, t in own if role == b"assistant"]
    digests = {r.conv_id: r for r in digest_conversations(parts).collect()}
    for c, own in turns.items():
        assert digests[c].turns_sha256 == hashlib.sha256(b"".join(a + b"\n" + b + b"\n" for a, b in own)).hexdigest()
        assert digests[c].n_turns == len(own) and digests[c].loss_chars == sum(len(x.decode()) for x in loss[c])


def edits(item, text):
    """Least edits of item against any run of text, and for each end."""
    row = list(range(len(item) + 1))
    ends = []
    for w in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != w), row[i + 1] + 1, new[i] + 1))
        row = new
        ends.append(row[-1])
    return ends


def test_myers_against_table():
    rng = random.Random(2)
    for _ in range(300):
        item = rng.choices(range(4), k=rng.randrange(1, 80))
        text = rng.choices(range(4), k=rng.randrange(0, 60))
        k = rng.randrange(0, len(item) + 1)
        assert myers_ends(item, text, k) == [(j + 1, d) for j, d in enumerate(edits(item, text)) if d <= k]


def test_words_of_any_script():
    assert words_of("It’s “alpha—beta” ÉCOLE école") == ["it", "s", "alpha", "beta", "école", "école"]
    assert words_of("ÉCOLE, x²") == ["école".encode("latin-1"), "x²".encode("latin-1")]
    assert words_of("中文ab。字") == ["中", "文", "ab", "字"] and words_of("cafe\u0301 ж") == ["café", "ж"] and words_of(None) == []
    texts = {1: "“alpha beta gamma delta”", 2: "in der ÉCOLE hier", 3: "前面的话中文字母文本在这里后面", 4: "nothing here", 5: "“in der école hier”"}
    items = Items.of([(1, "alpha beta gamma delta"), (2, "in der école hier"), (3, "中文字母文本在这里"), (4, "yes")], 0.2, least=2)
    assert {k: [x[0] for x in items.search(t)] for k, t in texts.items()} == {1: [1], 2: [2], 3: [3], 4: [], 5: [2]} and items.search("yes") == []


def test_recall_of_items_within_budget():
    """Every item with as many random word edits as its budget allows is found, in scripts of each kind."""
    rng = random.Random(11)
    alphabets = ["abcdefgh", "абвгдежз", "éèêëàâùç", "中文字母本在这里的是不了人我"]
    for chars in alphabets:
        gap = "" if chars[0] == "中" else " "
        word = lambda: rng.choice(chars) if not gap else "".join(rng.choices(chars, k=4))
        bench = [[word() for _ in range(rng.randrange(5, 40))] for _ in range(20)]
        items = Items.of([(k, gap.join(x)) for k, x in enumerate(bench)], 0.2)
        for k, x in enumerate(bench):
            text = list(x)
            for _ in range(int(len(x) * 0.2)):
                at = rng.randrange(len(text))
                match rng.randrange(3):
                    case 0:
                        text[at] = word()
                    case 1:
                        del text[at]
                    case 2:
                        text.insert(at, word())
            assert k in [f[0] for f in items.search(gap.join([word() for _ in range(30)] + text + [word() for _ in range(30)]))]


@pytest.mark.parametrize("at_once", [{}, {"items_at_once": 3}, {"bytes_at_once": 150}])
def test_find_items_against_brute_force(spark, at_once):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 10, 24])))) for k in range(8)] + [(50, None), (51, "..."), (52, "Same, item HERE now"), (53, "same item here NOW!")]
    docs = [(0, None), (1, ""), (2, "!!"), (3, "x SAME item: here now y")]
    for i in range(4, 40):
        text = rng.choices(words, k=rng.randrange(0, 40))
        own = words_of(rng.choice(items)[1])
        for _ in range(rng.randrange(0, 5)):
            if own:
                own[rng.randrange(len(own))] = b"zz"
        at = rng.randrange(len(text) + 1)
        docs.append((i, " ".join(text[:at] + [w.decode() for w in own] + text[at:])))
    docs += [(4, docs[4][1]), (None, docs[5][1])]
    found = find_items(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id long"), spark.createDataFrame(items, "item_id long, text string"), **at_once)
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in found.collect()), key=str)
    want = []
    for doc_id, text in docs:
        for item_id, item in items:
            w, t = words_of(item), words_of(text)
            best = min(edits(w, t), default=99) if w else 99
            if best <= int(len(w) * 0.2 + 1e-9):
                want.append((doc_id, item_id, best))
    assert got == sorted(want, key=str)
    for r in found.collect():
        t, w = words_of(dict(docs)[r.doc_id]), words_of(dict(items)[r.item_id])
        if r.distance == 0:
            assert t[r.begin : r.end] == w


def test_top_products_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) * rng.choice([0.0, 0.1, 3.0]) for _ in range(5)]) for i in range(400)]
    rows += [(1000 + i, rows[20][1]) for i in range(30)] + [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 5), (2003, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (2020, []), (2040, [1.0]), (2060, [0.0] * 5)]
    vectors = quantize(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_products(vectors.where("vec_id % 20 = 0"), vectors, k=7, tile=9, block=50, head=2).collect()}
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q, v in whole.items():
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole.items() if i != q)[:7]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    few = quantize(spark.createDataFrame([(0, [1.0]), (20, [2.0])], "vec_id long, embedding array<double>"))
    assert top_products(few, few, k=20).count() == 2
    assert top_products(few.limit(0), few.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1.0, 3e5, 2.0**60, 1e200])
def test_top_products_of_large_components_and_repeated_ids(spark, scale):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * scale, rng.choice([0.0, rng.uniform(-1, 1)]), rng.uniform(-3, 3)]) for i in range(60)]
    if scale > 1e10:  # scores stay within 64 bits where the large components meet zeros
        rows = [(i, [v[0] if i == 1 else 0.0, *v[1:]]) for i, v in rows]
    rows += [(20, [1.5 if scale < 1e10 else 0.0, 0.5, 0.25]), (20, rows[20][1]), (7, [0.0, 9.0, 9.0]), (7, [0.0, 9.0, 9.0])]
    vectors = quantize(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_products(vectors.where("vec_id % 20 = 0"), vectors, k=5, tile=2, block=16, head=1).collect())
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = []
    for q, v in whole:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_products_in_groups_of_tiles(spark, monkeypatch):
    from quillmere.llm import topk

    monkeypatch.setattr(topk, "TILES", 3)
    monkeypatch.setattr(topk, "TASKS", 2)
    rng = random.Random(4)
    vectors = quantize(spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(200)], "vec_id long, embedding array<double>")).cache()
    asked = vectors.where("vec_id % 20 = 0")
    few = {tuple(r) for r in top_products(asked, vectors, k=3, tile=1, block=30).collect()}
    monkeypatch.undo()
    assert few == {tuple(r) for r in top_products(asked, vectors, k=3).collect()} and len(few) == 30


def test_language(spark):
    rng = random.Random(8)
    parts = {"aa": ["the", "ing", "er"], "bb": ["ção", "que", "os"], "cc": ["字母", "文本"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(30)), lang) for i, lang in enumerate(list(parts) * 20)]
    train = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12", "dd"), (902, "abc", None)], "doc_id long, text string, lang string")
    profiles = train_profiles(train, dims=256)
    assert profiles[0] == ["aa", "bb", "cc"]
    asked = [(0, rows[0][1], "x"), (1, rows[1][1], "x"), (2, rows[2][1], "x"), (3, None, "x"), (4, "12 !!", "x"), (5, "", None), (6, rows[0][1] * 500, "x"), (None, "q", "x")]
    got = {r.row.doc_id: (r.lang_pred, r.score) for r in identify(spark.createDataFrame(asked, "doc_id long, text string, lang_pred string"), profiles).collect()}
    assert [got[i][0] for i in (0, 1, 2, 3, 4, 5, 6)] == ["aa", "bb", "cc", "und", "und", "und", "aa"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[3][1] == 0
    assert identify(train, ([], profiles[1][:0])).where("lang_pred <> 'und'").count() == 0
    assert identify(train.limit(0), profiles).count() == 0


def test_toxicity_learns_pairs(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        words = rng.choices([f"n{k}xyz" for k in range(50)], k=12)
        words += rng.choice([["vile"], ["folk"], ["vile", "folk"], []])
        rows.append((i, " ".join(words), 0.0))
        labels.append((i, int("vile" in words and "folk" in words)))
    docs = spark.createDataFrame(rows + [(None, "vile folk", 0.0), (900, None, 0.0), (901, "", 0.0)], "doc_id long, text string, score double")
    told = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    assert sample_terms(docs, told, 500).count() == 500
    machine = learn(docs, told, 500)
    got = {r.row.doc_id: r for r in score_toxicity(docs, machine).collect()}
    right = sum(got[i].predicted == y for i, y in labels)
    assert right >= 590 and got[900].score == got[901].score and 0 <= got[900].score < 0.3
    none = learn(docs, told.limit(0))
    assert none.raw([]).shape == (0,) and score_toxicity(docs, none).where("predicted = 1 and score < 0.3").count() == 0
    assert score_toxicity(docs.limit(0), machine).count() == 0


def test_machine_against_a_sum_over_pairs():
    rng = np.random.default_rng(3)
    machine = Machine(np.arange(30, dtype=np.int32) * 7, -0.4, rng.normal(size=30), rng.normal(size=(30, 4)))
    texts = [machine.places(np.unique(rng.integers(0, 220, size=n)).astype(np.int32)) for n in (0, 1, 2, 40, 200)]
    for own, raw in zip(texts, machine.raw(texts), strict=True):
        want = machine.bias + sum(machine.weights[i] for i in own)
        want += sum(float(machine.vectors[i] @ machine.vectors[j]) for a, i in enumerate(own) for j in own[a + 1 :])
        assert abs(raw - want) < 1e-9


def test_fit_of_nothing():
    machine = fit(np.empty(0, np.int32), [np.empty(0, np.int64)] * 3, np.array([0.0, 1.0, 0.0]))
    assert len(machine.terms) == 0 and len(machine.raw([np.empty(0, np.int64)])) == 1


def test_a_text_in_pieces_has_the_same_grams(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab é 9.Ω", k=n)) for n in range(60)] + ["  ..", "a", " a ", "ab"]
    whole = [np.bincount(language_id.text_grams(t)[0], minlength=language_id.SYMBOLS**3) for t in texts]
    monkeypatch.setattr(language_id, "PIECE", 4)
    for text, want in zip(texts, whole, strict=True):
        grams, n = language_id.text_grams(text)
        got = np.bincount(grams, weights=n, minlength=language_id.SYMBOLS**3)
        assert (got == want).all(), repr(text)


def test_profiles_against_binding_letter_by_letter(spark):
    dims, seed = 128, 7
    base = np.random.default_rng(seed).integers(0, 2, (64, dims), dtype=np.int8).astype(int) * 2 - 1
    symbol = lambda c: 0 if not c.isalpha() else ord(c.lower()[0]) - 96 if "a" <= c.lower()[0] <= "z" else 27 + ord(c.lower()[0]) * 40503 % 65536 % 37

    def bundle(text):
        codes = [0]
        for c in text or "":
            if symbol(c) or codes[-1]:
                codes.append(symbol(c))
        codes += [0] if codes[-1] else []
        total = np.zeros(dims)
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            total += np.roll(base[a], 2) * np.roll(base[b], 1) * base[c]
        return total

    rng = random.Random(3)
    prose = lambda parts, n: "".join(rng.choice(parts) for _ in range(n))
    rows = [(i, prose(["the ", "ing", "Er. ", "  9"], 60), "en") for i in range(6)] + [(10 + i, prose(["ção", " Que", "os, "], 50), "pt") for i in range(6)] + [(20, "12 3", "xx"), (21, None, "en"), (22, "abc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, prototypes = train_profiles(docs, dims, seed)
    assert names == ["en", "pt"]
    for lang, own in zip(names, prototypes, strict=True):
        want = sum(bundle(t) for _, t, x in rows if x == lang)
        assert np.allclose(own, want / np.linalg.norm(want))
    asked = [t for _, t, _ in rows] + ["a", "é", "the ção" * 40]
    got = identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), (names, prototypes), seed).collect()
    for r in got:
        own = bundle(asked[r.row.doc_id])
        if not own.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosines = prototypes @ own / np.linalg.norm(own)
        assert abs(r.score - min(1.0, max(0.0, cosines.max()))) < 1e-5 and cosines[names.index(r.lang_pred)] > cosines.max() - 1e-5


def test_many_languages_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    rng = random.Random(6)
    parts = {f"l{k}": ["".join(rng.choices("abcdefghijklmnopqrst", k=3)) for _ in range(5)] for k in range(12)}
    rows = [(i, " ".join(rng.choices(parts[lang], k=40)), lang) for i, lang in enumerate(list(parts) * 4)]
    profiles = train_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dims=512)
    assert profiles[0] == sorted(parts)
    asked = [(i, t, "z") for i, t, _ in rows[:12]] + [(0, " ".join(rng.choices(parts["l3"], k=500_000)), "z")]
    got = identify(spark.createDataFrame(asked, "doc_id long, text string, score string"), profiles)
    assert [r.lang_pred for r in got.select("lang_pred").collect()] == [*list(parts), "l3"]


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("tha", "ren", "mol", "quo") for b in ("ing", "est", "ard", "ble")]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    item = prose(30)
    rows = [(i, prose(60), "en", "s", 0) for i in range(40)]
    rows += [(40 + i, rows[0][1], "en", "s", 0) for i in range(3)] + [(50, prose(20) + " " + item + " " + prose(5), "en", "s", 0), (51, "123 456", "en", "s", 0), (52, None, None, None, None)]
    rows += [(60 + i, f"Shared footer\n{prose(40)}", "en", "s", 0) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in packed}
    assert ids == {*range(40), *range(60, 72)}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    lined = corpus_pipeline.dedup_lines(spark, docs, str(tmp_path))
    assert lined.columns == docs.columns and lined.where("text like '%Shared footer%'").count() == 1 and lined.count() == docs.count()
