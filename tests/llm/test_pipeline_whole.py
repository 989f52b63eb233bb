"""The pipeline's stages on what they must neither lose nor let through."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _prose(rng, n):
    return " ".join("".join(rng.choices(["tha", "ren", "mol", "quo", "ing", "est"], k=3)) for _ in range(n))


def test_large_groups_of_copies_leave_one_whole_document(spark):
    rng = random.Random(3)
    text = "\n".join(_prose(rng, 12) for _ in range(8))
    near = [_prose(rng, 12) for _ in range(12)]
    rows = [(i, text) for i in range(12)] + [(100 + i, "\n".join([*near, _prose(rng, 3)])) for i in range(12)]
    rows += [(200 + i, f"Shared footer\n{_prose(rng, 40)}") for i in range(12)] + [(300, "shared FOOTER")] + [(None, "\n".join(["no id", *near[:2]]))] * 12
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], SCHEMA)
    kept = corpus_pipeline.dedup_near(spark, corpus_pipeline.dedup_lines(spark, docs, ""), "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 100, *range(200, 212)]
    texts = {r.doc_id: r.text for r in kept}
    assert texts[0] == text and texts[100] == rows[12][1] and texts[None].startswith("no id")
    assert sum("footer" in r.text.lower() for r in kept) == 1


def test_text_of_no_known_language_is_rejected(spark):
    rng = random.Random(4)
    rows = [(i, _prose(rng, rng.choice([1, 2, 8, 40, 150])), "en") for i in range(400)]
    noise = ["1234567890 " * 40 + "a", "".join(rng.choices("0123456789abcdef", k=600)), "#$% x " * 60, " ".join("".join(rng.choices("zxvkjwy", k=7)) for _ in range(80))]
    clean = ["Thing.", "A", "quo", "Tharen molquo", "The " + _prose(rng, 5), "quoing" + " " * 900 + "molest"]
    asked = [(1000 + i, t, None) for i, t in enumerate(noise)] + [(2000 + i, t, None) for i, t in enumerate(clean)]
    docs = spark.createDataFrame([(*r, "s", 0) for r in [*rows, *asked]], SCHEMA)
    got = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert got == {*range(400), *range(2000, 2000 + len(clean))}


def test_without_any_language_a_letter_is_enough(spark):
    rng = random.Random(5)
    rows = [(i, _prose(rng, 30), None, "s", 0) for i in range(5)] + [(6, "12 !", None, "s", 0), (7, None, None, "s", 0), (8, "12", "en", "s", 0), (9, "a", None, "s", 0)]
    got = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in got.collect()) == [*range(5), 9] and got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
