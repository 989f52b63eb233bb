"""The pipeline's stages on null and repeated ids, empty and very long texts, empty tables and extra columns."""

import random

import corpus_pipeline
from quillmere.llm.line_dedup import drop_frequent_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, _key string, score int"


def _prose(rng, n):
    return " ".join("".join(rng.choices(["tha", "ren", "mol", "quo", "ing", "est"], k=3)) for _ in range(n))


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 7, "k", 1) for i, t in rows], SCHEMA)


def test_a_null_id_does_not_lose_a_shared_line(spark):
    rng = random.Random(1)
    rows = [(i, f"Shared footer\n{_prose(rng, 8)}") for i in range(14)] + [(None, f"shared footer\n{_prose(rng, 8)}")]
    for broadcast_keys in (1000, 0):
        found = drop_frequent_lines(_docs(spark, rows), 10, keep_first=True, broadcast_keys=broadcast_keys).collect()
        assert sum("ooter" in r.text for r in found) == 1
    kept = corpus_pipeline.dedup_lines(spark, _docs(spark, rows), "").collect()
    assert len(kept) == 15 and sum("ooter" in r.text for r in kept) == 1


def test_stages_go_by_row(spark, tmp_path):
    rng = random.Random(2)
    item, same = _prose(rng, 30), _prose(rng, 60)
    clean = [_prose(rng, 60) for _ in range(6)]
    rows = [(1, clean[0]), (2, f"{clean[1]} {item}"), (None, f"{clean[2]} {item}"), (2, clean[3]), (None, clean[4]), (5, None), (None, ""), (6, _prose(rng, 60_000))]
    rows += [(9, same), (9, same), (None, same), (8, same), (7, clean[5]), (7, clean[5])]
    docs = _docs(spark, rows)
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def told(frame):
        assert frame.columns == docs.columns and all(r["a.b"] == 7 and r._key == "k" for r in frame.collect())
        return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)

    near = corpus_pipeline.dedup_near(spark, docs, str(tmp_path))
    assert told(near) == sorted([r for r in set(rows) if r not in [(9, same), (None, same)]], key=str)
    left = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert told(left) == sorted([r for r in rows if item not in (r[1] or "")], key=str)
    lined = corpus_pipeline.dedup_lines(spark, docs, str(tmp_path))
    assert told(lined) == sorted([(i, t or "") for i, t in rows], key=str)
    language = corpus_pipeline.identify_language(spark, docs, str(tmp_path))
    assert told(language) == sorted([r for r in rows if r[1]], key=str)
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) >= len(rows)


def test_no_documents(spark, tmp_path):
    none = _docs(spark, []).limit(0)
    spark.createDataFrame([(1, "an item of the benchmark")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_short_items_only_as_whole_documents(spark, tmp_path):
    items = ["Paris.", "the red fox", None, "", "?!", "one two three four five six"]
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = ["paris", " PARIS!\n", "Paris is big", "The red, fox", "the red fox ran", "", None, "...", "alpha beta gamma delta epsilon", "one two three four five six", "paris " * 400]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert {r.doc_id for r in left.collect()} == {2, 4, 5, 6, 7, 8, 10}
