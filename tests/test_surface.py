"""SQL functions, the segmented index, positions, trigrams, the reader of HTML, streams that forget."""

import os
import random
import threading
import tracemalloc
from collections import Counter
from datetime import datetime, timedelta
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.functions import catalog, html
from quillmere.functions import text as T
from quillmere.operators import encoder, index, ops, pages, positions, ranking, segments, trigrams, vector
from quillmere.operators.positions import All, Any, Not, Phrase, Word
from quillmere.operators.segments import Conflict, SegmentedIndex
from quillmere.streaming import machines

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# --- SQL ------------------------------------------------------------------------------------------------------------
def test_sql_functions_equal_column_functions(spark):
    names = catalog.register(spark)
    assert {"bm25", "authority", "recency", "tokenize"} <= set(names)
    texts = ["Ett två-tre, FYRA_5 ÅÄÖ!", "", None, "a-b-c -x- 1,2", "İstanbul ΣΑΣ"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    df.createOrReplaceTempView("sql_texts")
    got = {}
    for r in spark.sql("SELECT id, t.* FROM sql_texts, LATERAL tokenize(text) t ORDER BY id, position").collect():
        got.setdefault(r.id, []).append(r.token)
    want = {r.id: r.t for r in df.select("id", T.tokenize(F.col("text")).alias("t")).collect() if r.t}
    assert got == want
    row = spark.sql("SELECT bm25(3, 10, 8, 2, 100) AS b, bm25(3, 10, 8, 2, 100, 1.2D, 0.5D) AS c, idf_smooth(9, 4) AS i").first()
    expr = lambda **k: spark.range(1).select(index.bm25(F.lit(3), F.lit(10), F.lit(8.0), F.lit(2), F.lit(100), **k)).first()[0]
    assert row.b == pytest.approx(expr()) and row.c == pytest.approx(expr(k1=1.2, b=0.5))
    hosts = spark.createDataFrame([("riksdagen.se",), ("x.lund.se",), ("example.com",)], "d string")
    hosts.createOrReplaceTempView("sql_hosts")
    assert [r[0] for r in spark.sql("SELECT authority(d) FROM sql_hosts").collect()] == [r[0] for r in hosts.select(ranking.authority(F.col("d"))).collect()]
    moments = spark.sql("SELECT recency(timestamp'2024-01-01', timestamp'2024-02-01') AS a, recency(NULL, timestamp'2024-02-01') AS b").first()
    assert moments.b == 0.5 and 0.9 < moments.a < 0.93
    assert "PythonUDF" not in spark.sql("SELECT bm25(id, 1, 1, 1, 9) FROM range(9)")._jdf.queryExecution().toString()


# --- segments -------------------------------------------------------------------------------------------------------
def docs_of(spark, rows):
    return spark.createDataFrame([(k, t) for k, t in rows.items()], "doc_id long, text string")


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_segments_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = [f"ord{k}" for k in range(30)]
    text = lambda: " ".join(rng.choices(vocabulary, k=rng.randrange(0, 12)))
    live = {k: text() for k in range(20)}
    kept = SegmentedIndex.create(spark, str(tmp_path / "ix")).add(docs_of(spark, live))
    queries = index.query_table(spark, {1: ["ord1", "ord2"], 2: ["ord3"]})
    for turn in range(6):
        before = files_of(tmp_path / "ix")
        if turn % 3 == 2:
            gone = rng.sample(sorted(live), 4)
            kept = kept.remove(spark.createDataFrame([(k,) for k in [*gone, 9999, None]], "doc_id long"))
            live = {k: t for k, t in live.items() if k not in gone}
        else:
            new = {rng.randrange(40): text() for _ in range(6)}
            live |= new
            kept = kept.add(docs_of(spark, new))
        assert {p: t for p, t in files_of(tmp_path / "ix").items() if p in before} == before
        rebuilt, now = index.Index.build(docs_of(spark, live)), SegmentedIndex.open(spark, str(tmp_path / "ix")).index()
        assert Counter(map(tuple, now.postings.select("term", "doc_id", "tf", "dl").collect())) == Counter(map(tuple, rebuilt.postings.select("term", "doc_id", "tf", "dl").collect()))
        assert {(r.term, r.df) for r in now.terms.collect()} == {(r.term, r.df) for r in rebuilt.terms.collect()}
        assert now.n == rebuilt.n == len(live) and now.average == pytest.approx(rebuilt.average)
        assert {r.doc_id: r.text for r in now.documents.collect()} == live
        hits = lambda ix: [(r.query_id, r.doc_id, r["rank"], round(r.score, 9)) for r in index.search_bm25(ix, queries, 5).orderBy("query_id", "rank").collect()]
        assert hits(now) == hits(rebuilt)
    assert len(kept.segments) < segments.FAN
    assert kept.vacuum() > 0 and SegmentedIndex.open(spark, str(tmp_path / "ix")).documents().count() == len(live)


def test_snapshots_and_conflicts(spark, tmp_path):
    path = str(tmp_path / "ix")
    first = SegmentedIndex.create(spark, path).add(docs_of(spark, {1: "gammal text", 2: "annan"}))
    reader = SegmentedIndex.open(spark, path)
    second = first.add(docs_of(spark, {1: "ny text", 3: "tredje"}))
    assert {r.doc_id: r.text for r in reader.documents().collect()} == {1: "gammal text", 2: "annan"}
    assert {r.doc_id: r.text for r in SegmentedIndex.open(spark, path).documents().collect()} == {1: "ny text", 2: "annan", 3: "tredje"}
    with pytest.raises(Conflict):
        first.remove(docs_of(spark, {2: ""}))
    assert SegmentedIndex.open(spark, path).version == second.version
    assert SegmentedIndex.open(spark, path, first.version).documents().count() == 2
    empty = SegmentedIndex.create(spark, str(tmp_path / "none"))
    assert empty.index().postings.count() == 0 and empty.add(docs_of(spark, {})).index().n == 0
    assert second.remove(docs_of(spark, {1: "", 2: "", 3: ""})).index().n == 0


def test_a_reader_meanwhile_sees_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "ix")
    kept = SegmentedIndex.create(spark, path).add(docs_of(spark, {k: "gammal" for k in range(30)}))
    done, seen = threading.Event(), []

    def read():
        while not done.is_set():
            seen.append({r.text for r in SegmentedIndex.open(spark, path).documents().select("text").distinct().collect()})

    reader = threading.Thread(target=read)
    reader.start()
    kept.add(docs_of(spark, {k: "ny" for k in range(30)}))
    done.set()
    reader.join()
    assert seen and all(x in ({"gammal"}, {"ny"}) for x in seen)


# --- positions ------------------------------------------------------------------------------------------------------
def covers(words, tokens):
    """Sum over minimal covers of the words that occur, by trying every run."""
    present = [w for w in words if w in tokens]
    if not present:
        return 0.0
    runs = [(i, j) for i in range(len(tokens)) for j in range(i, len(tokens)) if set(present) <= set(tokens[i : j + 1])]
    least = [r for r in runs if not any(o != r and o[0] >= r[0] and o[1] <= r[1] for o in runs)]
    return sum(len(present) / (j - i + 1) for i, j in least)


def matches(tree, tokens):
    match tree:
        case Word(t):
            return t in tokens
        case Phrase(ts):
            return any(tuple(tokens[i : i + len(ts)]) == ts for i in range(len(tokens)))
        case Not(p):
            return not matches(p, tokens)
        case All(ps):
            return all(matches(p, tokens) for p in ps)
        case Any(ps):
            return any(matches(p, tokens) for p in ps)


def test_trees_equal_a_model(spark):
    rng = random.Random(6)
    texts = {k: " ".join(rng.choices("abcd", k=rng.randrange(0, 9))) for k in range(150)} | {500: None}
    leaf = lambda: rng.choice([Word(rng.choice("abcde")), Phrase(tuple(rng.choices("abcd", k=rng.randrange(1, 4))))])

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return leaf()
        kind = rng.choice([All, Any, Not])
        return Not(tree(depth - 1)) if kind is Not else kind(tuple(tree(depth - 1) for _ in range(rng.randrange(1, 4))))

    trees = {k: tree(2) for k in range(12)}
    df = docs_of(spark, texts)
    got = {(r.query_id, r.doc_id): (round(r.score, 9), r["rank"]) for r in positions.search(positions.positional_postings(df), trees, df, 1000).collect()}
    want = {}
    for q, t in trees.items():
        hits = {d: round(covers(positions.words_of(t, positive=True), (x or "").split()), 9) for d, x in texts.items() if matches(t, (x or "").split())}
        for rank, d in enumerate(sorted(hits, key=lambda d: (-hits[d], d)), 1):
            want[q, d] = hits[d], rank
    assert got == want


def test_a_pure_negation_needs_the_documents(spark):
    df = docs_of(spark, {1: "a b"})
    with pytest.raises(ValueError):
        positions.search(positions.positional_postings(df), {1: Not(Word("a"))})
    assert positions.search(positions.positional_postings(df), {1: Any((Word("b"), Not(Word("a"))))}, df).count() == 1


# --- trigrams -------------------------------------------------------------------------------------------------------
def grams(text):
    return {f"  {w} "[i : i + 3] for w in text.lower().split() for i in range(len(w) + 1)}


@pytest.mark.parametrize("threshold", [0.3, 0.6])
def test_similar_strings_equal_all_pairs(spark, threshold):
    rng = random.Random(8)
    base = ["stockholm stad", "göteborg", "lunds universitet", "malmö högskola kommun"]
    rows = {k: "".join(c if rng.random() > 0.15 else rng.choice("aeo ") for c in rng.choice(base)) for k in range(80)} | {200: None, 201: "  ", 202: "göteborg", 203: "göteborg"}
    found = trigrams.TrigramIndex.build(spark.createDataFrame([(k, t, "x") for k, t in rows.items()], "id long, text string, grams string"), "id", "text")
    sets = {k: frozenset(grams(t)) for k, t in rows.items() if t and t.strip()}
    classes = {}
    for k in sorted(sets):
        classes.setdefault(sets[k], k)
    want = {(a, b): len(x & y) / len(x | y) for x, a in classes.items() for y, b in classes.items() if a < b and len(x & y) / len(x | y) >= threshold}
    assert {(r.a, r.b): r.similarity for r in trigrams.similar(found, threshold).collect()} == pytest.approx(want)
    assert {r.id: r["class"] for r in found.members.collect()} == {k: classes[s] for k, s in sets.items()}
    near = {}
    for r in trigrams.closest(found, spark.createDataFrame([(k,) for k in rows], "query_id long"), 3, threshold).collect():
        near.setdefault(r.query_id, []).append((r["rank"], r["class"]))
    for k, s in sets.items():
        both = {c: len(s & o) / len(s | o) for o, c in classes.items() if o != s}
        best = sorted((c for c, v in both.items() if v >= threshold), key=lambda c: (-both[c], c))[:3]
        assert [c for _, c in sorted(near.get(k, []))] == best
    assert "CartesianProduct" not in trigrams.similar(found, threshold)._jdf.queryExecution().toString()


def test_similar_strings_in_blocks_shuffle_no_candidates(spark, monkeypatch):
    monkeypatch.setattr(trigrams, "BLOCK", 16)
    rng = random.Random(9)
    rows = {k: " ".join("".join(rng.choice("abå") for _ in range(4)) for _ in range(3)) for k in range(120)}
    found = trigrams.TrigramIndex.build(spark.createDataFrame(list(rows.items()), "id long, text string"), "id", "text")
    sets = {k: frozenset(grams(t)) for k, t in rows.items()}
    pairs = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in rows for b in rows if sets[a] != sets[b]}
    similar = trigrams.similar(found, 0.3)
    assert {(r.a, r.b): r.similarity for r in similar.collect()} == {(a, b): v for (a, b), v in pairs.items() if a < b and v >= 0.3}
    assert "Join" not in similar._jdf.queryExecution().executedPlan().toString()
    asked = spark.createDataFrame([(k,) for k in rows], "query_id long")
    got = {(r.query_id, r["rank"]): r["class"] for r in trigrams.closest(found, asked, 2, 0.3).collect()}
    assert got == {(a, n): b for a in rows for n, b in enumerate(sorted((b for b in rows if pairs.get((a, b), 0) >= 0.3), key=lambda b: (-pairs[a, b], b))[:2], 1)}


# --- pages ----------------------------------------------------------------------------------------------------------
READ = [
    ("<a href=/p>x</a><a href='/r&amp;s'>y</a><A HREF=\"../up\">z</A><a href='#top'>t</a><a>none</a><a href='mailto:x@a.se'>m</a><a href='//b.a.se/c'>o</a>", "http://a.se/x/y/z",
     ["http://a.se/p", "http://a.se/r&s", "http://a.se/x/up", "http://a.se/x/y/z", "http://b.a.se/c"]),
    ("<a title='>' href='q?a=1&amp;b=2#f'>x</a><script>var a = \"<a href='/no'>\";</script><!-- <a href='/no'> -->", "http://a.se/x/y", ["http://a.se/x/q?a=1&b=2"]),
]


def test_links(spark):
    rows = spark.createDataFrame([(h, u) for h, u, _ in READ] + [(None, "http://a.se")], "html string, url string")
    got = [r[0] for r in rows.select(pages.links(F.col("html"), F.col("url"))).collect()]
    assert got == [want for *_, want in READ] + [[]]
    both = spark.createDataFrame([("http://a.se/x/y/z", h) for h in ("../up", "/a/./b/../c", "..", "../../../../q?x=../y", ".", "./", "?q", "")], "base string, href string")
    from urllib.parse import urljoin

    for r in both.select("base", "href", pages.resolve(F.col("base"), F.col("href")).alias("got")).collect():
        assert r.got == urljoin(r.base, r.href), r


def test_main_text_takes_the_first_block(spark):
    cases = {
        "<article>a</article>mid<article>b</article>": "a", "<main>a<div>b</main>c</div><main>d</main>": "a b", "<div class=no-content-here>x</div><div class='big content'>y <p>z</div>w": "y z",
        "<body>x<noscript>n</noscript><style>s</style> y&ouml;&ouml &amp;lt;</body>": "x yöö &lt;", "no tags": "no tags", "": "", "<article><article>in</article>out</article>": "in out",
        "<body><table><tr><td>a<td>b<tr><td>c</table>": "a b c", "<script>never closed <p>": "",
    }
    rows = spark.createDataFrame([(h,) for h in cases], "html string")
    assert [r[0] for r in rows.select(pages.main_text(F.col("html"))).collect()] == list(cases.values())


def test_reader_on_nested_pages():
    """Trees written out and read back: tags, parents and texts stay."""
    rng = random.Random(1)

    def grow(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"t{rng.randrange(99)}"
        return (rng.choice(["div", "section", "article", "span", "b"]), [grow(depth - 1) for _ in range(rng.randrange(1, 4))])

    def write(x):
        return x if isinstance(x, str) else f"<{x[0]}>" + "<!-- -->".join(map(write, x[1])) + f"</{x[0]}>"

    def flat(x, up, out):
        if isinstance(x, str):
            out.append((up, x))
        else:
            for y in x[1]:
                flat(y, (*up, x[0]), out)
        return out

    for _ in range(300):
        tree = ("div", [grow(4)])
        # Inline elements do not hold blocks beyond their end, so only trees without blocks in them count.
        page = html.Page(write(tree))

        def path(node, page=page):
            return () if node <= 0 else (*path(page.parents[node]), page.tags[node])

        assert [(path(node), text) for node, _, text in page.texts] == flat(tree, (), [])
    assert html.attributes("a=1 B='x &lt; y' c=\"z\" d  e = f a=2") == {"a": "1", "b": "x < y", "c": "z", "d": "", "e": "f"}


def test_extract_reads_once(spark):
    rows = spark.createDataFrame([("http://a.se/", "<html lang=en><title> T &amp; U </title><meta name=Description content='d &lt;'><body><p>x</p><a href=/y>y</a>"), ("http://a.se/n", None)], "url string, html string")
    first, second = pages.extract(rows).collect()
    assert (first.title, first.language, first.meta_description, first.content, first.links) == ("T & U", "en", "d <", "x y", ["http://a.se/y"])
    assert (second.title, second.content, second.links) == ("Untitled", "", [])
    plan = pages.extract(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


# --- rows that were lost ---------------------------------------------------------------------------------------------
def test_rows_without_a_key_count(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, None, at, 1.0), (2, None, at + timedelta(1), 3.0), (3, 7, at, 5.0)], "event_id long, k long, ts timestamp, v double")
    assert {r.event_id: r["mean"] for r in ops.running_mean(df, "v", "ts", "k").collect()} == {1: 1.0, 2: 2.0, 3: 5.0}
    assert {r.k: r.quantile for r in ops.quantile(df, "v", "k", 0.5).collect()} == {None: 2.0, 7: 5.0}
    assert {r.k: r.p95_ms for r in ops.performance(df, "k", "v", F.lit(True)).collect()}[None] == pytest.approx(2.9)
    again = spark.createDataFrame([(1, "a", at), (1, "a", at), (None, "b", at)], "event_id long, k string, ts timestamp")
    assert Counter((r.event_id, r.hit) for r in ops.cache_log(again, "k").collect()) == Counter([(1, False), (1, True), (None, False)])


def test_odd_vectors_take_no_part(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, None), (None, [1.0, 1.0]), (6, [0.5, 0.5]), (7, [float("inf"), 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [nan, 0.0])], "query_id long, vector array<double>")
    assert [(r.query_id, r.vec_id) for r in vector.search(vectors, asked, 5).orderBy("rank").collect()] == [(1, 1), (1, 6)]
    assert vector.search(vectors, asked.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        vector.search(vectors, spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "query_id long, vector array<double>"))


# --- streams ---------------------------------------------------------------------------------------------------------
def run_in_parts(spark, df, parts, run, at, name):
    spark.conf.set(*ROCKS)
    found = []
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{at}/in")
        source = spark.readStream.schema(df.schema).parquet(f"{at}/in")
        q = run(source).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(300)
        found = spark.read.parquet(f"{at}/out").collect()
    return found


@pytest.mark.parametrize("name", ["rate_limit", "cooldown", "timeout"])
def test_other_machines_as_streams(spark, tmp_path, name):
    made = {"rate_limit": machines.rate_limit(3, 60.0), "cooldown": machines.cooldown(100.0), "timeout": machines.adaptive_timeout()}[name]
    rng, at, rows = random.Random(3), datetime(2024, 1, 1), []
    for i in range(60):
        at += timedelta(seconds=rng.choice([0, 1, 5, 40]))
        rows.append((i, at, rng.randrange(5), rng.random() < 0.6))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, ok boolean")
    got = run_in_parts(spark, df, [df.where("event_id < 20"), df.where("event_id >= 20")], lambda s: machines.run_stream(s, "user_id", made), tmp_path, name)
    assert {tuple(r) for r in got} == {tuple(r) for r in machines.run_batch(df, "user_id", made).collect()}


def test_streams_fold_rows_and_take_null_times_first(spark, tmp_path, monkeypatch):
    """A frame for every key costs more than the fold; rows without a time are those of time 0, as in the batch."""
    from pyspark.sql import GroupedData

    monkeypatch.delattr(GroupedData.__mro__[1], "transformWithStateInPandas")
    start = datetime(2024, 1, 1)
    rows = [(0, start, 1, False), (1, None, 1, None), (2, None, 2, False), (3, start, None, False), (4, start + timedelta(seconds=50), 2, False), (5, start + timedelta(seconds=5), 2, False), (6, start + timedelta(seconds=300), 2, False)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, ok boolean")
    machine = machines.cooldown(100.0)
    got = run_in_parts(spark, df, [df.where("event_id < 6"), df.where("event_id = 6")], lambda s: machines.run_stream(s, "user_id", machine), tmp_path, "nulls")
    assert {tuple(r) for r in got} == {tuple(r) for r in machines.run_batch(df, "user_id", machine).collect()}


def test_states_go_by_event_time(spark, tmp_path):
    """Key 1 is heard of once; when event time has passed it by, its state is gone, and the results are those of the batch."""
    start = datetime(2024, 1, 1)
    rows = [(0, start, 1, False), (1, start, 2, False)] + [(k, start + timedelta(hours=k), 2, False) for k in range(2, 8)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, ok boolean")
    parts = [df.where("event_id < 2"), df.where("event_id between 2 and 5"), df.where("event_id > 5")]
    machine = machines.cooldown(600.0)
    got = run_in_parts(spark, df, parts, lambda s: machines.run_stream(s, "user_id", machine, clean_up=True, late="1 minute"), tmp_path, "forget")
    assert {tuple(r) for r in got} == {tuple(r) for r in machines.run_batch(df, "user_id", machine).collect()}
    held = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "state").load()
    assert {r.key.key for r in held.collect()} == {"2"}


def test_cache_of_bounded_size_equals_a_model(spark, tmp_path):
    rng, at, rows = random.Random(12), datetime(2024, 1, 1), []
    for i in range(300):
        at += timedelta(seconds=rng.choice([1, 5, 60]))
        rows.append((i, at, rng.choice("xy"), rng.choice("abcdefg")))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, cache string, key string")
    parts = [df.where(f"event_id >= {a} and event_id < {b}") for a, b in pairwise([0, 90, 200, 300])]
    got = run_in_parts(spark, df, parts, lambda s: machines.run_cache(s, "cache", "key", 3, ttl=100.0), tmp_path, "lru")
    want, caches = {}, {"x": {}, "y": {}}
    for i, t, cache, key in rows:
        held = caches[cache]
        if key in held and (t - held[key][0]).total_seconds() <= 100:
            want[i], held[key] = "hit", (held[key][0], t)
            continue
        held.pop(key, None)
        want[i] = "miss"
        if len(held) >= 3:
            for k in [k for k, v in held.items() if (t - v[0]).total_seconds() > 100]:
                del held[k]
        if len(held) >= 3:
            del held[min(held, key=lambda k: (held[k][1], k))]
            want[i] = "evicting"
        held[key] = (t, t)
    assert {r.event_id: r.result for r in got} == want and set(want.values()) == {"hit", "miss", "evicting"}


def test_blocks_give_the_hits_of_scoring_everything(spark, tmp_path):
    from quillmere.operators import blocks

    rng = random.Random(4)
    weights = [1 / (k + 1) for k in range(40)]
    texts = {k: " ".join(rng.choices([f"ord{x}" for x in range(40)], weights, k=rng.choice([3, 9, 40, 200]))) for k in range(400)}
    ix = index.Index.build(docs_of(spark, texts))
    asked = index.query_table(spark, {1: ["ord0"], 2: ["ord0", "ord1", "ord1"], 3: ["ord37", "ord0"], 4: ["nowhere"], 5: ["ord39"]})


    def hits(df):
        """Scores by rank, and the documents above the last score; which of equal sums comes first is up to their last digits."""
        rows = [(r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect()]
        last = {q: min(s for p, _, _, s in rows if p == q) for q, *_ in rows}
        return sorted((q, rank, s) for q, rank, _, s in rows), sorted((q, d) for q, _, d, s in rows if s > last[q])

    want = hits(index.search_bm25(ix, asked, 10))
    for per in (1, 8, 1000):
        found, report = blocks.search(blocks.BlockIndex.save(ix, str(tmp_path / str(per)), per), asked, 10, first=2)
        assert hits(found) == want
        read = {r.query_id: (r.read, r.postings) for r in report.collect()}
        assert all(a <= b for a, b in read.values())
        if per == 1:
            assert read[1][0] < read[1][1] / 2


def test_blocks_are_sorted_by_as_many_tasks_as_the_tokens_ask_for(spark, tmp_path, monkeypatch):
    """What one task holds does not grow with the index, and the bounds stand beside the postings they are of."""
    from quillmere.operators import blocks

    monkeypatch.setattr(index, "TASK_TOKENS", 100, raising=False)
    ix = index.Index.build(docs_of(spark, {k: " ".join(f"ord{x}" for x in range(k % 40)) for k in range(200)}))
    saved = blocks.BlockIndex.save(ix, str(tmp_path / "b"), 8)
    assert saved.postings.columns == ["term", "block", "doc_id", "tf", "dl"] and len(list((tmp_path / "b" / "postings").glob("*.parquet"))) > 20
    weighed = saved.postings.withColumn("w", blocks.weight(F.col("tf"), F.col("dl"), ix.average)).collect()
    want = {}
    for r in weighed:
        bound, n = want.get((r.term, r.block), (0.0, 0))
        want[r.term, r.block] = (max(bound, r.w), n + 1)
    assert {(r.term, r.block): (r.bound, r.n) for r in saved.bounds.collect()} == want and saved.bounds.count() == len(want)


def test_search_in_sql_counts_few_rows_a_document(spark):
    catalog.register(spark)
    texts = {k: " ".join(f"ord{x}" for x in range(k)) for k in range(1, 12)} | {20: "", 21: "1 2", 22: "ord0 ord0", 23: "ord0 ord0"}
    docs = spark.createDataFrame([*texts.items(), (30, None), (31, None)], "doc_id long, text string")
    asked = index.query_table(spark, {1: ["ord0"], 2: ["ord0", "ord5", "ord5"], 3: ["nowhere"]})
    counted = {(r.doc_id, r.term): (r.tf, r.docs) for r in spark.sql(catalog.COUNTED, documents=docs, asked=asked).collect()}
    assert counted[11, None] == (9, 1) and counted[11, "ord5"] == (1, 0) and counted[23, "ord0"] == (2, 0) and counted[31, None] == (0, 1)
    assert len(counted) == 15 + 12 + 6 and sum(n for _, n in counted.values()) == 15
    found = {(r.query_id, r.doc_id, r.score, r["rank"]) for r in catalog.search(spark, docs, asked, 5).collect()}
    ix = index.Index.build(index.collapse_copies(docs).select("doc_id", "text"), stemmed=False)
    assert found == {(r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in index.search_bm25(ix, asked, 5).collect()}


def test_search_from_any_folder(tmp_path):
    """The session sends the package to its workers, so a job may be started anywhere."""
    import subprocess
    import sys

    code = """
import sys; sys.path.insert(0, sys.argv[1])
from quillmere.session import session
from quillmere.operators import vector
spark = session(**{"spark.master": "local[1]", "spark.ui.enabled": "false"})
v = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
print("HITS", vector.search(v, v.selectExpr("vec_id AS query_id", "embedding AS vector"), 1).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "HITS 1" in done.stdout, done.stderr[-2000:]


def test_checkpoints_go_when_nothing_refers_to_them(spark, tmp_path):
    import gc
    import time

    from quillmere.shared import durable, shared_folder, swept

    folder = shared_folder(spark).removeprefix("file:")
    count = lambda: sum(len(fs) for _, _, fs in os.walk(folder))
    swept(spark)
    time.sleep(2)
    before = count()
    kept = durable(spark.range(100).repartition(3))
    assert count() > before and kept.count() == 100
    del kept
    gc.collect()
    for _ in range(20):
        swept(spark)
        time.sleep(0.5)
        if count() <= before:
            break
    assert count() <= before


def test_pages_end_to_end(spark, tmp_path):
    """Copies, links to copies, a hub, dead links and dates, from the markup to the factors."""
    from quillmere.operators.site import Site

    page = lambda title, text, *hrefs: f"<html><title>{title}</title><nav>" + "".join(f"<a href='{h}'>l</a>" for h in hrefs) + f"</nav><main>{text}</main>"
    at = datetime(2024, 1, 1)
    rows = [
        (1, "https://riksdagen.se/lag", page("Lag &amp; rätt", "lagen om lag", "/gammal", "https://other.se/x", "/bild.png"), at),
        (2, "https://riksdagen.se/ny", page("Ny", "lag igen", "lag#del", "gammal"), at + timedelta(days=30)),
        (3, "https://riksdagen.se/gammal", page("Kopia", "samma text om lag", "/lag"), None),
        (4, "https://riksdagen.se/kopia", page("Kopia", "samma text om lag", "./lag", "../../lag?x=1"), None),
        (5, "https://riksdagen.se/tom", None, None),
        (None, "https://riksdagen.se/utan", page("U", "lag"), None),
    ]
    site = Site.build(spark.createDataFrame(rows, "page_id long, url string, html string, crawled_at timestamp"), stemmed=False)
    assert {r.doc_id: r.links for r in site.documents.collect()} == {1: 1, 2: 2, 4: 2, 5: 0}
    # 3 and 4 are one text, so a link to 3 counts for 4.
    edges = {(1, 4), (2, 1), (2, 4), (4, 1)}
    score = dict.fromkeys((1, 2, 4, 5), 0.25)
    for _ in range(20):
        out = Counter(a for a, _ in edges)
        score = {v: 0.15 / 4 + 0.85 * sum(score[a] / out[a] for a, b in edges if b == v) for v in score}
    want = {v: s / max(score.values()) for v, s in score.items()}
    assert {r.doc_id: r.pagerank for r in site.ranks.collect()} == pytest.approx(want)
    hits = site.save(str(tmp_path / "site")).search({1: ["lag", "rätt"]}, F.lit("2024-02-01").cast("timestamp")).collect()
    assert {r.doc_id for r in hits} == {1, 2, 4}
    first = next(r for r in hits if r.doc_id == 1)
    assert first.title == "Lag & rätt" and first.factors.density == 87.5 and first.factors.pagerank == round(100 * want[1], 1)
    assert first.factors.recency == round(100 * 2.718281828459045 ** (-31 / 365), 1) and next(r for r in hits if r.doc_id == 4).factors.recency == 50.0
    assert first.factors.structure == 20.0 and first.factors.language == 100.0


def test_cells_find_the_neighbours_and_read_less(spark, tmp_path):
    import numpy as np

    from quillmere.operators.cells import CellIndex

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + 0.4 * rng.normal(size=16)).tolist()) for k in range(1200)] + [(5000, None), (None, [1.0] * 16), (5001, [1.0]), (5002, [float("nan")] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 40 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    held = CellIndex.save(vectors, str(tmp_path / "cells"), cells=12)
    assert held.vectors.count() == 1200
    true = {(r.query_id, r.vec_id): (r.score, r["rank"]) for r in vector.search(vectors, asked, 10).collect()}
    every = {(r.query_id, r.vec_id): (r.score, r["rank"]) for r in held.search(asked, 10, 12, block=7).collect()}
    assert every == true
    probes = held.tune(asked, 10, 0.9)
    found = {(r.query_id, r.vec_id) for r in held.search(asked, 10, probes).collect()}
    assert probes < 12 and len(found & set(true)) >= 0.9 * len(true)
    assert all(r.read < 1200 for r in held.read_for(asked, probes).collect())
    files = held.search(asked.where("query_id = 0"), 10, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in files or "PartitionFilters: [cell" in files
    none = CellIndex.save(vectors.limit(0), str(tmp_path / "none"))
    assert none.vectors.count() == 0


def test_encoder_equals_a_model(spark):
    import hashlib

    import numpy as np

    from quillmere.operators import encoder

    texts = {1: "Ett två två-tre", 2: "", 3: None, 4: "ett två TVÅ-TRE", 5: "något helt annat", 6: "x " * 5000}
    rows = spark.createDataFrame([(k, t) for k, t in texts.items()] + [(None, "x")], "doc_id long, text string")
    got = {r.vec_id: np.array(r.embedding) for r in encoder.embed(rows).collect()}
    assert set(got) == set(texts)
    for k, text in texts.items():
        want = np.zeros(64)
        for word in T_tokens(text):
            for x in np.frombuffer(hashlib.blake2b(word.encode(), digest_size=16).digest(), "<u4"):
                want[(x >> 1) % 64] += 1 if x & 1 else -1
        norm = np.sqrt((want**2).sum())
        assert got[k] == pytest.approx(want / norm if norm else want, abs=1e-6)
    vectors = encoder.embed(rows)
    near = vector.search(vectors, vectors.where("vec_id = 1").selectExpr("vec_id AS query_id", "CAST(embedding AS array<double>) AS vector"), 2)
    assert [r.vec_id for r in near.orderBy("rank").collect()] == [1, 4]
    ones = encoder.encode(F.col("text"), lambda: lambda texts: np.ones((len(texts), 2), np.float32))
    assert [r[0] for r in rows.select(ones).collect()] == [[1.0, 1.0]] * 7


def T_tokens(text):
    import re

    return re.findall(r"\w+(?:-\w+)*", (text or "").lower())


def test_what_batch_and_stream_have_read_is_compared_by_counts(spark):
    from quillmere.sources import folders

    rows = lambda *found: spark.createDataFrame(list(found), "url string, content string")
    batch, stream = rows(("a", "x"), ("a", "x"), ("b", "y"), (None, None), ("c", "z")), rows(("a", "x"), (None, None), ("d", "w"), ("c", "z"), ("c", "z"))
    got = Counter(map(tuple, folders.compared(batch, stream, "content").collect()))
    assert got == Counter([("a", "x"), ("a", "only in batch"), ("b", "only in batch"), (None, None), ("c", "z"), ("c", "only in the stream"), ("d", "only in the stream")])


def test_page_folders_in_batch_and_as_a_stream(spark, tmp_path):
    """Both read every page once, what is added later too, after a restart; broken files are passed over."""
    import json

    from quillmere.sources import folders

    folders.register(spark)
    crawl = tmp_path / "crawl"

    def save(domain, name, page):
        (crawl / domain).mkdir(parents=True, exist_ok=True)
        (crawl / domain / name).write_text(page if isinstance(page, str) else json.dumps(page, ensure_ascii=False), encoding="utf-8")

    page = lambda k, **more: {"url": f"http://a.se/{k}", "domain": "a.se", "content": f"text å {k}", "links": ["x", 3], "status_code": 200, **more}
    for k in range(5):
        save("a.se" if k % 2 else "b.se", f"{k}.json", page(k))
    save("a.se", "broken.json", "{no json")
    save("a.se", "other.json", "[1]")
    save("a.se", "empty.json", {"url": "http://a.se/none"})
    save("a.se", "odd.json", page(9, status_code="x", title=7, links=None))
    save("a.se", "notes.txt", page(50))
    batch = spark.read.format("crawled_pages").load(str(crawl))
    got = {r.url: r for r in batch.collect()}
    assert set(got) == {f"http://a.se/{k}" for k in (0, 1, 2, 3, 4, 9)}
    assert got["http://a.se/1"].links == ["x"] and got["http://a.se/1"].content == "text å 1"
    assert (got["http://a.se/9"].status_code, got["http://a.se/9"].title, got["http://a.se/9"].links) == (None, None, None)
    assert batch.rdd.getNumPartitions() == 2
    assert spark.read.format("crawled_pages").option("domains", "b.se").load(f"file://{crawl}").count() == 3
    assert spark.read.format("crawled_pages").load(str(tmp_path / "nowhere")).count() == 0

    def run():
        source = spark.readStream.format("crawled_pages").option("settle", 0).load(str(crawl)).select("url", "content")
        q = source.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return Counter(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == Counter(list(got))
    for k in (20, 21):
        save("c.se", f"{k}.json", page(k))
    want = Counter([*got, "http://a.se/20", "http://a.se/21"])
    assert run() == want and run() == want
    save("c.se", "20.json", page(20, content="anew"))
    assert run() == want + Counter(["http://a.se/20"])


def test_best_of_a_task_holds_one_tile_whatever_it_meets():
    rng = np.random.default_rng(4)
    held, asked = vector.unit(rng.integers(-2, 3, (20_000, 16)).astype(float)), vector.unit(rng.integers(-2, 3, (600, 16)).astype(float))
    held[5000:5200] = held[7]  # ties
    ids = rng.permutation(20_000)
    scores = np.clip(asked @ held.T, 0.0, 1.0).round(12)
    wanted = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :10]
    tracemalloc.start()
    best = vector.Best(len(asked), 10)
    best.meet(asked, ids[:13_000], held[:13_000])
    best.meet(asked, ids[13_000:], held[13_000:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # the scores of all pairs are 96 MB
    assert (best.rows == np.repeat(np.arange(600), 10)).all()
    assert (best.ids.reshape(600, 10) == ids[wanted]).all() and (best.scores.reshape(600, 10) == np.take_along_axis(scores, wanted, 1)).all()
    few = vector.Best(2, 10)
    few.meet(asked, ids[:3], held[:3], np.array([1]))
    assert few.rows.tolist() == [1, 1, 1] and few.batch(np.array([8, 9]))["query_id"].to_pylist() == [9, 9, 9]


def test_encoder_bounds_what_a_worker_is_handed(spark):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    encoder.embed(spark.createDataFrame([(1, "one")], "doc_id long, text string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_stem_names_each_step_once(spark):
    """In an aggregate's output, and in a lambda, nothing but the expression itself keeps a step from being computed again and again."""
    stemmed = spark.createDataFrame([("husen",)], "w string").groupBy("w").count().select(T.stem(F.col("w")).alias("s"))
    plan = stemmed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(heterna|") == 1 and plan.count("(dd|gd|nn|") == 1 and plan.count("(fullt|") == 1
    words = [None, "", "husen", "Friheten", "jaktkarlens", "klokast", "skolorna", "vänligt", "grundlös", "rådlöst", "hopplöst", "kraftfullt", "as", "tyst", "dumt", "X"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem(F.col("w")).alias("s"), F.transform(F.array("w"), T.stem)[0].alias("t")).collect()
    assert all(r["s"] == r["t"] for r in rows) and {r["w"]: r["s"] for r in rows}["husen"] == "hus" and {r["w"]: r["s"] for r in rows}[None] is None


def test_a_segments_documents_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def told(text):
        seen.add(1)
        return text

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.udf(told)(F.concat(F.lit("word"), F.col("id").cast("string"))).alias("text"))
    kept = SegmentedIndex.create(spark, str(tmp_path / "index"), stemmed=False).add(docs)
    assert seen.value == 40
    assert kept.sizes() == {"documents": 40, "filled": 40, "tokens": 40, "postings": 40}


def test_blocks_need_neither_ranks_nor_joins_of_documents(spark, tmp_path, monkeypatch):
    """A document's block follows from its length and id, so blocks are numbered through, and lengths rise with them; an index that is written splits its texts once."""
    from quillmere.operators import blocks

    split, terms = [], index.T.terms
    monkeypatch.setattr(index.T, "terms", lambda text: split.append(1) or terms(text))
    ix = index.Index.written(docs_of(spark, {k: " ".join(f"ord{x}" for x in range(k % 40)) for k in range(400)} | {400: None}), str(tmp_path / "i"), stemmed=False)
    assert len(split) == 1 and not (tmp_path / "i" / "counts").exists() and ix.n == 401
    saved = blocks.BlockIndex.save(ix, str(tmp_path / "b"), 8)
    docs = {(r.block, r.doc_id, r.dl) for r in saved.postings.collect()}
    assert len(docs) == 390 and max(b for b, _, _ in docs) == (390 - 1) // 8
    lengths = {b: [dl for c, _, dl in docs if c == b] for b, _, _ in docs}
    order = sorted(lengths)
    assert all(max(lengths[a]) <= min(lengths[b]) for a, b in zip(order, order[1:]))
