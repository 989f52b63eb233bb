"""Golden values worked from the formulas, and state machines against plain models."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.functions import swedish
from quillmere.functions import text as T
from quillmere.operators import answers, graph, index, ops, pages, portal, ranking, understanding, vector
from quillmere.sources import files
from quillmere.streaming import machines


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c if not isinstance(c, (int, float, str)) else F.lit(c) for c in columns]).first())


def test_formulas(spark):
    lit = F.lit
    got = one(
        spark, index.idf_smooth(lit(2), lit(2)), index.idf_smooth(lit(2), lit(1)), index.bm25(lit(3), lit(100), lit(120.0), lit(5), lit(100)),
        *[ranking.authority_factor(ranking.authority(lit(d))) for d in ("riksdagen.se", "example.se", "kultur.se", "su.se", "x.com")],
        *[ranking.structure_factor(lit(n).cast("int")) for n in (0, 3, 5, 50, 100, None)],
        ranking.density_factor(F.array(lit("a"), lit("b")), lit("a"), lit("a b")),
        *[ranking.recency_factor(lit(f"2024-01-{d:02d}").cast("timestamp"), lit("2024-01-31").cast("timestamp")) for d in (31, 1)],
        ranking.final_score({"tf_idf": lit(0.5), "pagerank": lit(1.0), "authority": lit(1.0), "recency": lit(0.9210952933), "density": lit(0.75), "structure": lit(0.6), "language": lit(0.7)}),
        ranking.recency_factor(ranking.parse_moment(lit("no date")), lit("2024-01-31").cast("timestamp")), ranking.backoff(lit(9)), ranking.safe_divide(lit(1.0), lit(0.0)),
    )
    want = (1.0, 1.4054651081, 5.0615172602, 1.0, 0.3428571429, 0.7142857143, 0.3428571429, 0.2857142857, 0.0, 0.6, 1.0, 1.0, 0.5, 0.3, 0.625, 1.0, 0.9210952933, 78.3164294, 0.5, 60.0, 0.0)
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(
    ("vertices", "edges", "want"),
    [
        ("ABC", ["AB", "BC", "CA"], {"A": 1.0, "B": 1.0, "C": 1.0}),
        ("123h", ["1h", "2h", "3h"], {"h": 1.0, "1": 0.2816901408, "2": 0.2816901408, "3": 0.2816901408}),
        ("abcd", ["ab", "ac", "bc", "ca", "dc"], {"a": 0.9451403108, "b": 0.4967943330, "c": 1.0, "d": 0.0951403108}),
    ],
)
def test_pagerank(spark, vertices, edges, want):
    found = graph.pagerank(spark.createDataFrame([(v,) for v in vertices], "id string"), spark.createDataFrame([(e[0], e[1]) for e in edges], "src string, dst string"))
    assert {r.id: r.score for r in found.collect()} == pytest.approx(want, abs=1e-9)


def test_compounds_and_stems(spark):
    assert swedish.split_balanced("riksdagsledamot") == ["riksdag", "ledamot"] and swedish.split_balanced("universitet") == ["unive", "rsitet"]
    assert swedish.split_balanced("student") == ["student"] and swedish.split_known("midsommarafton") == ["midsommar", "afton"]
    assert swedish.split_marked("arbetstillstånd") == ["arbet", "tillstånd"] and swedish.split_marked("bil") == ["bil"]
    words = {"flickorna": "flick", "klostret": "klostret", "lagar": "lag", "jaktkarl": "jaktkarl", "husets": "huset", "friskt": "frisk", "möjlig": "möj", "lös": "lös", "fullt": "fullt", "stegvis": "stegvis"}
    words |= {"skolans": "skolan", "handeln": "handeln", "hundarnas": "hund", "riktig": "rikt"}
    got = one(spark, *[T.stem(F.lit(w)) for w in words])
    assert dict(zip(words, got)) == words


def test_queries(spark):
    lit = F.lit
    kinds = ["hur många bor här", "vilka är det", "en bil"]
    assert one(spark, *[T.question_type(lit(k)) for k in kinds]) == ("HOW_MANY", "WHO", "STATEMENT")
    assert one(spark, T.reformulate_question(lit("Hur kan jag söka jobb?")), T.clean_snippet(lit("a  b")), T.strip_tags(lit("<b>x</b><script>y</script>"))) == ("söka jobb", "a b", "xy")
    assert one(spark, T.expand_query(lit("lag skola")))[0].split()[:3] == ["lag", "lagstiftning", "legislation"]
    assert one(spark, T.query_variants(lit("Vad är Sverige")))[0] == ["Vad är Sverige", "sverige", "Sverige"]
    assert one(spark, T.query_variants(lit("bilarna")))[0] == ["bilarna", "bilarn", "bilar", "bil", "Bilarna"]
    assert one(spark, F.size(T.suggest(lit("s"))), T.suggest(lit("sk"))) == (0, ["skatteverket"])
    asked = {
        "Restaurang Stockholm": ("Stockholm", 2.0, False, "LOCAL"), "Västra Götaland kommuner": ("Västra Götaland", 1.5, False, "LOCAL"),
        "Ansökan arbetstillståndet Migrationsverket": (None, 1.0, True, "OFFICIAL"), "Vad är skillnaden mellan landsting och region?": (None, 1.0, False, "DEFINITION"),
        "Hur lång är Öresundsbron?": (None, 1.0, False, "GENERAL"), "Senaste nytt idag": (None, 1.0, False, "NEWS"),
    }
    rows = understanding.with_context(spark.createDataFrame([(q,) for q in asked], "q string"), "q", "c").collect()
    assert {r.q: (r.c.scope, r.c.region_boost, r.c.official, r.c.intent) for r in rows} == asked
    assert {r.q: r.c.official_boost for r in rows}["Ansökan arbetstillståndet Migrationsverket"] == 2.0
    assert one(spark, understanding.query_place(lit("pizzeria i göteborg")), understanding.regional_score(lit(50.0), lit("lund"), lit("malmö"), lit("lund"))) == ("göteborg", 97.5)
    assert one(spark, answers.classify(lit("skillnad mellan a och b"))["kind"], answers.agency(lit("https://skatteverket.se/x"))) == ("COMPARISON", "Skatteverket")
    weights = one(spark, *[vector.hybrid_weights(lit(q))["semantic"] for q in ("två ord", "hur långt är", "ett två tre fyra fem", "tre ord här")])
    assert weights == (0.6, 0.45, 0.2, 0.3)


def test_hybrid(spark):
    keyword = spark.createDataFrame([(1, 1, 6.0), (1, 2, 8.0)], "query_id long, doc_id long, score double")
    near = spark.createDataFrame([(1, 1, 0.5), (1, 3, 1.0)], "query_id long, doc_id long, score double")
    assert {r.doc_id: r.score for r in vector.fuse(keyword, near).collect()} == pytest.approx({1: 0.675, 2: 0.7, 3: 0.3})
    assert {r.doc_id: r.score for r in vector.fuse(keyword, near, 0.4, 0.6).collect()}[1] == pytest.approx(0.6)


def test_pages(spark):
    lit, base = F.lit, "https://a.se/x/y?q=1#z"
    got = one(spark, *[pages.resolve(lit(base), lit(h)) for h in ("/p", "q", "#t", "?a", "//b.se/c", "http://c.se/#f")])
    assert got == ("https://a.se/p", "https://a.se/x/q", "https://a.se/x/y?q=1", "https://a.se/x/y?a", "https://b.se/c", "http://c.se/")
    html = '<html lang="en"><head><title> A &amp; B </title><meta content="d" name="description"></head><body><nav>n</nav><article>x <b>y</b><script>z</script></article></body></html>'
    assert one(spark, pages.title(lit(html)), pages.meta(lit(html), "description"), pages.language(lit(html)), pages.main_text(lit(html))) == ("A & B", "d", "en", "x y")
    urls = spark.createDataFrame([("http://a/x/1",), ("http://a/y",), ("http://b/",)], "url string")
    rules = spark.createDataFrame([("http://a", "/", True), ("http://a", "/x", False), ("http://a", "/x/1", True)], "origin string, prefix string, allow boolean")
    assert pages.robots_allowed(urls, rules).where("not allowed").count() == 0
    assert pages.domain_table(spark).select("domain").distinct().count() == 98


def events(spark, seed, n=400):
    rng, at, rows = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 5, 40]))
        rows.append((i, at, rng.randrange(5), rng.random() < 0.6))
    return rows, spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, ok boolean")


def test_rate_limit_model(spark):
    rows, df = events(spark, 1)
    got = {r.event_id: r.result for r in machines.run_batch(df, "user_id", machines.rate_limit(3, 60.0)).collect()}
    seen = {}
    for i, at, user, _ in rows:
        times = [t for t in seen.get(user, []) if (at - t).total_seconds() < 60]
        assert got[i] == ("refused" if len(times) >= 3 else "allowed")
        seen[user] = times if len(times) >= 3 else [*times, at]


def test_cooldown_and_breaker_models(spark):
    rows, df = events(spark, 2)
    got = {r.event_id: r.result for r in machines.run_batch(df.withColumn("ok", F.lit(False)), "user_id", machines.cooldown(100)).collect()}
    last = {}
    for i, at, user, _ in rows:
        sent = user not in last or (at - last[user]).total_seconds() >= 100
        assert got[i] == ("sent" if sent else "held")
        last[user] = at if sent else last[user]
    results = [r.result for r in machines.run_batch(df, "user_id", machines.circuit_breaker(2, 30)).collect()]
    assert set(results) == {"closed", "open", "refused"}
    for outcome, n, want in ((True, 60, "10"), (False, 4, "40"), (False, 40, "60")):
        machine = machines.adaptive_timeout()
        state = machine.start()
        for _ in range(n):
            state, result = machine.step(state, 0.0, outcome)
        assert result == want


def test_cache_entry_lives_from_its_filling():
    machine, hours = machines.cache_entry(), 3600.0
    state, results = machine.start(), []
    for at in (0, 13, 24, 26, 49, 51):
        state, result = machine.step(state, at * hours, True)
        results.append(result)
    assert results == ["miss", "hit", "hit", "miss", "hit", "miss"]


@pytest.mark.parametrize("name", ["rate_limit_block", "breaker", "cache"])
def test_stream_equals_batch(spark, tmp_path, name):
    made = {
        "rate_limit": machines.rate_limit(3, 60.0), "rate_limit_block": machines.rate_limit(2, 60.0, 300.0), "cooldown": machines.cooldown(100.0),
        "breaker": machines.circuit_breaker(2, 30.0), "cache": machines.cache_entry(200.0), "timeout": machines.adaptive_timeout(),
    }
    _, df = events(spark, 3, 60)
    df.where("event_id < 30").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("event_id >= 30").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = machines.run_stream(source, "user_id", made[name]).writeStream.format("memory").queryName(f"s_{name}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    want = {tuple(r) for r in machines.run_batch(df, "user_id", made[name]).collect()}
    assert {tuple(r) for r in spark.table(f"s_{name}").collect()} == want


def test_running_mean_and_quantile(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([0, 0, 0, 1]), datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(60)), rng.choice([rng.uniform(0, 9), 2.0])) for i in range(300)] + [(900, 5, datetime(2024, 1, 1), 1.5)]
    df = spark.createDataFrame(rows, "event_id long, k long, ts timestamp, v double")
    got = {r.event_id: r["mean"] for r in ops.running_mean(df, "v", "ts", "k").collect()}
    for k in (0, 1, 5):
        own = sorted((t, i, v) for i, kk, t, v in rows if kk == k)
        for n, (_, i, _) in enumerate(own, 1):
            assert got[i] == pytest.approx(sum(v for *_, v in own[:n]) / n)
    want = {k: float(np.quantile([v for _, kk, _, v in rows if kk == k], 0.95)) for k in (0, 1, 5)}
    assert {r.k: r.quantile for r in ops.quantile(df, "v", "k", 0.95).collect()} == pytest.approx(want)


def test_capped_postings(spark):
    rows = [("a", d, d % 4) for d in range(200)] + [("b", d, 1) for d in range(3)]
    got = {(r.term, r.doc_id) for r in index.capped(spark.createDataFrame(rows, "term string, doc_id long, tf long"), 7).collect()}
    assert got == {("a", d) for d in [x for x in range(200) if x % 4 == 3][:7]} | {("b", d) for d in range(3)}


def test_unescape_and_content_block(spark):
    lit = F.lit
    assert one(spark, pages.unescape(lit("&aring;&ouml; &#229;&#xE5; &amp;lt; &lt; &nope; &#x1F600; &amp;#229;"))) == ("åö åå &lt; < &nope; 😀 &#229;",)
    html = '<body><div class="content main">a <div>b</div> c</div><div>foot</div></body>'
    assert one(spark, pages.main_text(lit(html)), pages.main_text(lit("<body>x &copy;</body>"))) == ("a b c", "x ©")


def test_search_over_a_saved_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "lag och rätt lag"), (2, "lag"), (3, "skola " * 5)], "doc_id long, text string")
    built = index.Index.build(docs, stemmed=False)
    saved = built.save(str(tmp_path / "i"))
    asked = index.query_table(spark, {1: ["lag", "rätt"], 2: ["skola"], 3: ["finns-ej"]})
    for search in (index.search_tfidf, index.search_bm25, index.search_relational):
        a, b = ([tuple(r) for r in search(ix, asked, 5).orderBy("query_id", "rank").collect()] for ix in (built, saved))
        assert a == b and [r[1] for r in a] == [1, 2, 3]
    plan = search(saved, asked, 5)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term)" in plan or "In(term" in plan


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("u", "a.se", "old", "2024-01-01"), ("u", "a.se", "new", "2024-01-02")], "url string, domain string, content string, crawled_at string")
    files.write_pages(rows, str(tmp_path / "p"))
    assert [r.content for r in spark.read.parquet(str(tmp_path / "p")).collect()] == ["new"]
    docs = spark.createDataFrame([(1, "lag och rätt"), (2, "lag")], "doc_id long, text string")
    saved = index.Index.build(docs).save(str(tmp_path / "i"))
    assert saved.stats().first().num_documents == 2 and saved.verify().first().valid and saved.document(2).count() == 1
    for stamp in ("20240101_000000", "20240201_000000"):
        files.backup(spark, {"terms": saved.terms.withColumn("s", F.lit(stamp))}, str(tmp_path / "b"), stamp)
    assert files.restore(spark, str(tmp_path / "b"), "terms").first().s == "20240201_000000"
    (tmp_path / "own.ini").write_text("[crawler]\nworkers = 3\ndelay = 0.5\n[other]\nworkers = 9\n")
    assert files.Settings.read(str(tmp_path / "own.ini")) == files.Settings(workers=3, delay=0.5) and files.Settings.read(str(tmp_path / "none.ini")) == files.Settings()
    lines = spark.createDataFrame([("svt.se: completed 12 pages",), ("Crawled: http://x",), ("ERROR: y",), ("z",)], "value string")
    assert [(r.kind, r.number) for r in files.parse_log_lines(lines, F.col("value")).collect()] == [("domain", 12), ("page", None), ("error", None), ("other", None)]


def test_portal(spark):
    accounts = spark.createDataFrame([("a", "x", ["p", "q"], "active", ""), ("b", "x", [], "active", "")], "username string, role string, available_apps array<string>, status string, password_hash string")
    registry = spark.createDataFrame([("q", "Q"), ("p", "P")], "app_id string, app_name string")
    got = {r.username: [a.app_name for a in r.apps] for r in portal.apps_of(accounts, registry).collect()}
    assert got == {"a": ["P", "Q"], "b": []}
    assert portal.remove_app(accounts, "p").first().available_apps == ["q"] and "password_hash" not in portal.sanitized(accounts).columns
    assert math.isclose(sum(portal.page_offset(3, 10)), 30)


def test_entry_has_every_query(spark):
    import __spark_entry__

    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and __spark_entry__.entry(spark).count() > 0


def test_full_text_match_stems_few_words(spark):
    """The stems of a whole text are not made where few of its words begin as the query's do."""
    from quillmere.functions import text as T

    texts = ["the boats and bilarna that", "bilen", None, "", "båtarna bilar", "Båten och BILARNAS", "b i l", "bil-arna båt"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    for query in ("bilar", "bilar båten", "the that", "", "och", None):
        want = {r.id: r.m for r in df.select("id", (F.size(F.array_except(F.array_distinct(T.stems(F.lit(query).cast("string"))), T.stems(F.col("text")))) == 0).alias("m")).collect()}
        assert {r.id: r.m for r in df.select("id", T.matches_all(F.lit(query).cast("string"), F.col("text")).alias("m")).collect()} == want
    assert "startswith" in df.select(T.matches_all(F.lit("bilar"), F.col("text")).alias("m"))._jdf.queryExecution().analyzed().toString().lower()


def test_postings_are_counted_where_they_are(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(["bil båt bil", "båt", "", None, "och 12", "ö-stad zebra bil zebra zebra"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = index.postings(docs, stemmed=False)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = {("bil", 0, 2, 3), ("båt", 0, 1, 3), ("båt", 1, 1, 1), ("ö-stad", 5, 1, 5), ("zebra", 5, 3, 5), ("bil", 5, 1, 5)}
    assert sorted(map(tuple, found.select("term", "doc_id", "tf", "dl").collect())) == sorted(want)
    saved, written = index.Index.build(docs, stemmed=False).save(str(tmp_path / "a")), index.Index.written(docs, str(tmp_path / "b"), stemmed=False)
    assert (written.n, written.average) == (saved.n, saved.average)
    for name in ("documents", "postings", "terms"):
        a, b = getattr(saved, name), getattr(written, name)
        assert a.schema == b.schema and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_cap_ranks_only_terms_over_it(spark):
    post = spark.createDataFrame([("a", k, k % 3, 1) for k in range(20)] + [("b", k, 1, 1) for k in range(5)] + [("c", 1, 1, 1)], "term string, doc_id long, tf long, dl long")
    found = index.capped(post, 5)
    best = sorted(((-(k % 3), k) for k in range(20)))[:5]
    assert sorted((r.term, r.doc_id) for r in found.collect()) == sorted([("a", k) for _, k in best] + [("b", k) for k in range(5)] + [("c", 1)])
    assert "LeftAnti" in found._jdf.queryExecution().executedPlan().toString()


def test_pages_of_one_url_and_time_all_stay(spark, tmp_path):
    rows = [("u", "a", "2024-01-01", "x"), ("u", "b", "2024-02-01", "x"), ("u", "c", "2024-02-01", "x"), ("u", "c", "2024-02-01", "x"), ("v", "d", None, "y")]
    files.write_pages(spark.createDataFrame(rows, "url string, content string, crawled_at string, domain string"), str(tmp_path / "p"))
    assert sorted((r.url, r.content) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [("u", "b"), ("u", "c"), ("u", "c"), ("v", "d")]


def test_files_of_one_row_are_written_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = spark.range(200).coalesce(1).select(F.concat(F.lit("n"), F.col("id")).alias("username"), F.lit("user").alias("role"))
    files.write_singly(rows.withColumn("_folder", F.lit("a")), path, "append")
    files.write_singly(rows.where("id % 2 = 0").withColumn("role", F.lit("later")).withColumn("_folder", F.lit("b")), path, "append")
    (tmp_path / "a" / "_folder=a" / "notes.txt").write_text("no account")
    (tmp_path / "a" / "_folder=a" / "deep").mkdir()
    (tmp_path / "a" / "_folder=a" / "deep" / "x.json").write_text('{"username": "deep"}')
    written = list((tmp_path / "a").glob("*/*.json"))
    assert len(written) == 300 and len({x.name.split("-")[1] for x in written}) > 8
    assert sorted((r.username, r.role) for r in files.read_accounts(spark, path).collect()) == sorted((f"n{k}", "later" if k % 2 == 0 else "user") for k in range(200))


def test_nested_index_begins_no_lists_before_the_shuffle(spark):
    rows = [(f"t{d % 7}", d, d % 3 + 1) for d in range(60)]
    post = spark.createDataFrame([(*r, 9) for r in rows], "term string, doc_id long, tf long, dl long")
    nested = index.nested_index(post)
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in plan and "Aggregate" not in plan[plan.index("Exchange") :]
    assert sorted(map(tuple, index.flatten_index(nested).collect())) == sorted(rows)


def test_files_of_one_row_are_neither_made_by_processes_nor_listed_by_the_driver(spark, tmp_path):
    """Hadoop's local file system starts processes for a file and its checksum, Spark's reader holds a status of each file in the driver."""
    path = str(tmp_path / "a")
    rows = spark.createDataFrame([("u1", "å\n\"x", "a=b/c"), ("u2", None, None), ("u3", "", "d")], "username string, full_name string, _folder string")
    files.write_singly(rows, path)
    assert not list((tmp_path / "a").rglob("*.crc"))
    assert sorted(x.name for x in (tmp_path / "a").iterdir()) == ["_folder=__HIVE_DEFAULT_PARTITION__", "_folder=a%3Db%2Fc", "_folder=d"]
    with pytest.raises(FileExistsError):
        files.write_singly(rows, path)
    files.write_singly(rows, path, "overwrite")
    found = files.read_accounts(spark, path)
    assert sorted((r.username, r.full_name) for r in found.select("username", "full_name").collect()) == [("u1", "å\n\"x"), ("u2", None), ("u3", "")]
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()


def test_odd_files_of_one_row_are_read_as_spark_reads_them(spark, tmp_path):
    odd = {
        "d/list.json": b'[{"username": "a"}, {"username": "b", "meta": {"k": "v"}}]', "d/broken.json": b'{"username": "c', "d/empty.json": b"", "d/blank.json": b" \n", "d/two.json": b'{"username": "d"}\n{"username": "e"}', "d/word.json": b"12",
        "d/kind.json": b'{"username": "f", "available_apps": 3, "role": {"x":1}, "meta": {"n": 1}}', "d/wide.json": '{"username": "gå"}'.encode("utf-16"), "d/mark.json": b'\xef\xbb\xbf{"username": "h"}', "d/raw.json": b'{"username": "i\xff"}',
        "d/lines.json": b'\n {\n "username":\n "j"}', "d/.hidden.json": b'{"username": "k"}', "d/_hidden.json": b'{"username": "l"}', "d/other.txt": b'{"username": "m"}', "d/sub/x.json": b'{"username": "n"}', "top.json": b'{"username": "o"}', "_d/p.json": b'{"username": "p"}', "e f%20å/q r.json": b'{"username": "q"}', "d/nest.json": b'[[{"username": "r"}]]', "d/none.json": b"null", "d/lists.json": b' [{"username": "s", "role": [1]}, {"username": 5}]',
    }
    for name, data in odd.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    plain = spark.read.schema(files.ACCOUNT).option("multiLine", True).option("pathGlobFilter", "*.json").json(f"{tmp_path}/*/").where("username is not null")
    want = sorted(map(str, plain.collect()))
    assert len(want) > 8 and sorted(map(str, files._singly(spark, files.ACCOUNT, str(tmp_path)).where("username is not null").select(plain.columns).collect())) == want
