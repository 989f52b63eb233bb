"""Registered queries over the star-schema and text tables, each with its SQL twin where SQL can express it.

Counts are longs and doubles rounded to six places, so that both sides agree exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import lexicon as L
from quillmere.functions import swedish
from quillmere.functions import text as T
from quillmere.operators import answers, graph, index, ops, pages, portal, ranking, understanding, vector
from quillmere.shared import changed, local_table, remove_path, scratch_path
from quillmere.streaming import machines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(column, places: int = 6):
    return F.round(column, places)


# --- what several queries' SQL shares -----------------------------------------------------------------------------
def _sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_TOKENS = rf"regexp_extract_all(lower(text), '{T.TOKEN}')"
_TERMS = f"list_filter({_TOKENS}, lambda t: length(t) BETWEEN 2 AND 45 AND regexp_matches(t, '[a-zåäöÅÄÖ]') AND t NOT IN ({_sql_list(L.STOPWORDS)}))"
_POSTINGS = f"""
docs AS (SELECT md5(text) AS h, max(doc_id) AS doc_id, any_value(text) AS text FROM documents GROUP BY 1),
tok AS (SELECT doc_id, unnest({_TERMS}) AS term FROM docs),
post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM docs),
terms AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
dl AS (SELECT doc_id, sum(tf) AS dl FROM post GROUP BY 1)"""
#: Query id to terms; the third repeats a term.
_ASKED = {1: ["the", "that"], 2: ["une", "eau"], 3: ["of", "of", "in"], 4: ["der", "nicht"], 5: ["para", "que", "las"]}
_ASKED_SQL = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{t}')" for k, ts in _ASKED.items() for t in ts) + ") AS v(query_id, term))"


#: Indexes saved in this application, by application and folder, with what their documents were when they were indexed, and where they are.
_SAVED: dict[tuple[str, str], tuple[object, index.Index, str]] = {}


def _built(spark: SparkSession, sf_dir: str, path: str) -> index.Index:
    """An index of the distinct documents, terms as they stand, saved at a path."""
    docs = index.collapse_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return index.Index.written(docs.select("doc_id", "text"), path, stemmed=False)


def _unstemmed(spark: SparkSession, sf_dir: str) -> index.Index:
    """The same, saved in the shared folder when it is first asked for, and again when the documents have changed; the old one goes then."""
    key, now = (spark.sparkContext.applicationId, sf_dir), changed(spark, f"{sf_dir}/documents.parquet")
    if key not in _SAVED or _SAVED[key][0] != now:
        path = scratch_path(spark, "index")
        found = _built(spark, sf_dir, path)
        if key in _SAVED:
            remove_path(spark, _SAVED[key][2])
        _SAVED[key] = (now, found, path)
    return _SAVED[key][1]


# --- tokens and the index -----------------------------------------------------------------------------------------
@query(f"SELECT term, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({_TOKENS}) AS term FROM documents) GROUP BY 1")
def tokenize_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.explode(T.tokenize(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, CAST(len({_TOKENS}) AS INTEGER) AS n_tokens, CAST(len({_TERMS}) AS INTEGER) AS n_terms FROM documents")
def stopword_length_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(T.tokenize(F.col("text"))).alias("n_tokens"), F.size(T.terms(F.col("text"))).alias("n_terms"))


_STEM_SQL = rf"""
w AS (SELECT DISTINCT unnest({_TERMS}) AS w FROM documents),
a AS (SELECT w, CASE WHEN regexp_matches(w, '{T._R1}') THEN greatest(length(regexp_extract(w, '{T._R1}', 0)), 3) ELSE length(w) END AS r FROM w),
b AS (SELECT w, r, regexp_extract(substring(w, r + 1), '{T._STEP1}', 0) AS s FROM a),
c AS (SELECT w, r, CASE WHEN s <> '' THEN left(w, length(w) - length(s))
  WHEN ends_with(substring(w, r + 1), 's') AND regexp_matches(w, '[bcdfghjklmnoprtvy]s$') THEN left(w, length(w) - 1) ELSE w END AS x FROM b),
d AS (SELECT w, r, CASE WHEN regexp_matches(substring(x, r + 1), '(dd|gd|nn|dt|gt|kt|tt)$') THEN left(x, length(x) - 1) ELSE x END AS x FROM c),
e AS (SELECT w, x, regexp_extract(substring(x, r + 1), '(fullt|löst|els|lig|ig)$', 0) AS s FROM d)
SELECT w AS term, CASE WHEN s IN ('fullt', 'löst') THEN left(x, length(x) - 1) WHEN s <> '' THEN left(x, length(x) - length(s)) ELSE x END AS stem FROM e"""


@query("WITH " + _STEM_SQL)
def stem_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    terms = docs.select(F.explode(T.terms(F.col("text"))).alias("term")).distinct()
    return terms.select("term", T.stem(F.col("term")).alias("stem"))


@query(f"""WITH {_POSTINGS} SELECT round((SELECT avg(dl) FROM dl), 6) AS avg_doc_length, CAST((SELECT count(*) FROM post) AS BIGINT) AS total_postings,
  CAST((SELECT count(*) FROM terms) AS BIGINT) AS num_terms, CAST((SELECT n FROM n) AS BIGINT) AS num_documents""")
def index_stats(spark, sf_dir):
    return _unstemmed(spark, sf_dir).stats().select(_r(F.col("avg_doc_length")).alias("avg_doc_length"), "total_postings", "num_terms", "num_documents")


@query(f"""WITH {_POSTINGS} SELECT CAST((SELECT count(*) FROM post) AS BIGINT) AS postings, CAST((SELECT sum(tf) FROM post) AS BIGINT) AS tokens, CAST((SELECT count(*) FROM terms) AS BIGINT) AS terms""")
def index_build(spark, sf_dir):
    """Builds and saves an index, and counts what was saved. [SNK3, SRC3]"""
    path = scratch_path(spark, "built")
    saved = _built(spark, sf_dir, path)
    sums = saved.postings.agg(F.count("*"), F.coalesce(F.sum("tf"), F.lit(0))).first()
    found = local_table(spark, {"postings": [sums[0]], "tokens": [sums[1]], "terms": [saved.terms.count()]}, "postings long, tokens long, terms long")
    remove_path(spark, path)
    return found


@query(f"WITH {_POSTINGS} SELECT term, CAST(df AS BIGINT) AS df, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf, round(ln((n + 1) / (df + 1)), 6) AS idf_sql FROM terms, n")
def term_idf(spark, sf_dir):
    ix = _unstemmed(spark, sf_dir)
    return ix.terms.select("term", "df", _r(F.col("idf")).alias("idf"), _r(index.idf_sql(F.lit(ix.n), F.col("df"))).alias("idf_sql"))


_RANKED = "row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id)"


def _search_sql(score: str) -> str:
    return f"""WITH {_POSTINGS}, {_ASKED_SQL},
    hit AS (SELECT query_id, doc_id, sum({score}) AS s FROM q JOIN post USING (term) JOIN terms USING (term) JOIN dl USING (doc_id), n, (SELECT avg(dl) AS avgdl FROM dl) GROUP BY 1, 2),
    r AS (SELECT query_id, doc_id, s, {_RANKED} AS rank FROM hit)
    SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"""


def _hits(found: DataFrame) -> DataFrame:
    return found.select("query_id", "doc_id", _r(F.col("score")).alias("score"), "rank")


@query(_search_sql("tf * (ln((n + 1) / (df + 1)) + 1)"))
def tfidf_search_topk(spark, sf_dir):
    return _hits(index.search_tfidf(_unstemmed(spark, sf_dir), index.query_table(spark, _ASKED), 10, cap=None))


@query(_search_sql("tf * ln((n + 1) / (df + 1)) * ln((n + 1) / (df + 1))"))
def sql_backend_search(spark, sf_dir):
    return _hits(index.search_relational(_unstemmed(spark, sf_dir), index.query_table(spark, _ASKED), 10))


@query(_search_sql("ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))"))
def bm25_search_topk(spark, sf_dir):
    return _hits(index.search_bm25(_unstemmed(spark, sf_dir), index.query_table(spark, _ASKED), 10))


@query(f"""WITH {_POSTINGS}, rare AS (SELECT term FROM terms UNION SELECT 'no-such-term')
  SELECT term, CAST(count(doc_id) AS BIGINT) AS doc_count, round(avg(tf), 6) AS avg_tf FROM rare LEFT JOIN post USING (term) GROUP BY 1""")
def term_statistics(spark, sf_dir):
    ix = _unstemmed(spark, sf_dir)
    terms = ix.terms.select("term").unionByName(spark.createDataFrame([("no-such-term",)], "term string"))
    return index.term_view(ix.postings, terms).select("term", "doc_count", _r(F.col("avg_tf")).alias("avg_tf"))


@query("SELECT md5(text) AS content_hash, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    return index.collapse_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("content_hash", "doc_id", "source")


@query(r"""WITH t AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents)
  SELECT doc_id, left(text, 200) AS first_200, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INTEGER) AS words,
    CASE WHEN length(c) > 200 THEN CASE WHEN contains(left(c, 200), ' ') THEN regexp_extract(left(c, 200), '(?s)^(.*) ', 1) ELSE left(c, 200) END || '…' ELSE c END AS snippet FROM t""")
def snippet_wordcount(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.substring("text", 1, 200).alias("first_200"), T.word_count(F.col("text")).alias("words"), T.clean_snippet(F.col("text")).alias("snippet"))


@query(f"""WITH {_POSTINGS}, both_sides AS (SELECT term, doc_id, tf, 1 AS side FROM post UNION ALL SELECT term, doc_id, tf + 1, 2 FROM post WHERE doc_id % 2 = 0 UNION ALL SELECT 'new-term', doc_id, 7, 2 FROM docs)
  SELECT term, doc_id, CAST(arg_max(tf, side) AS BIGINT) AS tf FROM both_sides GROUP BY 1, 2""")
def upsert_postings(spark, sf_dir):
    ix = _unstemmed(spark, sf_dir)
    old = ix.postings.select("term", "doc_id", "tf")
    fresh = ix.documents.select(F.lit("new-term").alias("term"), "doc_id", F.lit(7).cast("long").alias("tf"))
    return index.upsert_postings(old, old.where("doc_id % 2 = 0").withColumn("tf", F.col("tf") + 1).unionByName(fresh))


@query(f"""WITH {_POSTINGS} SELECT term, CAST(sum(tf) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS docs FROM post GROUP BY 1""")
def nested_index_round_trip(spark, sf_dir):
    flat = index.flatten_index(index.nested_index(_unstemmed(spark, sf_dir).postings))
    return flat.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("docs"))


@query(f"""WITH {_POSTINGS}, r AS (SELECT term, doc_id, tf, row_number() OVER (PARTITION BY term ORDER BY tf DESC, doc_id) AS rk FROM post)
  SELECT term, doc_id, CAST(tf AS BIGINT) AS tf FROM r WHERE rk <= {L.POSTING_CAP}""")
def capped_postings(spark, sf_dir):
    return index.capped(_unstemmed(spark, sf_dir).postings, L.POSTING_CAP).select("term", "doc_id", "tf")


# --- pages --------------------------------------------------------------------------------------------------------
#: References that stand in the pages; those known from old times count without their semicolon.
_UNESCAPE = "regexp_replace(replace(replace(regexp_replace(replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;?', '\"', 'g'), '&#39;', ''''), '&nbsp;', ' '), '&amp;?', '&', 'g')"
_HOST = "regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)"


@query(f"""SELECT page_id, coalesce(nullif(trim({_UNESCAPE.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}), ''), 'Untitled') AS title,
  coalesce(nullif(regexp_extract(html, '(?is)<html[^>]*\\slang=["'']?([A-Za-z-]+)', 1), ''), 'sv') AS language, {_HOST} AS domain FROM pages""")
def html_title_lang(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", pages.title(F.col("html")).alias("title"), pages.language(F.col("html")).alias("language"), pages.host(F.col("url")).alias("domain"))


@query(f"""WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'g') AS h FROM pages),
  m AS (SELECT page_id, CASE WHEN regexp_matches(h, '(?is)<main[^>]*>(.*?)</main>') THEN regexp_extract(h, '(?is)<main[^>]*>(.*?)</main>', 1)
    WHEN regexp_matches(h, '(?is)<article[^>]*>(.*?)</article>') THEN regexp_extract(h, '(?is)<article[^>]*>(.*?)</article>', 1) ELSE regexp_extract(h, '(?is)<body[^>]*>(.*)</body>', 1) END AS h FROM b),
  t AS (SELECT page_id, trim(regexp_replace({_UNESCAPE.format("regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS content FROM m)
  SELECT page_id, md5(content) AS content_hash, CAST(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) AS INTEGER) AS word_count FROM t""")
def html_main_text(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", pages.main_text(F.col("html")).alias("content"))
    return rows.select("page_id", F.md5("content").alias("content_hash"), T.word_count(F.col("content")).alias("word_count"))


_SKIP = "|".join(L.SKIP_EXTENSIONS)


@query(rf"""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href=["'']([^"'']*)["'']', 1)) AS href FROM pages),
  r AS (SELECT page_id, url, regexp_replace(CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href
    WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-zA-Z]+)://', 1) || ':' || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || href
    WHEN starts_with(href, '#') OR href = '' THEN url WHEN starts_with(href, '?') THEN regexp_replace(url, '[?#].*$', '') || href
    ELSE regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+(/[^?#]*/|/)?', 1), ''), '/') || href END, '#.*$', '') AS link FROM h)
  SELECT DISTINCT page_id, link FROM r WHERE contains(regexp_extract(link, '^[a-zA-Z]+://([^/?#]+)', 1), {_HOST}) AND regexp_matches(link, '^https?://') AND NOT regexp_matches(link, '(?i)\.({_SKIP})$')""")
def html_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", F.explode(pages.links(F.col("html"), F.col("url"))).alias("link"))


_CASE_AUTHORITY = "CASE " + " ".join(f"WHEN d = '{k}' THEN {v}" for k, v in L.AUTHORITY.items()) + " " + " ".join(f"WHEN ends_with(d, '{k}') THEN {v}" for k, v in L.AUTHORITY.items()) + " ELSE 1.0 END"


@query(f"""WITH s AS (SELECT page_id, {_HOST} AS d FROM pages UNION ALL SELECT -1, 'riksdagen.se' UNION ALL SELECT -2, 'example.se' UNION ALL SELECT -3, 'kultur.se' UNION ALL SELECT -4, 'su.se')
  SELECT page_id, CAST({_CASE_AUTHORITY} AS DOUBLE) AS boost, round(least(1.0, CAST({_CASE_AUTHORITY} AS DOUBLE) / 3.5), 6) AS factor FROM s""")
def domain_authority(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select("page_id", pages.host(F.col("url")).alias("d"))
    known = spark.createDataFrame([(-1, "riksdagen.se"), (-2, "example.se"), (-3, "kultur.se"), (-4, "su.se")], "page_id long, d string")
    boost = ranking.authority(F.col("d"))
    return hosts.unionByName(known).select("page_id", boost.alias("boost"), _r(ranking.authority_factor(boost)).alias("factor"))


@query(rf"""SELECT page_id, contains({_HOST}, 'example') AND regexp_matches(url, '^https?://') AND NOT regexp_matches(url, '(?i)\.({_SKIP})$') AS crawlable,
  regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), '/.*$', ''), '^www\.', '') LIKE '%example.com' AS allowed FROM pages""")
def url_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", pages.crawlable(F.col("url"), F.lit("example")).alias("crawlable"), pages.allowed_domain(F.col("url"), ["example.com"]).alias("allowed"))


_DOMAIN_ROWS = ", ".join(f"('{d}', '{k}')" for k, v in L.DOMAINS.items() for d in v.split())


@query(f"""WITH d AS (SELECT DISTINCT * FROM (VALUES {_DOMAIN_ROWS}) AS v(domain, category)), p AS (SELECT page_id, {_HOST} AS host FROM pages UNION ALL SELECT -1 - (row_number() OVER (ORDER BY domain, category)), 'www.' || domain FROM d),
  h AS (SELECT page_id, regexp_replace(host, '^(www|m|blog)\\.', '') AS domain FROM p), c AS (SELECT coalesce(category, 'unlisted') AS category, domain, page_id FROM h LEFT JOIN d USING (domain))
  SELECT category, CASE WHEN category = 'unlisted' THEN '' ELSE array_to_string(list_sort(list(DISTINCT domain)), ',') END AS domains, CAST(count(DISTINCT domain) AS INTEGER) AS n, CAST(count(*) AS BIGINT) AS pages FROM c GROUP BY 1""")
def domain_categories(spark, sf_dir):
    """Pages and their hosts by category of the domain list, with a page of each listed domain beside the crawled ones. [SRC14, SET7, AGG27, TOP10]"""
    known = pages.domain_table(spark)
    crawled = table(spark, sf_dir, "pages").select(pages.host(F.col("url")).alias("host")).unionByName(known.select(F.concat(F.lit("www."), "domain").alias("host")))
    hosts = crawled.select(F.regexp_replace("host", r"^(www|m|blog)\.", "").alias("domain"))
    placed = hosts.join(F.broadcast(known), "domain", "left").select("domain", F.coalesce("category", F.lit("unlisted")).alias("category"))
    counts = placed.groupBy("category").agg(F.count_distinct("domain").cast("int").alias("n"), F.count("*").alias("pages"))
    # Only the list's own domains, a bounded number, are put together.
    named = pages.domain_categories(known).select("category", F.array_join("domains", ",").alias("domains"))
    return counts.join(named, "category", "left").select("category", F.coalesce("domains", F.lit("")).alias("domains"), "n", "pages")


@query(f"WITH p AS (SELECT url, {_HOST} AS d FROM pages) SELECT url FROM p WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def frontier_resume(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    return pages.unvisited(rows.select("url"), rows.where("page_id % 3 = 0"))


_CRAWLED = "TIMESTAMP '2024-02-20 12:00:00'"


@query(f"""SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS domains, CAST(count(*) AS BIGINT) AS pages, CAST(floor((epoch({_CRAWLED}) - epoch(max(ts))) / 86400) AS BIGINT) AS age_days,
  floor((epoch({_CRAWLED}) - epoch(max(ts))) / 86400) > 30 AS needs_update FROM events""")
def crawl_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("domain"), F.col("ts").cast("timestamp").alias("crawled_at"))
    return ops.crawl_rollup(rows, F.lit("2024-02-20 12:00:00").cast("timestamp"))


# --- queries and their understanding -------------------------------------------------------------------------------
#: Asked in the inventory's fixtures; joined with the conversations' texts.
_QUESTIONS = [
    "Hur ansöker jag arbetstillståndet?", "Var kan jag hitta sjukhus i Stockholm?", "Vad är öppettiderna idag?", "Kan jag söka stipendium?", "Hur lång är handläggningstiden?",
    "Vilka är kraven för antagning?", "riksdagsledamöter", "apotek", "svt.se", "restauranger malmö", "Vad är skillnaden mellan landsting och region?", "Öppettider systembolaget Stockholm",
    "Senaste nytt om regeringen", "Bästa restaurang Göteborg", "CSN studiebidrag ansökan", "Hur lång är Öresundsbron?", "Västra Götaland kommuner", "Bästa skola detta år",
    "Midsommarafton öppettider", "Lucia celebration Sweden", "hur många bor i lund", "vilka bor här", "en bil", "historia stad sverige", "bilarna", "Ansökan Migrationsverket",
]
_ASK = "WITH a AS (SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}, '{t}')" for i, t in enumerate(_QUESTIONS)) + ") AS v(id, text) UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations), q AS (SELECT CAST(id AS BIGINT) AS id, text, lower(text) AS q FROM a)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(_QUESTIONS)], "id long, text string")
    return own.unionByName(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))


def _last_wins(table_: dict[str, list[str]], test: str, other: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(test.format(p) for p in table_[k])} THEN '{k}'" for k in reversed(table_))
    return f"CASE {cases} ELSE '{other}' END"


_TYPE_SQL = _last_wins(L.QUESTION_TYPES, "starts_with(q, '{0}') OR contains(q, ' {0} ')", "STATEMENT")
_QINTENT_SQL = _last_wins(L.QUESTION_INTENTS, "contains(q, '{0}')", "GENERAL")


@query(f"{_ASK} SELECT id, {_TYPE_SQL} AS question_type, {_QINTENT_SQL} AS intent, {_TYPE_SQL} <> 'STATEMENT' AS is_question FROM q")
def question_classes(spark, sf_dir):
    kind = T.question_type(F.col("text"))
    return _asked(spark, sf_dir).select("id", kind.alias("question_type"), T.question_intent(F.col("text")).alias("intent"), (kind != "STATEMENT").alias("is_question"))


_ANY_PLACE = " OR ".join(f"contains(q, '{p}')" for p in L.INTENT_PLACES)
_PHRASE = lambda ps: "regexp_matches(q, '" + T.whole_word(ps) + "')"


@query(f"""{_ASK} SELECT id, CASE {" ".join(f"WHEN {_PHRASE(ps)} THEN '{k}'" for k, ps in L.INTENT_PHRASES.items())} WHEN {_ANY_PLACE} THEN 'local' ELSE 'information' END AS intent,
  CAST(CASE WHEN {" OR ".join(_PHRASE(ps) for ps in L.INTENT_PHRASES.values())} THEN 0.9 WHEN {_ANY_PLACE} THEN 0.7 WHEN {" OR ".join(f"contains(q, '{p}')" for p in L.INTENT_OFFICIAL)} THEN 0.8 ELSE 0.5 END AS DOUBLE) AS confidence FROM q""")
def query_intent(spark, sf_dir):
    return _asked(spark, sf_dir).select("id", T.detect_intent(F.col("text")).alias("d")).select("id", "d.intent", "d.confidence")


_INTENT_SQL = f"""CASE {" ".join(f"WHEN {_PHRASE(ps)} THEN '{k}'" for k, ps in L.INTENT_PHRASES.items())} WHEN {_ANY_PLACE} THEN 'local' ELSE 'information' END"""
_WORD_RUNS = r"regexp_extract_all(q, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')"
_BOOST_ROWS = ", ".join(f"('{k}', '{n}', CAST({b} AS DOUBLE))" for k, v in L.INTENT_BOOSTS.items() for n, b in v.items())


@query(rf"""{_ASK}, b AS (SELECT * FROM (VALUES {_BOOST_ROWS}) AS v(intent, factor, boost)),
  w AS (SELECT id, {_INTENT_SQL} AS intent, array_to_string(list_filter({_WORD_RUNS}, lambda x: x NOT IN ('hur', 'vad', 'vilken', 'var', 'när', 'ärvid', 'är', 'man')), '') AS t FROM q)
  SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(t, '[?!]', '', 'g'), '(^|[^\p{{L}}\p{{N}}_])skillnaden mellan($|[^\p{{L}}\p{{N}}_])', '\1\2', 'g'), '\s+', ' ', 'g')) AS reformatted, factor, boost
  FROM w JOIN b USING (intent)""")
def intent_boosts(spark, sf_dir):
    found = _asked(spark, sf_dir).select("id", T.intent_query(F.col("text")).alias("reformatted"), T.intent_boosts(T.detect_intent(F.col("text"))["intent"]).alias("b"))
    return found.select("id", "reformatted", F.explode("b").alias("factor", "boost"))


@query(f"""{_ASK}, s AS (SELECT id, trim(regexp_replace(trim(q), '\\?$', '')) AS q FROM q)
  SELECT id, trim(regexp_replace(q, '^(?:{"|".join(L.STARTERS)})', '')) AS reformulated FROM s""")
def question_reformulation(spark, sf_dir):
    return _asked(spark, sf_dir).select("id", T.reformulate_question(F.col("text")).alias("reformulated"))


_REFORMULATED = f"trim(regexp_replace(trim(regexp_replace(trim(q), '\\?$', '')), '^(?:{'|'.join(L.STARTERS)})', ''))"
_BOTH_WAYS = {w: [x for key, others in L.EXPANSIONS.items() for x in (others if key == w else [key] if w in others else [])] for w in dict.fromkeys([*L.EXPANSIONS, *(w for v in L.EXPANSIONS.values() for w in v)])}


def _sql_map(table_: dict[str, list[str]]) -> str:
    return "MAP {" + ", ".join(f"'{k}': [{_sql_list(v)}]" for k, v in table_.items()) + "}"


@query(rf"""{_ASK}, m AS (SELECT {_sql_map(_BOTH_WAYS)} AS m), f AS (SELECT id, {_REFORMULATED} AS reformulated FROM q),
  w AS (SELECT id, reformulated, list_filter(list_transform(regexp_split_to_array(trim(lower(reformulated)), '\s+'), lambda x: regexp_replace(regexp_replace(x, '[.,;:?!]+$', ''), '^[.,;:?!]+', '')), lambda x: x <> '') AS w FROM f)
  SELECT id, reformulated, coalesce(array_to_string(list_filter(string_split(list_reduce(list_prepend('|', w), lambda a, x: a || x || '|' || coalesce(array_to_string(list_transform(
    list_filter(coalesce(m[x], []), lambda y, i: list_position(m[x], y) = i AND NOT contains(a || x || '|', '|' || y || '|')), lambda y: y || '|'), ''), '')), '|'), lambda x: x <> ''), ' '), '') AS expanded FROM w, m""")
def query_expansion(spark, sf_dir):
    return _asked(spark, sf_dir).select("id", T.language_variants(F.col("text")).alias("v")).select("id", "v.reformulated", "v.expanded")


_STARTS = "^(?:" + "|".join(L.VARIANT_STARTERS) + r")\s+"
_CUT = "[" + ", ".join(f"CASE WHEN n = 1 AND length(p[1]) > 4 AND ends_with(p[1], '{x}') AND length(p[1]) > {len(x) + 2} THEN left(p[1], length(p[1]) - {len(x)}) END" for x in L.DEFINITE_SUFFIXES) + "]"
_HINTS = "[" + ", ".join(f"CASE WHEN contains(s, '{h}') AND n > 1 THEN trim(replace(s, '{h}', '')) END" for h in L.COMPOUND_HINTS) + "]"


@query(f"""{_ASK}, z AS (SELECT id, text, trim(q) AS l, trim(regexp_replace(trim(q), '{_STARTS}', '')) AS c, regexp_matches(trim(q), '{_STARTS}') AS hit FROM q),
  b AS (SELECT *, CASE WHEN hit THEN c ELSE l END AS s FROM z), d AS (SELECT *, list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '') AS p FROM b), e AS (SELECT *, len(p) AS n FROM d),
  v AS (SELECT id, list_concat([text], CASE WHEN hit AND c <> '' THEN [c] ELSE [] END, CASE WHEN n > 1 AND p[1] IN ({_sql_list(L.ARTICLES)}) THEN [array_to_string(p[2:], ' ')] ELSE [] END,
    list_filter({_CUT}, lambda x: x IS NOT NULL AND length(x) > 2), list_filter({_HINTS}, lambda x: x IS NOT NULL AND x <> ''),
    CASE WHEN n > 0 THEN [array_to_string(list_transform(p, lambda w: CASE WHEN left(w, 1) = 'ß' THEN 'SS' ELSE upper(left(w, 1)) END || substring(w, 2)), ' ')] ELSE [] END) AS v FROM e),
  u AS (SELECT id, unnest(v) AS variant, generate_subscripts(v, 1) AS pos FROM v), o AS (SELECT id, variant, min(pos) AS pos FROM u GROUP BY 1, 2)
  SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS INTEGER) AS ord, variant FROM o""")
def query_variants(spark, sf_dir):
    return _asked(spark, sf_dir).select("id", F.posexplode(T.query_variants(F.col("text"))).alias("ord", "variant"))


@query(f"{_ASK}, m AS (SELECT {_sql_map(L.SYNONYMS)} AS m), t AS (SELECT id, unnest({_TERMS}) AS t FROM q) SELECT DISTINCT id, term FROM (SELECT id, unnest(list_prepend(t, coalesce(m[t], []))) AS term FROM t, m)")
def synonym_expansion(spark, sf_dir):
    return _asked(spark, sf_dir).select("id", F.explode(T.synonyms(T.terms(F.col("text")))).alias("term"))


#: The most balanced cut of ``rest`` into likely parts, as (left, right); empty where there is none. Positions count from 0, joiners in their order.
_BEST_CUT = f"""list_sort(list_filter(flatten(list_transform(range(3, CAST(length(rest) - 3 AS BIGINT)), lambda k: list_transform([1, 2, 3, 4], lambda j: {{
    'b': -least(k, length(rest) - k - CASE WHEN j < 4 THEN 1 ELSE 0 END), 'k': k, 'j': j, 'l': left(rest, CAST(k AS INTEGER)), 'r': substring(rest, CAST(k + CASE WHEN j < 4 THEN 2 ELSE 1 END AS INTEGER)),
    'ok': j = 4 OR substring(rest, CAST(k + 1 AS INTEGER), 1) = ['s', 'e', 'o', ''][j]}}))),
  lambda c: c.ok AND (length(c.l) >= 4 OR (length(c.l) >= 3 AND c.l IN ({_sql_list(sorted(L.COMPONENTS_V1))}))) AND (length(c.r) >= 4 OR (length(c.r) >= 3 AND c.r IN ({_sql_list(sorted(L.COMPONENTS_V1))})))))"""
_PLANNED = f"""tokens AS (SELECT id, unnest({_TERMS}) AS t, generate_subscripts({_TERMS}, 1) AS p FROM q),
  cut(term, parts, rest) AS (
    SELECT DISTINCT t, CAST([] AS VARCHAR[]), t FROM tokens
    UNION ALL SELECT term, CASE WHEN len(best) > 0 THEN list_append(parts, best[1].l) ELSE list_append(parts, rest) END, CASE WHEN len(best) > 0 THEN best[1].r END
    FROM (SELECT term, parts, rest, CASE WHEN length(rest) >= 8 THEN {_BEST_CUT} ELSE [] END AS best FROM cut WHERE rest IS NOT NULL)),
  compounds AS (SELECT term, parts FROM cut WHERE rest IS NULL), m AS (SELECT {_sql_map(L.SYNONYMS)} AS m),
  stemmed AS (SELECT w, CASE WHEN s IN ('fullt', 'löst') THEN left(x, length(x) - 1) WHEN s <> '' THEN left(x, length(x) - length(s)) ELSE x END AS stem FROM e),
  whole AS (SELECT id, list(stem ORDER BY p) AS stems, flatten(list(parts ORDER BY p)) AS parts, list_sort(list_distinct(flatten(list(list_prepend(t, coalesce(m[t], []))))))  AS syn
    FROM tokens JOIN compounds ON term = t JOIN stemmed ON w = t, m GROUP BY id),
  numbered AS (SELECT id, stems, x, min(k) AS k FROM (SELECT id, stems, unnest(list_concat(stems, parts, syn)) AS x, generate_subscripts(list_concat(stems, parts, syn), 1) AS k FROM whole) GROUP BY ALL),
  planned AS (SELECT id, any_value(stems) AS stems, list(x ORDER BY k) AS terms FROM numbered GROUP BY id),
  capped AS (SELECT id, CASE WHEN len(terms) > {L.TERM_CAP} THEN stems[1:{L.TERM_CAP}] ELSE terms END AS terms FROM planned)
  SELECT id, CAST(generate_subscripts(terms, 1) - 1 AS INTEGER) AS ord, unnest(terms) AS term FROM capped"""


@query(_ASK.replace("WITH a AS", "WITH RECURSIVE asked AS", 1).replace(" FROM a)", " FROM asked)") + ", " + _STEM_SQL[: _STEM_SQL.index("SELECT w AS term")].rstrip().replace("FROM documents)", "FROM q)", 1) + ", " + _PLANNED)
def search_term_planning(spark, sf_dir):
    asked = _asked(spark, sf_dir).select("id", T.terms(F.col("text")).alias("tokens"))
    parts = asked.withColumn("parts", swedish.split_all(F.col("tokens"), "balanced"))
    terms = T.search_terms(F.transform("tokens", T.stem), F.col("parts"), T.synonyms(F.col("tokens")))
    return parts.select("id", F.posexplode(terms).alias("ord", "term"))


_MARKERS_SQL = "MAP {" + ", ".join(f"'{k}': CAST({v} AS DOUBLE)" for k, v in L.MARKERS_V2.items()) + "}"


@query(_ASK.replace("WITH a AS", "WITH RECURSIVE a AS", 1) + f""", tokens AS (SELECT DISTINCT unnest({_TERMS}) AS t FROM q),
  cut(term, parts, rest) AS (
    SELECT t, CAST([] AS VARCHAR[]), t FROM tokens
    UNION ALL SELECT term, CASE WHEN len(best) > 0 THEN list_append(parts, best[1].l) ELSE list_append(parts, rest) END, CASE WHEN len(best) > 0 THEN best[1].r END
    FROM (SELECT term, parts, rest, CASE WHEN length(rest) >= 8 THEN {_BEST_CUT} ELSE [] END AS best FROM cut WHERE rest IS NOT NULL)),
  mk AS (SELECT t, list_sort(list_filter(list_transform(range(4, CAST(length(t) - 2 AS BIGINT)), lambda k: {{'w': -coalesce(({_MARKERS_SQL})[substring(t, CAST(k AS INTEGER), 1)], 0), 'k': k}}), lambda c: c.w < 0)) AS found FROM tokens)
  SELECT term, array_to_string(parts, '+') AS balanced,
    CASE WHEN length(t) >= 6 AND len(found) > 0 AND -found[1].w > 0.5 THEN left(t, CAST(found[1].k - 1 AS INTEGER)) || '+' || substring(t, CAST(found[1].k + 1 AS INTEGER)) ELSE t END AS marked
  FROM cut JOIN mk ON term = t WHERE rest IS NULL""")
def compound_cuts(spark, sf_dir):
    """The two splitters that SQL can express, over all distinct terms asked for. [STR4-STR6, COL2]"""
    terms = _asked(spark, sf_dir).select(F.explode(T.terms(F.col("text"))).alias("term")).distinct()
    for kind in ("balanced", "marked"):
        terms = swedish.split_terms(terms, "term", kind, kind)
    return terms.select("term", *[F.array_join(k, "+").alias(k) for k in ("balanced", "marked")])


@query()
def compound_parts(spark, sf_dir):
    terms = _asked(spark, sf_dir).select(F.explode(T.terms(F.col("text"))).alias("term")).distinct()
    for kind in swedish.SPLITTERS:
        terms = swedish.split_terms(terms, "term", kind, kind)
    return terms.select("term", *[F.array_join(k, "+").alias(k) for k in swedish.SPLITTERS])


@query(r"""SELECT conv_id, turn, CASE WHEN length(trim(text)) BETWEEN 1 AND 500 THEN trim(regexp_replace(regexp_replace(trim(text), '[\x00-\x08\x0B-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g')) END AS clean,
  replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '/', '&#x2F;') AS escaped,
  CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) > 500 THEN 'too long' WHEN regexp_matches(text, '^[\p{L}\p{N}\s.\-_?!]*$') THEN 'ok' ELSE 'characters' END AS valid,
  md5(lower(trim(text))) AS key, sha256(text) AS hash FROM conversations""")
def query_hygiene(spark, sf_dir):
    rows, t = table(spark, sf_dir, "conversations"), F.col("text")
    return rows.select("conv_id", "turn", T.sanitize_query(t).alias("clean"), T.escape_html(t).alias("escaped"), T.valid_query(t).alias("valid"), T.cache_key(t).alias("key"), T.password_hash(t).alias("hash"))


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '(?is)<script[^>]*>.*?</script>', '', 'g')) AS stripped FROM pages""")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("stripped"))


@query(rf"""WITH a AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '{T.TOKEN}')) AS w FROM benchmark)
  SELECT x.item_id AS a, y.item_id AS b, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) AS similarity FROM a x JOIN a y ON y.item_id = x.item_id + 1""")
def word_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.tokenize(F.col("text"))).alias("w"))
    other = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    return rows.join(other, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), _r(T.jaccard(F.col("w"), F.col("v"))).alias("similarity"))


@query(rf"""WITH a AS (SELECT item_id, list_distinct(flatten(list_transform(regexp_extract_all(lower(text), '{T.TOKEN}'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS w FROM benchmark)
  SELECT x.item_id, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) AS similarity FROM a x JOIN a y ON y.item_id = x.item_id + 1""")
def trigram_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", T.trigrams(F.col("text")).alias("w"))
    other = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    return rows.join(other, "item_id").select("item_id", _r(T.jaccard(F.col("w"), F.col("v"))).alias("similarity"))


#: A word that is in many documents and one that is in some, so that the conjunction tells.
_MATCHED = "that the"


@query(f"""WITH {_STEM_SQL.replace("SELECT w AS term, CASE", ", stems AS (SELECT w AS term, CASE") + ")"},
  t AS (SELECT DISTINCT doc_id, stem FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) JOIN stems USING (term))
  SELECT doc_id FROM t WHERE stem IN (SELECT stem FROM stems WHERE term IN ({_sql_list(_MATCHED.split())})) GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT stem) FROM stems WHERE term IN ({_sql_list(_MATCHED.split())}))""")
def full_text_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(T.matches_all(F.lit(_MATCHED), F.col("text"))).select("doc_id")


_NAMED = {"PERSON": ["sson", "sen", "berg", "ström"], "PLACE": ["stad", "borg", "köping", "by"], "ORGANIZATION": ["verket", "myndigheten", "styrelsen"]}
_NAMED_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(w), '{x}')" for x in v) + f" THEN '{k}'" for k, v in _NAMED.items()) + " END"


@query(rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: length(x) > 2 AND regexp_matches(x, '^\p{{Lu}}')) AS ws FROM documents),
  k AS (SELECT unnest(['PERSON', 'PLACE', 'ORGANIZATION', 'TIME']) AS kind)
  SELECT doc_id, kind, md5(array_to_string(list_filter(ws, lambda w: coalesce({_NAMED_SQL}, '') = kind), ' ')) AS words FROM w, k""")
def entities(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.entities(F.col("text"))).alias("kind", "words"))
    return found.select("doc_id", "kind", F.md5(F.array_join("words", " ")).alias("words"))


def _first_hit(values: dict[str, object] | list[str], column: str = "q") -> str:
    return f"list_filter([{_sql_list(list(values))}], lambda v: contains({column}, v))"


def _case(table_: dict[str, object], column: str, other: str = "NULL") -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in table_.items()) + f" ELSE {other} END"


#: Everything known of a query, from ``q``; the columns of ``understanding.with_context``.
_SCOPES = "list_filter([" + ", ".join(f"CASE WHEN contains(q, '{k}') OR contains(q, '{v.lower()}') THEN '{v}' END" for k, v in L.SCOPE_COUNTIES.items()) + "], lambda x: x IS NOT NULL)"
_CONTEXT_SQL = rf"""g AS (SELECT *, {_SCOPES} AS hits, {_first_hit(L.SCOPE_CITIES)}[1] AS city, {_first_hit(L.AGENCIES)} AS agencies, {" OR ".join(f"contains(q, '{w}')" for w in L.OFFICIAL_WORDS)} AS word, {_first_hit(L.FRESHNESS)}[-1] AS fresh FROM q),
  h AS (SELECT *, coalesce({_case(L.SCOPE_CITIES, "city")}, hits[-1]) AS scope, CASE WHEN city IS NOT NULL THEN 2.0 WHEN len(hits) > 0 THEN 1.5 ELSE 1.0 END AS region_boost, word OR len(agencies) > 0 AS official,
    CASE WHEN word THEN 2.0 WHEN len(agencies) > 0 THEN 3.0 ELSE 1.0 END AS official_boost, len(hits) > 0 OR city IS NOT NULL AS placed,
    coalesce({_case({k: b for k, (_, b) in L.FRESHNESS.items()}, "fresh")}, 1.0) AS time_boost, {_case({k: d for k, (d, _) in L.FRESHNESS.items()}, "fresh")} AS max_age_days FROM g),
  i AS (SELECT *, CASE WHEN regexp_matches(q, '(^|[^\p{{L}}\p{{N}}_])hur($|[^\p{{L}}\p{{N}}_].*)(ansöka|göra|får|kan)') OR regexp_matches(q, 'steg för steg|instruktion') THEN 'GUIDE' WHEN official OR regexp_matches(q, '{L.OFFICIAL_PATTERN}') THEN 'OFFICIAL'
    WHEN regexp_matches(q, '{L.NEWS_PATTERN}') THEN 'NEWS' WHEN regexp_matches(q, '{L.DEFINITION_PATTERN}') THEN 'DEFINITION' WHEN regexp_matches(q, '{L.PRACTICAL_PATTERN}') THEN 'PRACTICAL_INFO' WHEN placed THEN 'LOCAL' ELSE 'GENERAL' END AS intent FROM h),
  c AS (SELECT *, CASE intent WHEN 'DEFINITION' THEN 0.85 WHEN 'LOCAL' THEN 0.8 WHEN 'GENERAL' THEN 0.0 ELSE 0.9 END AS confidence, CASE intent WHEN 'NEWS' THEN 3.0 WHEN 'PRACTICAL_INFO' THEN 2.0 ELSE time_boost END AS freshness_boost FROM i)"""


@query(f"""{_ASK}, {_CONTEXT_SQL} SELECT id, scope, CAST(region_boost AS DOUBLE) AS region_boost, official, CAST(official_boost AS DOUBLE) AS official_boost, CAST(freshness_boost AS DOUBLE) AS freshness_boost, CAST(max_age_days AS INTEGER) AS max_age_days, intent,
  CAST(confidence AS DOUBLE) AS confidence, CAST(region_boost * official_boost * freshness_boost AS DOUBLE) AS multiplier, round(CAST(region_boost * official_boost * freshness_boost * {_case(L.INTENT_MULTIPLIERS, "intent")} AS DOUBLE), 6) AS combined,
  CAST(CASE WHEN official THEN 3.0 ELSE 1.0 END * CASE WHEN intent = 'DEFINITION' THEN 1.8 ELSE 1.0 END AS DOUBLE) AS authority_boost, CAST({_case(L.LENGTH_FACTORS, "intent")} AS DOUBLE) AS content_length_factor FROM c""")
def semantic_context(spark, sf_dir):
    known = understanding.with_context(_asked(spark, sf_dir), "text", "c")
    found = known.select("id", "c", understanding.ranking_factors(F.col("c")).alias("f"))
    return found.select(
        "id", "c.scope", "c.region_boost", "c.official", "c.official_boost", "c.freshness_boost", "c.max_age_days", "c.intent", "c.confidence", "c.multiplier", _r(F.col("f.combined")).alias("combined"), "f.authority_boost", "f.content_length_factor",
    )


_COUNTY = "CASE " + " ".join(f"WHEN {{0}} = '{c}' THEN '{k}'" for c, k in L.CITIES.items()) + " " + " ".join(f"WHEN {{0}} = '{c}' THEN '{c}'" for c in L.COUNTIES) + " END"


@query(f"""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'lund' WHEN 1 THEN 'malmö' WHEN 2 THEN 'solna' END AS doc, 'malmö' AS qp, 'stockholm' AS up, CAST(page_id % 90 AS DOUBLE) AS s FROM pages),
  c AS (SELECT *, {_COUNTY.format("doc")} AS dc, {_COUNTY.format("qp")} AS qc, {_COUNTY.format("up")} AS uc FROM p)
  SELECT page_id, round(least(100.0, s * CASE WHEN qp = doc THEN 2.0 WHEN qc = dc THEN 1.5 ELSE 1.0 END * CASE WHEN up = doc THEN 1.3 WHEN uc = dc THEN 1.2 ELSE 1.0 END), 6) AS score, dc AS county FROM c""")
def regional_boost(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr("case page_id % 4 when 0 then 'lund' when 1 then 'malmö' when 2 then 'solna' end").alias("doc"), (F.col("page_id") % 90).cast("double").alias("s"))
    score = understanding.regional_score(F.col("s"), F.col("doc"), F.lit("malmö"), F.lit("stockholm"))
    return rows.select("page_id", _r(score).alias("score"), understanding.county_of(F.col("doc")).alias("county"))


_KNOWN = _sql_list([*L.CITIES, *L.COUNTIES])
_PLACE_PATTERNS = [r"i ([\p{L}\p{N}_\s]+?)(?:\s|$|,|\.)", r"från ([\p{L}\p{N}_\s]+?)(?:\s|$|,|\.)", r"([\p{L}\p{N}_\s]+?) kommun", r"([\p{L}\p{N}_\s]+?) län"]
_QUERY_PLACE = "coalesce(" + ", ".join(f"CASE WHEN trim(regexp_extract(q, '{p}', 1)) IN ({_KNOWN}) THEN trim(regexp_extract(q, '{p}', 1)) END" for p in _PLACE_PATTERNS) + ")"


@query(f"""{_ASK}, c AS (SELECT id, q, {_first_hit(L.CITIES)} AS cities, {_first_hit(L.COUNTIES)} AS counties FROM q)
  SELECT id, {_QUERY_PLACE} AS place, array_to_string(list_concat(cities, list_filter(counties, lambda x: NOT list_contains(cities, x))), ',') AS named FROM c""")
def places(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    return asked.select("id", understanding.query_place(F.col("text")).alias("place"), F.array_join(understanding.places_in(F.col("text")), ",").alias("named"))


def _kinds(values: list[str]) -> str:
    out = "CASE"
    for (_, _, pattern), value in zip(L.ANSWER_KINDS, values, strict=False):
        out += f" WHEN regexp_matches(trim(q), '{pattern}') THEN {value}"
    return f"{out} ELSE {values[-1]} END"


@query(f"""{_ASK} SELECT id, {_kinds([*(f"'{k}'" for k, _, _ in L.ANSWER_KINDS), "'FACT'"])} AS kind, CAST({_kinds([*(str(c) for _, c, _ in L.ANSWER_KINDS), "0.5"])} AS DOUBLE) AS confidence FROM q""")
def answer_kinds(spark, sf_dir):
    return _asked(spark, sf_dir).select("id", answers.classify(F.col("text")).alias("a")).select("id", "a.kind", "a.confidence")


# --- ranking, graph, vectors ---------------------------------------------------------------------------------------
_AS_OF = "2024-02-01 00:00:00"


@query(f"""WITH {_POSTINGS}, {_ASKED_SQL},
  t AS (SELECT query_id, count(*) AS nt, list(term) AS ts FROM q GROUP BY 1),
  c AS (SELECT query_id, doc_id, sum(tf * (ln((n + 1) / (df + 1)) + 1)) AS s FROM q JOIN post USING (term) JOIN terms USING (term), n GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rk FROM c),
  f AS (SELECT query_id, doc_id, least(1.0, s / nt / 10) AS f1, CASE WHEN doc_id % 5 = 0 THEN 0.1 ELSE (doc_id % 7) / 7 END AS f2, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 1.2 / 3.5 END AS f3,
      exp(-(doc_id % 400) / 365) AS f4,
      least(1.0, list_sum(list_transform(ts, lambda w: CASE WHEN contains(lower(left(text, 40)), w) THEN 3 ELSE 0 END + CASE WHEN contains(lower(left(text, 200)), w) THEN 1 ELSE 0 END)) / (nt * 4)) AS f5,
      CASE WHEN doc_id % 6 = 0 THEN 0.3 WHEN doc_id % 60 < 5 THEN (doc_id % 60) / 5 WHEN doc_id % 60 <= 50 THEN 1.0 ELSE 50 / (doc_id % 60) END AS f6,
      least(1.0, 0.5 + CASE WHEN regexp_matches(lower(left(text, 40)), '[åäö]') THEN 0.3 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 0.2 ELSE 0 END) AS f7
    FROM k JOIN docs USING (doc_id) JOIN t USING (query_id) WHERE rk <= 500),
  g AS (SELECT query_id, doc_id, greatest(0.0, least(100.0, f1 * 25 + f2 * 20 + f3 * 15 + f4 * 15 + f5 * 10 + f6 * 10 + f7 * 5)) AS s FROM f),
  r AS (SELECT *, {_RANKED} AS rank FROM g)
  SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(s, 2) AS score FROM r WHERE rank <= 10""")
def seven_factor_rank(spark, sf_dir):
    ix = _unstemmed(spark, sf_dir)
    found = index.search_tfidf(ix, index.query_table(spark, _ASKED), index.candidate_limit(10), cap=None)
    d = F.col("doc_id")
    domain = F.when(d % 2 == 0, "riksdagen.se").otherwise("example.se")
    documents = ix.documents.select(
        d, F.concat(F.lit("https://"), domain).alias("url"), domain.alias("domain"), F.substring("head", 1, 40).alias("title"), F.col("head").alias("snippet"),
        (F.lit(_AS_OF).cast("timestamp") - F.make_dt_interval(days=(d % 400).cast("int"))).alias("crawled_at"), ranking.authority(domain).alias("authority"),
    )
    ranks = ix.documents.where(d % 5 != 0).select(d, (d % 7 / 7).alias("pagerank"))
    out = ix.documents.where(d % 6 != 0).select(d, (d % 60).cast("int").alias("links"))
    asked = spark.createDataFrame(list(_ASKED.items()), "query_id long, terms array<string>")
    return ranking.rank(found, documents, ranks, out, asked, F.lit(_AS_OF).cast("timestamp"), 10).select("query_id", "rank", "doc_id", "score")


_TRADE = """trade AS (SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey % 4 <> c_nationkey % 4)"""


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from a supplier's nation to its customers'. The dimension sides are small next to the line items."""
    read = lambda name: table(spark, sf_dir, name)
    joined = (
        read("lineitem").select("l_orderkey", "l_suppkey").join(read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return joined.where("s_nationkey % 4 <> c_nationkey % 4").select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).distinct()


def _pagerank_sql(turns: int) -> str:
    steps = [_TRADE, "v AS (SELECT n_nationkey AS id FROM nation)", "n AS (SELECT count(*) AS n FROM v)", "deg AS (SELECT src, count(*) AS d FROM trade GROUP BY 1)", "r0 AS (SELECT id, 1.0 / n AS s FROM v, n)"]
    for k in range(turns):
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT v.id, 0.15 / n + 0.85 * coalesce(g, 0) AS s FROM v CROSS JOIN n LEFT JOIN (SELECT dst, sum(s / d) AS g FROM trade JOIN deg USING (src) JOIN r{k} ON id = src GROUP BY 1) ON dst = id)")
    return "WITH " + ",\n".join(steps) + f" SELECT CAST(id AS INTEGER) AS id, round(s / (SELECT max(s) FROM r{turns}), 6) AS score FROM r{turns}"


@query(_pagerank_sql(20))
def pagerank_nations(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    return graph.pagerank(nations, _trade(spark, sf_dir)).select("id", _r(F.col("score")).alias("score"))


@query(f"WITH {_TRADE} SELECT CAST(n_nationkey AS INTEGER) AS id, n_name AS name FROM trade JOIN nation ON src = n_nationkey WHERE dst = (SELECT min(n_nationkey) FROM nation WHERE n_name = 'FRANCE' OR n_nationkey = 6)")
def backlinks(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    target = nations.where("n_name = 'FRANCE' or n_nationkey = 6").agg(F.min("n_nationkey").alias("target"))
    linked = _trade(spark, sf_dir).join(F.broadcast(target), F.col("dst") == F.col("target"))
    return linked.join(nations, F.col("src") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, greatest(0.0, least(1.0, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
  r AS (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s)
  SELECT query_id, vec_id, round(s, 6) AS score FROM r WHERE rank <= 10""")
def vector_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector.search(vectors, asked, 10).select("query_id", "vec_id", _r(F.col("score")).alias("score"))


@query(f"""WITH {_POSTINGS}, {_ASKED_SQL},
  k AS (SELECT query_id, doc_id, sum(tf * (ln((n + 1) / (df + 1)) + 1)) AS s FROM q JOIN post USING (term) JOIN terms USING (term), n GROUP BY 1, 2),
  kr AS (SELECT *, {_RANKED} AS rk FROM k), kt AS (SELECT query_id, doc_id, s, max(s) OVER (PARTITION BY query_id) AS m FROM kr WHERE rk <= 100),
  e AS (SELECT query_id, vec_id AS doc_id, greatest(0.0, least(1.0, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(x.e AS DOUBLE[])))) AS s FROM embeddings v, (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id BETWEEN 1 AND 5) x),
  er AS (SELECT query_id, doc_id, s, {_RANKED} AS rk FROM e)
  SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(0.7 * coalesce(kt.s / m, 0) + 0.3 * coalesce(x.s, 0), 6) AS score FROM kt FULL JOIN (SELECT * FROM er WHERE rk <= 100) x USING (query_id, doc_id)""")
def hybrid_fusion(spark, sf_dir):
    keyword = index.search_tfidf(_unstemmed(spark, sf_dir), index.query_table(spark, _ASKED), 100, cap=None)
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id between 1 and 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = vector.search(vectors, asked, 100).withColumnRenamed("vec_id", "doc_id")
    return vector.fuse(keyword, near).select("query_id", "doc_id", _r(F.col("score")).alias("score"))


@query(f"""{_ASK}, w AS (SELECT id, list_filter(regexp_split_to_array(trim(q), '\\s+'), lambda x: x <> '') AS w FROM q)
  SELECT id, CAST(CASE WHEN len(w) <= 2 THEN 0.6 WHEN len(w) >= 5 THEN 0.2 WHEN len(list_intersect(w[1:2], ['hur', 'vad', 'var', 'när', 'varför', 'vem', 'vilken', 'vilket'])) > 0 THEN 0.45 ELSE 0.3 END AS DOUBLE) AS semantic FROM w""")
def hybrid_weights(spark, sf_dir):
    return _asked(spark, sf_dir).select("id", vector.hybrid_weights(F.col("text"))["semantic"].alias("semantic"))


@query("SELECT doc_id, round(0.5 * quality + 0.5 * (doc_id % 10) / 10, 6) AS authority FROM labels ORDER BY authority DESC, doc_id LIMIT 20")
def top_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", _r(ranking.combined_authority(F.col("quality"), F.col("doc_id") % 10 / 10)).alias("authority"))
    return rows.orderBy(F.desc("authority"), F.asc("doc_id")).limit(20)


# --- events --------------------------------------------------------------------------------------------------------
_JAN = "TIMESTAMP '2024-01-20 00:00:00'"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, CAST(user_id % 3 AS BIGINT) AS status, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def request_counters(spark, sf_dir):
    return ops.counters(_events(spark, sf_dir).withColumn("status", F.col("user_id") % 3), ["event_type", "status"])


@query("SELECT event_type, CAST(b AS DOUBLE) AS le, CAST(count(*) FILTER (value <= b) AS BIGINT) AS n FROM events, (SELECT unnest([" + ", ".join(map(str, L.CRAWL_BUCKETS)) + ", 'inf'::DOUBLE]) AS b) GROUP BY 1, 2")
def latency_histogram(spark, sf_dir):
    return ops.histogram(_events(spark, sf_dir), "value", L.CRAWL_BUCKETS, ["event_type"])


@query("SELECT event_type, CAST(count(value) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def value_summary(spark, sf_dir):
    return ops.summary(_events(spark, sf_dir), "value", ["event_type"]).select("event_type", "n", _r(F.col("total"), 4).alias("total"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def gauges(spark, sf_dir):
    return ops.gauges(_events(spark, sf_dir), "user_id", "value", "ts")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-7, 4) AS mean FROM events")
def running_mean(spark, sf_dir):
    return ops.running_mean(_events(spark, sf_dir), "value", "ts", "event_type").select("event_id", _r(F.col("mean") + 1e-7, 4).alias("mean"))


#: Each entry's filling: the first request of a key, then the first one after the entry before has expired.
_FILLS = """e AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS same FROM events),
  f(user_id, ts) AS (SELECT user_id, min(ts) FROM events GROUP BY 1 UNION ALL
    SELECT user_id, nxt FROM (SELECT f.user_id, (SELECT min(x.ts) FROM events x WHERE x.user_id = f.user_id AND x.ts > f.ts + INTERVAL 24 HOURS) AS nxt FROM f) WHERE nxt IS NOT NULL),
  l AS (SELECT e.*, f.ts IS NULL OR e.same > 1 AS hit FROM e LEFT JOIN f ON f.user_id = e.user_id AND f.ts = e.ts)"""


@query(f"""WITH RECURSIVE {_FILLS},
  s AS (SELECT count(*) FILTER (hit) AS h, count(*) FILTER (NOT hit) AS m, coalesce(sum(value) FILTER (hit), 0) AS s FROM l)
  SELECT CAST(h AS BIGINT) AS hits, CAST(m AS BIGINT) AS misses, round(s, 4) AS saved_ms, round(h / (h + m), 6) AS hit_rate, round(s / h, 6) AS saved_per_hit FROM s""")
def cache_hit_stats(spark, sf_dir):
    found = ops.cache_stats(ops.cache_log(_events(spark, sf_dir), "user_id"), "value")
    return found.select("hits", "misses", _r(F.col("saved_ms"), 4).alias("saved_ms"), _r(F.col("hit_rate")).alias("hit_rate"), _r(F.col("saved_per_hit")).alias("saved_per_hit"))


@query("""SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS in_window, count(*) OVER w > 5 AS over FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)""")
def sliding_rate(spark, sf_dir):
    return ops.sliding_count(_events(spark, sf_dir), "user_id", "ts", 6 * 3600, 5).select("event_id", "in_window", "over")


@query(f"SELECT event_id, event_type FROM events WHERE NOT ts < {_JAN} - INTERVAL 10 DAYS")
def retention_delete(spark, sf_dir):
    return ops.retained(_events(spark, sf_dir), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp"), 10)[0].select("event_id", "event_type")


@query(f"SELECT event_id FROM events WHERE ts > {_JAN} - INTERVAL 24 HOURS AND event_type = 'error'")
def recent_alerts(spark, sf_dir):
    return ops.since(_events(spark, sf_dir).where("event_type = 'error'"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id")


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) SELECT user_id, event_id, CAST(p AS INTEGER) AS place FROM r WHERE p <= 5")
def bounded_history(spark, sf_dir):
    return ops.newest(_events(spark, sf_dir), "user_id", "ts", 5).select("user_id", "event_id", "place")


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events)
  SELECT user_id AS source, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors FROM r WHERE p <= 10 GROUP BY 1""")
def log_errors(spark, sf_dir):
    lines = _events(spark, sf_dir).select("event_id", F.col("user_id").alias("source"), "ts", F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"))
    return ops.recent_errors(lines)


@query("SELECT user_id AS key, max(ts) AS last_access FROM events GROUP BY 1 ORDER BY last_access DESC, key LIMIT 20")
def lru_entries(spark, sf_dir):
    return ops.evict(table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("last_access")), "last_access", 20)


@query("""SELECT event_type, round(coalesce(avg(value) FILTER (user_id % 5 <> 0), 0), 6) AS mean_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, CAST(count(*) AS BIGINT) AS n,
  coalesce(avg(value) FILTER (user_id % 5 <> 0), 0) < 500 AS within_target FROM events GROUP BY 1""")
def performance(spark, sf_dir):
    found = ops.performance(_events(spark, sf_dir), "event_type", "value", F.col("user_id") % 5 != 0)
    return found.select("event_type", _r(F.col("mean_ms")).alias("mean_ms"), _r(F.col("p95_ms")).alias("p95_ms"), "n", "within_target")


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_metrics(spark, sf_dir):
    from quillmere.streaming.windows import tumbling

    found = tumbling(_events(spark, sf_dir), "6 hours")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", _r(F.col("total"), 4).alias("total"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")


def _folded(start: str, step: str, result: str) -> str:
    """SQL of a machine: ``start`` gives the state after a key's first event, ``step`` after each next one (state s, event r), as a struct with the result in it."""
    return f"""WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS at, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    s AS (SELECT r.event_id, r.user_id, r.rn, {start} AS s FROM r WHERE rn = 1 UNION ALL SELECT r.event_id, r.user_id, r.rn, {step} AS s FROM s AS p JOIN r ON r.user_id = p.user_id AND r.rn = p.rn + 1)
    SELECT event_id, CAST(user_id AS VARCHAR) AS "key", {result} AS result FROM s"""


def _rate_sql(most: int, window: int, block: int) -> str:
    kept = f"list_filter(p.s.times, lambda t: t > r.at - {window})"
    shut = f"({block} > 0 AND r.at < p.s.until)"
    return _folded(
        "{'times': [r.at], 'until': 0.0::DOUBLE, 'result': 'allowed'}",
        f"CASE WHEN {shut} THEN {{'times': p.s.times, 'until': p.s.until, 'result': 'refused'}} WHEN len({kept}) >= {most} THEN {{'times': {kept}, 'until': r.at + {block}, 'result': 'refused'}} "
        f"ELSE {{'times': list_append({kept}, r.at), 'until': p.s.until, 'result': 'allowed'}} END",
        "s.result",
    )


@query(_rate_sql(5, 6 * 3600, 0))
def rate_limit(spark, sf_dir):
    return machines.run_batch(_calls(spark, sf_dir), "user_id", machines.rate_limit(5, 6 * 3600.0))


@query(_rate_sql(3, 12 * 3600, 24 * 3600))
def rate_limit_block(spark, sf_dir):
    return machines.run_batch(_calls(spark, sf_dir), "user_id", machines.rate_limit(3, 12 * 3600.0, 24 * 3600.0))


@query(_folded("{'sent': r.at, 'result': 'sent'}", "CASE WHEN r.at - p.s.sent < 86400 THEN {'sent': p.s.sent, 'result': 'held'} ELSE {'sent': r.at, 'result': 'sent'} END", "s.result"))
def alert_cooldown(spark, sf_dir):
    return machines.run_batch(_calls(spark, sf_dir).withColumn("ok", F.lit(False)), "user_id", machines.cooldown(24 * 3600.0))


_HALF = "(p.s.open AND r.at - p.s.since >= 86400)"


@query(_folded(
    "{'open': false, 'n': CASE WHEN r.ok THEN 0 ELSE 1 END, 'since': CASE WHEN r.ok THEN 0.0 ELSE r.at END, 'result': 'closed'}",
    f"""CASE WHEN p.s.open AND NOT {_HALF} THEN {{'open': true, 'n': p.s.n, 'since': p.s.since, 'result': 'refused'}}
      WHEN r.ok AND {_HALF} THEN {{'open': false, 'n': 0, 'since': 0.0::DOUBLE, 'result': 'closed'}} WHEN r.ok THEN {{'open': false, 'n': p.s.n, 'since': p.s.since, 'result': 'closed'}}
      WHEN {_HALF} OR p.s.n + 1 >= 3 THEN {{'open': true, 'n': p.s.n + 1, 'since': r.at, 'result': 'open'}} ELSE {{'open': false, 'n': p.s.n + 1, 'since': r.at, 'result': 'closed'}} END""",
    "s.result",
))
def circuit_breaker(spark, sf_dir):
    return machines.run_batch(_calls(spark, sf_dir), "user_id", machines.circuit_breaker(3, 24 * 3600.0))


_GOOD, _BAD = "(CASE WHEN r.ok THEN p.s.good + 1 ELSE 0 END)", "(CASE WHEN r.ok THEN 0 ELSE p.s.bad + 1 END)"


@query(_folded(
    "{'t': 30, 'good': CASE WHEN r.ok THEN 1 ELSE 0 END, 'bad': CASE WHEN r.ok THEN 0 ELSE 1 END}",
    f"""{{'t': CASE WHEN {_GOOD} >= 5 THEN greatest(10, p.s.t - 2) WHEN {_BAD} >= 2 THEN least(60, p.s.t + 5) ELSE p.s.t END,
      'good': CASE WHEN {_GOOD} >= 5 THEN 0 ELSE {_GOOD} END, 'bad': CASE WHEN {_BAD} >= 2 THEN 0 ELSE {_BAD} END}}""",
    "CAST(s.t AS VARCHAR)",
))
def adaptive_timeout(spark, sf_dir):
    return machines.run_batch(_calls(spark, sf_dir), "user_id", machines.adaptive_timeout())


# --- portal --------------------------------------------------------------------------------------------------------
@query("""WITH h AS (SELECT conv_id AS query_id, CAST(turn AS INTEGER) AS variant, 1 AS rank, role AS title FROM conversations WHERE conv_id % 5 <> 0
    UNION ALL SELECT DISTINCT conv_id, 0, 1, 'fallback' FROM conversations WHERE conv_id % 5 = 0),
  f AS (SELECT query_id, title, min(variant) AS v FROM h GROUP BY 1, 2),
  p AS (SELECT query_id, title, row_number() OVER (PARTITION BY query_id ORDER BY v, title) AS place FROM f)
  SELECT query_id, CAST(place AS INTEGER) AS place, title FROM p WHERE place <= 2""")
def variant_union(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    hits = rows.where("conv_id % 5 <> 0").select(F.col("conv_id").alias("query_id"), F.col("turn").cast("int").alias("variant"), F.lit(1).alias("rank"), F.col("role").alias("title"))
    spare = rows.select(F.col("conv_id").alias("query_id"), F.lit(0).alias("variant"), F.lit(1).alias("rank"), F.lit("fallback").alias("title")).distinct()
    return portal.union_until(hits, spare, 2)


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_rows(spark, sf_dir):
    return portal.latest(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id")


@query("SELECT event_id, strftime(ts, '[%H:%M:%S] ') || upper(event_type) || ': value ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS line FROM events")
def log_lines(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return rows.select("event_id", portal.log_line(F.col("ts"), F.upper("event_type"), F.concat(F.lit("value "), F.floor("value").cast("string"))).alias("line"))


@query("SELECT conv_id, turn, CAST(octet_length(encode(text)) AS BIGINT) AS length, CAST(1 AS BIGINT) AS version, text AS payload FROM conversations")
def packet_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    packet = portal.decode_packet(portal.encode_packet(F.lit(2), F.lit(0), F.encode("text", "UTF-8")))
    return rows.select("conv_id", "turn", packet.alias("p")).select("conv_id", "turn", "p.length", "p.version", F.decode("p.payload", "UTF-8").alias("payload"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_properties(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
