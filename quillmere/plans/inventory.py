"""Registered queries for sources, sinks and operators that ``queries.py`` does not reach, each with its SQL twin.

What a query writes, it reads again from the shared folder; its twin states what should be there from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.functions import lexicon as L
from quillmere.functions import text as T
from quillmere.operators import answers, graph, index, ops, pages, portal, ranking, understanding
from quillmere.plans.queries import (
    _ASK, _CONTEXT_SQL, _COUNTY, _HOST, _MATCHED, _POSTINGS, _QUERY_PLACE, _REFORMULATED, _SKIP, _STEM_SQL, _TERMS, _asked, _calls, _case, _events, _first_hit, _kinds, _r, _sql_list, _sql_map, _unstemmed, query, table,
)
from quillmere.shared import durable, local_table, remove_path, scratch_path
from quillmere.sources import files
from quillmere.streaming import machines, windows


def _kept(spark, path: str, df: DataFrame) -> DataFrame:
    """``df``, read whole before the folder it comes from is deleted."""
    found = durable(df)
    remove_path(spark, path)
    return found


def _ended(stream, seconds: int = 900) -> None:
    """Waits for a stream over what is there; one that does not end is stopped and is an error."""
    if not stream.awaitTermination(seconds):
        stream.stop()
        raise TimeoutError(f"a stream did not end within {seconds} seconds")


#: Folders that the files of one host or role are dealt over, so that none holds nearly all.
_SHARES = 64


# --- sources and sinks --------------------------------------------------------------------------------------------
@query(f"""SELECT url, {_HOST} AS domain, 'new' AS title, md5(html) AS content FROM pages UNION ALL SELECT 'http://only.old/' || page_id, 'only.old', 'old', md5(html) FROM pages WHERE page_id < 5""")
def page_files(spark, sf_dir):
    """Pages written as one JSON file each, read, and written by domain with the newest row of each URL. [SRC1, SNK1, COL6]"""
    path = scratch_path(spark, "pages")
    rows = table(spark, sf_dir, "pages")
    own = lambda df, url, title, at: df.select(url.alias("url"), F.lit(title).alias("title"), F.md5("html").alias("content"), F.lit(at).alias("crawled_at"))
    old_only = rows.where("page_id < 5")
    both = own(rows, F.col("url"), "old", "2024-01-01").unionByName(own(rows, F.col("url"), "new", "2024-02-01")).unionByName(own(old_only, F.concat(F.lit("http://only.old/"), F.col("page_id")), "old", "2024-01-01"))
    unread = rows.where("page_id = 0").select("url", F.lit("none").alias("title"), F.lit(None).cast("string").alias("content"), F.lit("2025-01-01").alias("crawled_at"))
    files.write_singly(both.unionByName(unread).withColumn("domain", pages.host(F.col("url"))).withColumn("_folder", F.concat_ws("-", F.pmod(F.xxhash64("domain"), F.lit(8)), F.pmod(F.xxhash64("url"), F.lit(_SHARES)))), f"{path}/json")
    files.write_pages(files.read_pages(spark, f"{path}/json"), f"{path}/parquet")
    return _kept(spark, path, spark.read.parquet(f"{path}/parquet").select("url", "domain", "title", "content"))


@query(r"""SELECT page_id, md5(regexp_extract(html, '(?is)<meta[^>]*name=["'']description["''][^>]*content=["'']([^"'']*)', 1)) AS description, regexp_extract(html, '(?is)<meta[^>]*name=["'']keywords["''][^>]*content=["'']([^"'']*)', 1) AS keywords,
  'd' || page_id AS made FROM pages""")
def page_meta(spark, sf_dir):
    """[PRJ2]"""
    html = F.col("html")
    made = F.concat(F.lit('<meta content="d'), F.col("page_id"), F.lit('" name="description">'))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(pages.meta(html, "description")).alias("description"), pages.meta(html, "keywords").alias("keywords"), pages.meta(made, "description").alias("made"))


@query(f"WITH {_POSTINGS}, one AS (SELECT max(doc_id) AS m FROM docs) SELECT doc_id, md5(text) AS content FROM docs, one WHERE doc_id = m")
def index_lookup(spark, sf_dir):
    """[SRC3, SRC4]"""
    ix = _unstemmed(spark, sf_dir)
    return ix.document(ix.documents.agg(F.max("doc_id")).first()[0]).select("doc_id", F.md5("text").alias("content"))


@query(f"""WITH {_POSTINGS} SELECT CAST((SELECT count(*) FROM docs WHERE doc_id % 3 <> 0) AS BIGINT) AS num_documents, CAST((SELECT count(*) FROM terms) AS BIGINT) AS num_terms, CAST((SELECT count(*) FROM post) AS BIGINT) AS index_entries,
  CAST((SELECT count(*) FROM pages) AS BIGINT) AS page_links""")
def index_counts(spark, sf_dir):
    """[AGG11, FLT6]"""
    ix = _unstemmed(spark, sf_dir)
    documents = ix.documents.withColumn("status", F.when(F.col("doc_id") % 3 != 0, "active").otherwise("gone"))
    return index.Index(documents, ix.postings, ix.terms, ix.n, ix.average).counts(table(spark, sf_dir, "pages"))


@query("SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(len(embedding) AS INTEGER) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(list_sum(embedding) AS DOUBLE), 4) AS total FROM embeddings")
def embedding_files(spark, sf_dir):
    """[SNK5]"""
    path = scratch_path(spark, "embeddings")
    files.write_embeddings(table(spark, sf_dir, "embeddings"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return _kept(spark, path, spark.read.parquet(path).select("vec_id", F.size("embedding").alias("dims"), _r(F.col("embedding")[0].cast("double")).alias("first"), _r(total, 4).alias("total")))


_CACHED = "SELECT text AS query, turn % 3 + 1 AS lim, conv_id * 100 + turn AS created_at FROM conversations"


@query(f"""WITH c AS ({_CACHED}) SELECT md5(lower(trim(query))) || '-' || lim AS key, CAST(count(*) AS BIGINT) AS n, CAST(max(created_at) AS BIGINT) AS created_at FROM (SELECT * FROM c UNION ALL SELECT query, lim, created_at + 1 FROM c) GROUP BY 1""")
def cache_files(spark, sf_dir):
    """[SNK6]"""
    path, rows = scratch_path(spark, "cache"), _cached(spark, sf_dir)
    files.append_cache(rows, path)
    files.append_cache(rows.withColumn("created_at", F.col("created_at") + 1), path)
    return _kept(spark, path, spark.read.parquet(path).groupBy("key").agg(F.count("*").alias("n"), F.max("created_at").alias("created_at")))


def _cached(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("text").alias("query"), (F.col("turn") % 3 + 1).alias("limit"), (F.col("conv_id") * 100 + F.col("turn")).alias("created_at"))


@query(f"SELECT query, CAST(max(created_at) AS BIGINT) AS created_at FROM ({_CACHED}) GROUP BY 1 ORDER BY created_at DESC, query LIMIT 100")
def popular_queries(spark, sf_dir):
    """[TOP7]"""
    return files.popular_queries(_cached(spark, sf_dir))


@query("SELECT 'requests_total{status=\"' || user_id % 3 || '\",type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type, user_id % 3")
def metric_lines(spark, sf_dir):
    """[SNK7]"""
    counts = ops.counters(_events(spark, sf_dir).withColumn("status", F.col("user_id") % 3), ["event_type", "status"])
    labels = F.create_map(F.lit("type"), F.col("event_type"), F.lit("status"), F.col("status").cast("string"))
    return ops.exposition(counts.select(F.lit("requests_total").alias("name"), labels.alias("labels"), F.col("n").alias("value")))


_SEVERITY = "CASE user_id % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'Error' ELSE 'critical' END"


@query(f"""SELECT event_id, '{{"attachments":[{{"color":"' || {_case(L.ALERT_COLOURS, f"lower({_SEVERITY})")} || '","title":"' || event_type || '","text":"user ' || user_id || '","ts":' || CAST(floor(epoch(ts)) AS BIGINT) || '}}]}}' AS payload FROM events""")
def alert_payloads(spark, sf_dir):
    """[SNK8, PRJ15]"""
    alerts = _events(spark, sf_dir).select("event_id", F.expr(_SEVERITY).alias("severity"), F.col("event_type").alias("title"), F.concat(F.lit("user "), F.col("user_id")).alias("message"), "ts")
    return ops.alert_payload(alerts).select("event_id", "payload")


@query("SELECT 'v=20240201_000000' AS version, n_nationkey AS id, n_name || ' new' AS name FROM nation")
def index_versions(spark, sf_dir):
    """[SNK9]"""
    path, nations = scratch_path(spark, "versions"), table(spark, sf_dir, "nation")
    for stamp, mark in (("20240201_000000", " new"), ("20240101_000000", " old")):
        files.backup(spark, {"nations": nations.select(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(mark)).alias("name"))}, path, stamp)
    newest = files.versions(spark, path)[-1]
    return _kept(spark, path, files.restore(spark, path, "nations").select(F.lit(newest).alias("version"), "id", "name"))


_LINE = """CASE user_id % 4 WHEN 0 THEN 'Crawled: http://a.se/' || event_id WHEN 1 THEN 'svt' || user_id || '.se: completed ' || event_id || ' pages' WHEN 2 THEN 'ERROR: no answer ' || event_id ELSE 'started' END"""


@query(f"""SELECT {_LINE} AS line, CASE user_id % 4 WHEN 0 THEN 'page' WHEN 1 THEN 'domain' WHEN 2 THEN 'error' ELSE 'other' END AS kind,
  CASE user_id % 4 WHEN 0 THEN 'http://a.se/' || event_id WHEN 1 THEN 'svt' || user_id || '.se' WHEN 2 THEN 'no answer ' || event_id END AS subject, CASE user_id % 4 WHEN 1 THEN CAST(event_id AS INTEGER) END AS number FROM events""")
def crawl_log(spark, sf_dir):
    """Log lines written as text and read again. [SRC15]"""
    path = scratch_path(spark, "log")
    table(spark, sf_dir, "events").select(F.expr(_LINE).alias("value")).write.text(path)
    return _kept(spark, path, files.read_log_lines(spark, path))


def _raw_feed(spark, sf_dir) -> DataFrame:
    """Answers of a feed: ten documents nested in each."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    title = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("Titel "), F.col("doc_id")))
    record = F.struct(
        F.col("doc_id").alias("id"), title.alias("titel"), F.concat(F.lit("Under "), F.col("doc_id")).alias("undertitel"), F.concat(F.lit("https://data.se/"), F.col("doc_id")).alias("dokument_url_html"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")), "yyyy-MM-dd").alias("datum"),
    )
    grouped = docs.groupBy(F.floor(F.col("doc_id") / 10).alias("page")).agg(F.collect_list(record).alias("dokument"))
    return grouped.select(F.struct("dokument").alias("dokumentlista"))


_FEED = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Under ' ELSE 'Titel ' END || doc_id AS title, 'https://data.se/' || doc_id AS url, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (doc_id % 60) AS last_modified FROM documents WHERE text IS NOT NULL"""


@query(_FEED)
def feed_documents(spark, sf_dir):
    """[SRC8, SRC9, COL4, COL5]"""
    return portal.feed_documents(_raw_feed(spark, sf_dir)).withColumn("last_modified", F.col("last_modified").cast("timestamp_ntz"))


@query(f"SELECT * FROM ({_FEED} UNION ALL SELECT 1000000 + page_id, 'Page', url, TIMESTAMP '2024-02-01' + INTERVAL 1 HOUR * page_id FROM pages) ORDER BY last_modified DESC, doc_id LIMIT 200")
def merged_feeds(spark, sf_dir):
    """[SET3, TOP6]"""
    own = table(spark, sf_dir, "pages").select((F.col("page_id") + 1_000_000).alias("doc_id"), F.lit("Page").alias("title"), "url", (F.lit("2024-02-01").cast("timestamp") + F.make_dt_interval(hours=F.col("page_id").cast("int"))).alias("last_modified"))
    return portal.merge_feeds([portal.feed_documents(_raw_feed(spark, sf_dir)), own], 200).withColumn("last_modified", F.col("last_modified").cast("timestamp_ntz"))


@query(_FEED)
def polled_feed(spark, sf_dir):
    """A stream over a folder of feed files in which every document lies twice: each is handed on once, also after a restart. [STM1, STM7, FLT20]"""
    path = scratch_path(spark, "feed")
    found = portal.feed_documents(_raw_feed(spark, sf_dir)).withColumn("last_modified", F.col("last_modified").cast("string"))
    schema = "doc_id long, title string, url string, last_modified string"
    for _ in range(2):
        found.write.mode("append").json(f"{path}/in")
        _ended(windows.poll_feed(spark, f"{path}/in", schema, lambda rows, _: rows.write.mode("append").parquet(f"{path}/out"), f"{path}/state", every=None, moment="last_modified", within="3650 days"))
    return _kept(spark, path, spark.read.parquet(f"{path}/out").withColumn("last_modified", F.col("last_modified").cast("timestamp_ntz")))


@query("SELECT event_id, strftime(ts - INTERVAL 7 DAYS, '%Y-%m-%d') AS \"from\", strftime(ts, '%Y-%m-%d') AS \"to\" FROM events")
def feed_dates(spark, sf_dir):
    """[DT5]"""
    return _events(spark, sf_dir).select("event_id", portal.date_range(F.col("ts")).alias("r")).select("event_id", "r.from", "r.to")


# --- accounts and services ----------------------------------------------------------------------------------------
_APPS = ["mail", "map", "news", "shop"]


def _accounts(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    apps = F.array(*[F.when(k % 2 == 0, "news").otherwise("map"), F.when(k % 3 == 0, "gone").otherwise("mail"), F.lit("shop")])
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("username"), T.password_hash(F.col("c_name")).alias("password_hash"), F.when(k % 7 == 0, "admin").otherwise("user").alias("role"),
        F.when(k % 5 == 0, "closed").otherwise("active").alias("status"), apps.alias("available_apps"), F.col("c_mktsegment").alias("full_name"),
    )


_APPS_SQL = "[CASE WHEN c_custkey % 2 = 0 THEN 'news' ELSE 'map' END, CASE WHEN c_custkey % 3 = 0 THEN 'gone' ELSE 'mail' END, 'shop']"


@query(f"SELECT c_name AS username, CASE WHEN c_custkey % 7 = 0 THEN 'admin' ELSE 'user' END AS role, CASE WHEN c_custkey % 5 = 0 THEN 'closed' ELSE 'active' END AS status, array_to_string(list_filter({_APPS_SQL}, lambda x: x <> 'shop'), ',') AS apps, c_mktsegment AS full_name FROM customer")
def public_accounts(spark, sf_dir):
    """[PRJ10, COL3]"""
    rows = portal.remove_app(portal.sanitized(_accounts(spark, sf_dir)), "shop")
    assert "password_hash" not in rows.columns
    return rows.select("username", "role", "status", F.array_join("available_apps", ",").alias("apps"), "full_name")


@query("SELECT c_name AS username, c_mktsegment AS full_name FROM customer WHERE c_custkey IN (1, 8)")
def logins(spark, sf_dir):
    """Of an open account with the right password, a closed one, and open ones with a wrong and the right password, who gets in. [FLT16, FLT6, STR35]"""
    rows = _accounts(spark, sf_dir)
    tried = [(1, 1), (5, 5), (6, 7), (8, 8)]
    name = "Customer#{:09d}".format
    found = [portal.login(rows, name(user), name(word)) for user, word in tried]
    union = found[0]
    for other in found[1:]:
        union = union.unionByName(other)
    return union.select("username", "full_name")


@query(f"SELECT c_name AS username, array_to_string(list_transform(list_filter({_APPS_SQL}, lambda x: x <> 'gone'), lambda x: upper(x)), ',') AS apps FROM customer")
def account_apps(spark, sf_dir):
    """[JN16, FLT17]"""
    registry = local_table(spark, {"app_id": [*reversed(_APPS), "spare"], "app_name": [*(x.upper() for x in reversed(_APPS)), "SPARE"]}, "app_id string, app_name string")
    rows = _accounts(spark, sf_dir)
    known = rows.withColumn("available_apps", portal.known_apps(F.col("available_apps"), _APPS))
    return portal.apps_of(known, registry).select("username", F.array_join(F.transform("apps", lambda a: a["app_name"]), ",").alias("apps"))


@query("SELECT c_name AS username, CASE WHEN c_custkey % 7 = 0 THEN 'admin' ELSE 'user' END AS role, 'Åsa ' || c_mktsegment AS full_name, c_custkey % 4 = 0 AS later FROM customer")
def account_files(spark, sf_dir):
    """Accounts as one JSON file each by role; of a name in two files the one whose path comes last counts. [SRC12, COL6]"""
    path = scratch_path(spark, "accounts")
    rows = _accounts(spark, sf_dir).withColumn("k", F.substring("username", 10, 9).cast("long")).withColumn("full_name", F.concat(F.lit("Åsa "), F.col("full_name")))
    one = lambda df, folder, mark: files.write_singly(df.withColumn("email", F.lit(mark)).withColumn("_folder", F.concat(F.lit(folder), F.col("role"), F.lit("-"), F.pmod(F.xxhash64("username"), F.lit(_SHARES)))), path, "append")
    one(rows, "a-", "first")
    one(rows.where("k % 4 = 0"), "b-", "later")
    return _kept(spark, path, files.read_accounts(spark, path).select("username", "role", "full_name", (F.col("email") == "later").alias("later")))


_NOW = "2024-02-01 00:00:00"


@query(f"SELECT event_id, CAST(floor(epoch(TIMESTAMP '{_NOW}')) - floor(epoch(ts)) AS BIGINT) AS uptime_s, CAST(floor((floor(epoch(TIMESTAMP '{_NOW}')) - floor(epoch(ts))) / 3600) AS BIGINT) || 'h ' || CAST(floor((floor(epoch(TIMESTAMP '{_NOW}')) - floor(epoch(ts))) % 3600 / 60) AS BIGINT) || 'm' AS uptime FROM events")
def service_uptime(spark, sf_dir):
    """[PRJ12, DT6]"""
    return portal.service_status(_events(spark, sf_dir).select("event_id", F.col("ts").alias("started")), F.lit(_NOW).cast("timestamp")).select("event_id", "uptime_s", "uptime")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def order_page(spark, sf_dir):
    """[FLT19]"""
    skipped, limit = portal.page_offset("3", 25)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").offset(skipped).limit(limit)


# --- pages and URLs -----------------------------------------------------------------------------------------------
_RULES = "SELECT 'http://' || h AS origin, p AS prefix, a AS allow FROM (SELECT DISTINCT regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) AS h FROM pages), (VALUES ('/', true), ('/en/', false), ('/en/1', true)) AS v(p, a)"


@query(f"""WITH r AS ({_RULES}), u AS (SELECT url, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) AS origin, coalesce(nullif(regexp_replace(url, '^[a-zA-Z]+://[^/?#]+', ''), ''), '/') AS path FROM pages),
  h AS (SELECT url, allow, length(prefix) AS n FROM u LEFT JOIN r ON r.origin = u.origin AND starts_with(path, prefix)) SELECT url, coalesce(arg_max(allow, n), true) AS allowed FROM h GROUP BY 1""")
def robots(spark, sf_dir):
    """[FLT3]"""
    rows = table(spark, sf_dir, "pages")
    hosts = rows.select(F.concat(F.lit("http://"), pages.host(F.col("url"))).alias("origin")).distinct()
    rules = hosts.join(F.broadcast(local_table(spark, {"prefix": ["/", "/en/", "/en/1"], "allow": [True, False, True]}, "prefix string, allow boolean")))
    return pages.robots_allowed(rows.select("url"), rules)


@query(rf"""SELECT page_id, regexp_matches({_HOST}, '{L.VALID_DOMAIN}') AS domain, regexp_matches(CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'ftp://' || url ELSE url || ' x' END, '^(http|https)://[^\s/?#]+[^\s]*$') AS url,
  regexp_matches(replace({_HOST}, '.', '..'), '{L.VALID_DOMAIN}') AS doubled FROM pages""")
def url_formats(spark, sf_dir):
    """[FLT18]"""
    url, k = F.col("url"), F.col("page_id") % 3
    changed = F.when(k == 0, url).when(k == 1, F.concat(F.lit("ftp://"), url)).otherwise(F.concat(url, F.lit(" x")))
    return table(spark, sf_dir, "pages").select("page_id", pages.valid_domain(pages.host(url)).alias("domain"), pages.valid_url(changed).alias("url"), pages.valid_domain(F.replace(pages.host(url), F.lit("."), F.lit(".."))).alias("doubled"))


_LINKED = """l AS (SELECT page_id AS doc_id, url, [url, 'http://nowhere.se/', (SELECT min(url) FROM pages)] AS links FROM pages), n AS (SELECT count(*) AS n FROM pages),
  x AS (SELECT DISTINCT o.doc_id AS src, p.page_id AS dst FROM (SELECT doc_id, unnest(links) AS url FROM l) o JOIN pages p USING (url))"""


@query(f"WITH {_LINKED} SELECT src, dst FROM x")
def page_links(spark, sf_dir):
    """[SRC2, JN5]"""
    return graph.resolve_links(_linked(spark, sf_dir))


def _linked(spark, sf_dir) -> DataFrame:
    """Pages that link to themselves, to no known page, and all to one."""
    rows = table(spark, sf_dir, "pages")
    hub = F.broadcast(rows.agg(F.min("url").alias("hub")))
    return rows.crossJoin(hub).select(F.col("page_id").alias("doc_id"), "url", F.array("url", F.lit("http://nowhere.se/"), "hub").alias("links"))


@query(f"WITH {_LINKED}, h AS (SELECT page_id AS hub FROM pages WHERE url = (SELECT min(url) FROM pages)) SELECT page_id AS id, url, CAST(page_id % 10 AS DOUBLE) AS score FROM x JOIN h ON dst = hub JOIN pages ON page_id = src")
def hub_backlinks(spark, sf_dir):
    """[JN11]"""
    linked = _linked(spark, sf_dir)
    target = linked.orderBy("url").first()["doc_id"]
    ranked = linked.select(F.col("doc_id").alias("id"), "url", (F.col("doc_id") % 10).cast("double").alias("score"))
    return graph.backlinks(graph.resolve_links(linked), ranked, target).select("id", "url", "score")


# --- text and queries ---------------------------------------------------------------------------------------------
@query(f"WITH t AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) SELECT item_id, term, CAST(count(*) AS INTEGER) AS n FROM t GROUP BY 1, 2")
def item_frequencies(spark, sf_dir):
    """[AGG13]"""
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.term_frequencies(T.terms(F.col("text")))).alias("term", "n"))


@query(r"""WITH s AS (SELECT doc_id, text AS t FROM documents UNION ALL SELECT -1, '!?') SELECT doc_id, CASE WHEN regexp_replace(regexp_replace(lower(trim(t)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') = '' THEN left(md5(t), 8)
  ELSE regexp_replace(regexp_replace(lower(trim(t)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS slug FROM s""")
def slugs(spark, sf_dir):
    """[STR32]"""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t")).unionByName(local_table(spark, {"doc_id": [-1], "t": ["!?"]}, "doc_id long, t string"))
    return rows.select("doc_id", T.slugify(F.col("t")).alias("slug"))


_PREFIXES = sorted({s[:n] for s in L.SUGGESTIONS for n in range(1, 7)} | {"SV", "x", "xx", ""})


@query(f"""WITH p AS (SELECT unnest([{_sql_list(_PREFIXES)}]) AS prefix UNION SELECT left(text, 2) FROM conversations)
  SELECT prefix, CASE WHEN length(prefix) >= 2 THEN array_to_string(list_filter([{_sql_list(L.SUGGESTIONS)}], lambda s: starts_with(lower(s), lower(prefix)))[1:5], ',') ELSE '' END AS found FROM p""")
def suggestions(spark, sf_dir):
    """[FLT9]"""
    asked = local_table(spark, {"prefix": _PREFIXES}, "prefix string").union(table(spark, sf_dir, "conversations").select(F.substring("text", 1, 2))).distinct()
    return asked.select("prefix", F.array_join(T.suggest(F.col("prefix")), ",").alias("found"))


@query(rf"""{_ASK}, r AS (SELECT id, {_REFORMULATED} AS reformulated FROM q), t AS (SELECT id, reformulated, regexp_extract_all(reformulated, '{T.TOKEN}') AS tokens FROM r)
  SELECT id, reformulated, CAST(len(tokens) AS INTEGER) AS n_tokens, array_to_string(list_filter(tokens, lambda x: regexp_matches(x, '^\p{{L}}+$') AND length(x) > 2 AND x NOT IN ({_sql_list(L.STOPWORDS)})), ' ') AS filtered FROM t""")
def alternate_query(spark, sf_dir):
    """The other way of preparing a query, without its compounds. [STR12]"""
    found = _asked(spark, sf_dir).select("id", T.alternate_terms(F.col("text")).alias("a"))
    return found.select("id", "a.reformulated", F.size("a.tokens").alias("n_tokens"), F.array_join("a.filtered", " ").alias("filtered"))


_SYNONYM_UNION = f"list_sort(list_distinct(list_concat(stems, flatten(list_transform(t, lambda x: list_prepend(x, coalesce(m[x], [])))))))"


@query(f"""WITH s AS ({"WITH " + _STEM_SQL.replace("FROM documents)", "FROM (SELECT text FROM conversations UNION ALL SELECT text FROM (" + _ASK + " SELECT text FROM q)))")}),
  t AS ({_ASK} SELECT id, {_TERMS} AS t FROM q), u AS (SELECT id, unnest(t) AS term FROM t), g AS (SELECT id, list(stem) AS stems FROM u JOIN s USING (term) GROUP BY 1), m AS (SELECT {_sql_map(L.SYNONYMS)} AS m)
  SELECT id, array_to_string({_SYNONYM_UNION}, ' ') AS terms FROM t LEFT JOIN g USING (id), m WHERE len(t) > 0""")
def semantic_terms(spark, sf_dir):
    """Stems, and words with their synonyms, of a query; compounds are left out. [SEM7, SET4]"""
    tokens = T.terms(F.col("text"))
    rows = _asked(spark, sf_dir).select("id", tokens.alias("t")).where(F.size("t") > 0)
    found = understanding.semantic_terms(F.transform("t", T.stem), F.array().cast("array<string>"), T.synonyms(F.col("t")))
    return rows.select("id", F.array_join(found, " ").alias("terms"))


_PRACTICAL = [(["öppet"], L.REFORMULATED_HOURS), (["adress", "lokalisering"], L.REFORMULATED_ADDRESS), (["telefon", "nummer"], L.REFORMULATED_PHONE)]
_PRACTICAL_SQL = "list_concat(" + ", ".join(f"CASE WHEN {' OR '.join(f"contains(q, '{w}')" for w in ws)} THEN [{_sql_list(v)}] ELSE [] END" for ws, v in _PRACTICAL) + ")"


@query(rf"""{_ASK}, i AS (SELECT unnest(['GUIDE', 'DEFINITION', 'PRACTICAL_INFO', 'NEWS']) AS intent)
  SELECT id, intent, array_to_string(CASE intent WHEN 'GUIDE' THEN [trim(replace(replace(q, 'steg för steg', ''), 'instruktion', ''))]
    WHEN 'DEFINITION' THEN CASE WHEN regexp_matches(q, '{L.PAIR_PATTERN}') THEN [trim(regexp_extract(q, '{L.PAIR_PATTERN}', 1)), trim(regexp_extract(q, '{L.PAIR_PATTERN}', 2))] ELSE [] END WHEN 'PRACTICAL_INFO' THEN {_PRACTICAL_SQL} ELSE [] END, '|') AS found FROM q, i""")
def reformulations(spark, sf_dir):
    """[STR33]"""
    rows = _asked(spark, sf_dir).withColumn("intent", F.explode(T.words(["GUIDE", "DEFINITION", "PRACTICAL_INFO", "NEWS"])))
    return rows.select("id", "intent", F.array_join(understanding.reformulations(F.col("text"), F.col("intent")), "|").alias("found"))


_PREFERENCES = ", ".join(f"('{k}', '{a}', '{b}', CAST({c} AS DOUBLE), CAST({d} AS DOUBLE))" for k, (a, b, c, d) in L.ANSWER_PREFERENCES.items())


@query(f"""{_ASK}, {_CONTEXT_SQL}, p AS (SELECT * FROM (VALUES {_PREFERENCES}) AS v(intent, content_length, source, freshness_weight, authority_weight))
  SELECT id, c.intent, content_length, source, freshness_weight, authority_weight FROM c LEFT JOIN p USING (intent)""")
def answer_preferences(spark, sf_dir):
    """[SEM8]"""
    known = understanding.with_context(_asked(spark, sf_dir), "text", "c")
    return known.select("id", "c.intent", understanding.answer_preferences(F.col("c.intent")).alias("p")).select("id", "intent", "p.content_length", "p.source", "p.freshness_weight", "p.authority_weight")


# --- places and documents -----------------------------------------------------------------------------------------
_CITY_LIST = list(L.CITIES)
_ANY_CITY, _ANY_COUNTY = f"[{_sql_list(_CITY_LIST)}]", f"[{_sql_list(L.COUNTIES)}]"
_QUERIES_SQL = "CASE c_custkey % 3 WHEN 0 THEN 'skolor i malmö' WHEN 1 THEN 'jobb i uppsala' ELSE 'väder' END"
_RESULTS = f"""r AS (SELECT c_custkey AS doc_id, {_QUERIES_SQL} AS query, {_QUERIES_SQL} AS q, CAST(c_custkey % 70 AS DOUBLE) AS score,
    CASE c_custkey % 5 WHEN 0 THEN 'http://' || {_ANY_CITY}[1 + c_custkey % {len(_CITY_LIST)}] || '.se/' WHEN 1 THEN 'http://x.se/' || replace({_ANY_COUNTY}[1 + c_custkey % {len(L.COUNTIES)}], ' ', '-') ELSE 'http://x.se/' END AS url,
    CASE WHEN c_custkey % 5 = 2 THEN 'Nytt i ' || upper({_ANY_CITY}[1 + c_custkey % {len(_CITY_LIST)}]) ELSE 'Nytt' END AS title,
    CASE WHEN c_custkey % 5 = 3 THEN repeat('x', CASE WHEN c_custkey % 2 = 0 THEN 100 ELSE 600 END) || ' lund' ELSE 'inget' END AS content, CASE WHEN c_custkey % 11 = 0 THEN '{{"location": "solna", "n": 1}}' ELSE '{{"n": 1}}' END AS metadata FROM customer),
  p AS (SELECT doc_id, score, {_QUERY_PLACE} AS query_place, coalesce(json_extract_string(metadata, '$.location'), {_first_hit(_CITY_LIST, "lower(url)")}[1], {_first_hit(L.COUNTIES, "lower(url)")}[1],
    {_first_hit(_CITY_LIST, "lower(title) || ' ' || left(lower(content), 500)")}[1]) AS doc_place FROM r),
  c AS (SELECT *, {_COUNTY.format("doc_place")} AS doc_county, {_COUNTY.format("query_place")} AS query_county, {_COUNTY.format("'lund'")} AS user_county FROM p),
  b AS (SELECT doc_id, query_place, doc_place, doc_county, round(least(100.0, score * CASE WHEN query_place = doc_place THEN 2.0 WHEN query_county = doc_county THEN 1.5 ELSE 1.0 END
    * CASE WHEN 'lund' = doc_place THEN 1.3 WHEN user_county = doc_county THEN 1.2 ELSE 1.0 END), 6) AS score FROM c)"""


def _boosted(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda values: F.element_at(T.words(values), (1 + k % len(values)).cast("int"))
    url = F.when(k % 5 == 0, F.concat(F.lit("http://"), pick(_CITY_LIST), F.lit(".se/"))).when(k % 5 == 1, F.concat(F.lit("http://x.se/"), F.replace(pick(L.COUNTIES), F.lit(" "), F.lit("-")))).otherwise("http://x.se/")
    content = F.when(k % 5 == 3, F.concat(F.when(k % 2 == 0, F.lit("x" * 100)).otherwise("x" * 600), F.lit(" lund"))).otherwise("inget")
    metadata = F.when(k % 11 == 0, '{"location": "solna", "n": 1}').otherwise('{"n": 1}')
    results = table(spark, sf_dir, "customer").select(
        k.alias("doc_id"), F.when(k % 3 == 0, "skolor i malmö").when(k % 3 == 1, "jobb i uppsala").otherwise("väder").alias("query"), (k % 70).cast("double").alias("score"), url.alias("url"),
        F.when(k % 5 == 2, F.concat(F.lit("Nytt i "), F.upper(pick(_CITY_LIST)))).otherwise("Nytt").alias("title"), content.alias("content"), F.get_json_object(metadata, "$.location").alias("location"),
    )
    return understanding.boost_results(results, "lund")


@query(f"WITH {_RESULTS} SELECT doc_id, query_place, doc_place, score FROM b")
def regional_results(spark, sf_dir):
    """Places of queries and documents, boosted scores. [JN8, SEM9, SEM10, MTH14, COL7]"""
    return _boosted(spark, sf_dir).select("doc_id", "query_place", "doc_place", _r(F.col("score")).alias("score"))


@query(f"WITH {_RESULTS} SELECT doc_id, score FROM b ORDER BY b.score DESC, doc_id LIMIT 50")
def regional_top(spark, sf_dir):
    """[TOP5]"""
    return _boosted(spark, sf_dir).select("doc_id", _r(F.col("score")).alias("score")).orderBy(F.desc("score"), F.asc("doc_id")).limit(50)


@query(f"WITH {_RESULTS} SELECT doc_id, doc_place, 'county' AS kind FROM b WHERE doc_county = 'skåne' UNION ALL SELECT doc_id, doc_place, 'city' FROM b WHERE doc_place = 'lund'")
def regional_filters(spark, sf_dir):
    """[FLT12, FLT13]"""
    rows = _boosted(spark, sf_dir)
    county, city = understanding.in_county(rows, "Skåne"), understanding.in_city(rows, "Lund")
    return county.select("doc_id", "doc_place", F.lit("county").alias("kind")).unionByName(city.select("doc_id", "doc_place", F.lit("city").alias("kind")))


_TITLES = ["Hur du ansöker hos Skatteverket", "Vad är CSN", "Nytt i Stockholm", "Riksdagen beslutar", "Östergötland idag", "Annat"]
_URLS = ["https://skatteverket.se/a", "https://x.gov.se/b", "https://news.se/c", "https://riksdagen.se/nyheter", "https://y.se/d"]
_TEXTS = ["en guide till allt", "en definition av något", "text"]
_DOC_SQL = f"""s AS (SELECT page_id, [{_sql_list(_URLS)}][1 + page_id % {len(_URLS)}] AS u, lower([{_sql_list(_TITLES)}][1 + page_id % {len(_TITLES)}]) AS t, [{_sql_list(_TEXTS)}][1 + page_id % {len(_TEXTS)}] AS body FROM pages),
  d AS (SELECT page_id, {" OR ".join(f"contains(u, '{x}')" for x in L.OFFICIAL_URLS)} AS official, u, t, body, {_first_hit(L.AGENCIES, "t")} AS institutions,
    coalesce({_case(L.SCOPE_CITIES, _first_hit(L.SCOPE_CITIES, "t") + "[1]")}, list_filter([{", ".join(f"CASE WHEN contains(t, '{k}') OR contains(t, '{v.lower()}') THEN '{v}' END" for k, v in L.SCOPE_COUNTIES.items())}], lambda x: x IS NOT NULL)[-1]) AS scope FROM s),
  e AS (SELECT *, CASE WHEN contains(body, 'guide') OR contains(t, 'hur ') THEN 'GUIDE' WHEN contains(body, 'definition') OR contains(t, 'vad är') THEN 'DEFINITION' WHEN contains(u, 'news') OR contains(u, 'nyheter') THEN 'NEWS' WHEN official THEN 'OFFICIAL' ELSE 'GENERAL' END AS category FROM d)"""


def _signals(spark, sf_dir) -> DataFrame:
    pick = lambda values: F.element_at(T.words(values), (1 + F.col("page_id") % len(values)).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", pick(_URLS).alias("u"), pick(_TITLES).alias("t"), pick(_TEXTS).alias("b"))
    return rows.select("page_id", understanding.document_signals(F.col("u"), F.col("t"), F.col("b")).alias("d"))


@query(f"WITH {_DOC_SQL} SELECT page_id, official, category, scope, array_to_string(institutions, ',') AS institutions, CAST(CASE WHEN official THEN 3.0 ELSE 1.0 END AS DOUBLE) AS authority_boost FROM e")
def document_signals(spark, sf_dir):
    """[SEM6]"""
    return _signals(spark, sf_dir).select("page_id", "d.official", "d.category", "d.scope", F.array_join("d.institutions", ",").alias("institutions"), "d.authority_boost")


#: The fixture's questions.
_STATED = "id < 0"


@query(f"""{_ASK}, {_CONTEXT_SQL.replace("FROM q)", f"FROM q WHERE {_STATED})", 1)}, {_DOC_SQL}
  SELECT id, page_id, round(CAST(CASE WHEN c.official AND e.official THEN 3.0 ELSE 1.0 END * CASE WHEN lower(c.scope) = lower(e.scope) THEN 2.0 ELSE 1.0 END * CASE WHEN e.category = c.intent THEN {_case(L.CATEGORY_BOOSTS, "c.intent", "1.0")} ELSE 1.0 END
    * CASE WHEN list_has_any(c.agencies, e.institutions) THEN 1.5 ELSE 1.0 END AS DOUBLE), 6) AS boost FROM c, e""")
def relevance_boosts(spark, sf_dir):
    """The fixture's queries, a stated set, against all pages. [MTH16, JN15, SET5]"""
    asked = understanding.with_context(_asked(spark, sf_dir).where(_STATED), "text", "c").select("id", "c")
    rows = _signals(spark, sf_dir).join(F.broadcast(asked))
    return rows.select("id", "page_id", _r(understanding.relevance_boost(F.col("c"), F.col("d"))).alias("boost"))


# --- answers ------------------------------------------------------------------------------------------------------
_FIXTURE = [
    (1, "Vad är en lag?", 1, "https://riksdagen.se/lag", "Lag", "Text. En lag är en regel som alla följer. Mer."),
    (2, "Hur man bakar bröd", 1, "https://x.se/a", "Bröd", "1. Blanda allt noga här\n2. Baka degen en timme\n3. Ät brödet med smör\n"),
    (3, "skillnad mellan katt och hund", 3, "https://x.se/b", "Djur", "En katt jamar ofta medan hund skäller högt. Slut."),
    (3, "skillnad mellan katt och hund", 1, "https://x.se/c", "Djur", "Ingenting."),
    (4, "skatt 2024", 2, "https://www.skatt.gov.se/x", "Skatt", "Kort.\n\n" + "Detta stycke handlar om skatten och är längre än femtio tecken."),
]
_RANKED_SQL = "(VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("\n", "' || chr(10) || '") + "'" for v in row) + ")" for row in _FIXTURE) + ") AS v(query_id, query, rank, url, title, content)"
_WORD1 = r"regexp_extract(lower(text), '[\p{L}]+', 0)"
_ANSWERS = rf"""ranked AS (SELECT * FROM {_RANKED_SQL}
    UNION ALL SELECT 10000 + item_id, 'Vad är ' || {_WORD1} || '?', 1, 'https://x.gov.se/' || item_id, 'T', 'Text. ' || {_WORD1} || ' är ' || replace(text, '.', '') || '. Mer.' FROM benchmark
    UNION ALL SELECT 20000 + item_id // 4, 'skatt', item_id % 4 + 1, CASE WHEN item_id % 3 = 0 THEN 'https://y.gov.se/' ELSE 'https://z.se/' END || item_id, 'S', 'Kort.' || chr(10) || chr(10) || text FROM benchmark),
  k AS (SELECT *, lower(query) AS q FROM ranked WHERE rank <= 5), kk AS (SELECT *, {_kinds([*(f"'{x}'" for x, _, _ in L.ANSWER_KINDS), "'FACT'"])} AS kind,
    trim(regexp_extract(q, '{L.ASKED_DEFINITION}', 1)) AS term, trim(regexp_extract(q, '{L.ASKED_COMPARISON}', 1)) AS a, trim(regexp_extract(q, '{L.ASKED_COMPARISON}', 2)) AS b, contains(url, '.gov.se') AS gov FROM k),
  x AS (SELECT *, coalesce(nullif(regexp_extract(content, '(?i)' || regexp_escape(term) || ' är ([^\.]+\.)', 1), ''), nullif(regexp_extract(content, '(?i)' || regexp_escape(term) || ' innebär ([^\.]+\.)', 1), ''),
      nullif(regexp_extract(content, '(?i)' || regexp_escape(term) || ' betyder ([^\.]+\.)', 1), '')) AS said,
    list_transform(list_zip(regexp_extract_all(content, '{L.STEP}', 1), regexp_extract_all(content, '{L.STEP}', 2)), lambda s: s[1] || '. ' || trim(s[2])) AS steps,
    coalesce(nullif(regexp_extract(content, '(?i)skillnad(?:en)? mellan ' || regexp_escape(a) || ' och ' || regexp_escape(b) || ' (?:är|innebär) ([^\.]+\.)', 0), ''), nullif(regexp_extract(content, '(?i)' || regexp_escape(a) || ' ([^\.]*?) medan ' || regexp_escape(b) || ' ([^\.]+\.)', 0), '')) AS against,
    list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda p: trim(p)), lambda p: length(p) > 50)[1] AS para FROM kk),
  y AS (SELECT *, CASE kind WHEN 'DEFINITION' THEN CASE WHEN rank = 1 AND regexp_matches(q, '{L.ASKED_DEFINITION}') THEN upper(left(term, 1)) || lower(substring(term, 2)) || ' är ' || said END
      WHEN 'PROCEDURE' THEN CASE WHEN rank = 1 AND len(steps) >= 3 THEN array_to_string(steps[1:5], chr(10)) || CASE WHEN len(steps) > 5 THEN chr(10) || chr(10) || '(+ ' || (len(steps) - 5) || ' fler steg)' ELSE '' END END
      WHEN 'COMPARISON' THEN CASE WHEN regexp_matches(q, '{L.ASKED_COMPARISON}') THEN 'Skillnaden mellan ' || a || ' och ' || b || ':' || chr(10) || chr(10) || against END
      ELSE CASE WHEN rank <= 3 AND gov AND ({" OR ".join(f"contains(lower(url), '{v}')" for v in L.VERIFIED)}) THEN left(para, 500) || CASE WHEN length(para) > 500 THEN '...' ELSE '' END END END AS answer FROM x),
  z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn FROM y WHERE answer IS NOT NULL),
  found AS (SELECT CAST(query_id AS BIGINT) AS query_id, CASE WHEN kind IN ('DEFINITION', 'PROCEDURE', 'COMPARISON') THEN kind ELSE 'GOVERNMENT' END AS kind, answer,
    CAST(CASE kind WHEN 'DEFINITION' THEN 0.8 WHEN 'PROCEDURE' THEN 0.75 WHEN 'COMPARISON' THEN 0.7 ELSE 0.95 END AS DOUBLE) AS confidence, url, title, {" OR ".join(f"contains(lower(url), '{v}')" for v in L.VERIFIED)} AS verified,
    CASE {" ".join(f"WHEN contains(url, '{k}') THEN '{v}'" for k, v in L.AGENCY_NAMES.items())} ELSE 'Myndighet' END AS agency FROM z WHERE rn = 1)"""


def _best(spark, sf_dir) -> DataFrame:
    own = local_table(spark, dict(zip(("query_id", "query", "rank", "url", "title", "content"), map(list, zip(*_FIXTURE)), strict=True)), "query_id long, query string, rank int, url string, title string, content string")
    items, k = table(spark, sf_dir, "benchmark"), F.col("item_id")
    word = F.regexp_extract(F.lower("text"), r"[\p{L}]+", 0)
    defined = items.select(
        (k + 10000).alias("query_id"), F.concat(F.lit("Vad är "), word, F.lit("?")).alias("query"), F.lit(1).alias("rank"), F.concat(F.lit("https://x.gov.se/"), k).alias("url"), F.lit("T").alias("title"),
        F.concat(F.lit("Text. "), word, F.lit(" är "), F.replace("text", F.lit("."), F.lit("")), F.lit(". Mer.")).alias("content"),
    )
    said = items.select(
        (F.floor(k / 4) + 20000).alias("query_id"), F.lit("skatt").alias("query"), (k % 4 + 1).cast("int").alias("rank"), F.concat(F.when(k % 3 == 0, "https://y.gov.se/").otherwise("https://z.se/"), k).alias("url"), F.lit("S").alias("title"),
        F.concat(F.lit("Kort.\n\n"), F.col("text")).alias("content"),
    )
    return answers.best_answers(own.unionByName(defined).unionByName(said))


@query(f"WITH {_ANSWERS} SELECT * FROM found")
def answers_found(spark, sf_dir):
    """[STR20-STR25, FLT11, TOP9]"""
    return _best(spark, sf_dir)


@query(f"""WITH {_ANSWERS} SELECT query_id, CAST(to_json({{'type': kind, 'answer': answer, 'source': {{'url': url, 'title': title}}, 'confidence': confidence, 'verified': verified, 'last_updated': NULL}}) AS VARCHAR) AS json FROM found""")
def answer_json(spark, sf_dir):
    """[PRJ14]"""
    return answers.answer_json(_best(spark, sf_dir))


# --- figures over time --------------------------------------------------------------------------------------------
@query("""WITH s AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS done, CAST(count(*) * 3 AS DOUBLE) AS total, CASE WHEN event_type = 'error' THEN 0.0 ELSE round(epoch(max(ts)) - epoch(min(ts))) END AS seconds FROM events GROUP BY 1)
  SELECT event_type, round(CASE WHEN seconds = 0 THEN 0 ELSE done * 60 / seconds END, 6) AS per_minute, round(done * 100 / total, 6) AS percent, round(CASE WHEN seconds = 0 THEN 0 ELSE (total - done) * 60 / (done * 60 / seconds) END, 4) AS eta_seconds FROM s""")
def crawl_progress(spark, sf_dir):
    """[AGG25]"""
    seconds = F.when(F.col("event_type") == "error", 0.0).otherwise(F.round((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6))
    sums = _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").cast("double").alias("done"), (F.count("*") * 3).cast("double").alias("total"), seconds.alias("seconds"))
    return sums.select("event_type", ops.crawl_progress(F.col("done"), F.col("total"), F.col("seconds")).alias("p")).select("event_type", _r(F.col("p.per_minute")).alias("per_minute"), _r(F.col("p.percent")).alias("percent"), _r(F.col("p.eta_seconds"), 4).alias("eta_seconds"))


@query("SELECT event_id, least(60.0, CAST(2 ** (event_id % 9) AS DOUBLE)) AS wait, round(value * 1000 / ((user_id + 1) / 1000) / 1048576, 6) AS mb_s FROM events")
def backoff_throughput(spark, sf_dir):
    """[MTH17, MTH20]"""
    return table(spark, sf_dir, "events").select("event_id", ranking.backoff((F.col("event_id") % 9 + 1).cast("int")).alias("wait"), _r(ranking.throughput_mb(F.col("value") * 1000, F.col("user_id") + 1)).alias("mb_s"))


@query(f"""WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN 'no date' END AS t FROM events), p AS (SELECT event_id, TRY_CAST(t AS TIMESTAMP) AS m FROM s)
  SELECT event_id, m AS moment, round(coalesce(exp(-floor((epoch(TIMESTAMP '{_NOW}') - epoch(m)) / 86400) / 365), 0.5), 6) AS recency FROM p""")
def parsed_moments(spark, sf_dir):
    """[DT1, DT2, MTH5]"""
    k, ts = F.col("event_id") % 4, F.col("ts")
    text = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.date_format(ts, "yyyy-MM-dd")).when(k == 2, "no date")
    rows = _events(spark, sf_dir).select("event_id", ranking.parse_moment(text).alias("moment"))
    return rows.select("event_id", F.col("moment").cast("timestamp_ntz").alias("moment"), _r(ranking.recency_factor(F.col("moment"), F.lit(_NOW).cast("timestamp"))).alias("recency"))


_NAMES = [*L.MONTHS, *L.WEEKDAYS, "Maj", "MÅNDAG", "ingen"]


@query(f"SELECT event_id, [{_sql_list(_NAMES)}][1 + event_id % {len(_NAMES)}] AS name, CAST({_case(L.MONTHS, f'lower([{_sql_list(_NAMES)}][1 + event_id % {len(_NAMES)}])')} AS INTEGER) AS month, {_case(L.WEEKDAYS, f'lower([{_sql_list(_NAMES)}][1 + event_id % {len(_NAMES)}])')} AS weekday FROM events")
def name_maps(spark, sf_dir):
    """[DT4]"""
    rows = table(spark, sf_dir, "events").select("event_id", F.element_at(T.words(_NAMES), (1 + F.col("event_id") % len(_NAMES)).cast("int")).alias("name"))
    return rows.select("event_id", "name", understanding.month_number(F.col("name")).alias("month"), understanding.weekday_name(F.col("name")).alias("weekday"))


@query("SELECT user_id, max(ts) AS last, coalesce(epoch(TIMESTAMP '2024-01-30 00:00:00') - epoch(max(ts)) >= 86400, true) AS due FROM events GROUP BY 1 UNION ALL SELECT -1, NULL, true")
def due_updates(spark, sf_dir):
    """[FLT20]"""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit(None).cast("timestamp_ntz").alias("last")))
    return last.withColumn("due", ops.due(F.col("last").cast("timestamp"), F.lit("2024-01-30 00:00:00").cast("timestamp"), 86400))


@query("SELECT CAST(count(*) AS BIGINT) AS deleted FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAYS")
def retention_count(spark, sf_dir):
    """[FLT15]"""
    return ops.retained(_events(spark, sf_dir), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp"), 10)[1]


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOURS AS session_end, user_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf_dir):
    found = windows.sessions(_events(spark, sf_dir), "6 hours")
    return found.select(F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "user_id", "n")


# --- streams ------------------------------------------------------------------------------------------------------
def _streamed(spark, sf_dir, run) -> DataFrame:
    """What ``run`` makes of the events as a stream that is ended and started again from its checkpoint for each third of the time."""
    path, rows = scratch_path(spark, "stream"), _calls(spark, sf_dir)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = rows.agg(F.percentile_approx(micros, F.array(F.lit(1 / 3), F.lit(2 / 3)), F.lit(1000))).first()[0] or (0, 0)
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        for third in (micros < low, (micros >= low) & (micros < high), micros >= high):
            rows.where(third).write.mode("append").parquet(f"{path}/in")
            found = run(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
            _ended(found.writeStream.option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").format("parquet").trigger(availableNow=True).start())
    finally:
        spark.conf.set(key, before)
    return _kept(spark, path, spark.read.schema(found.schema).parquet(f"{path}/out"))


def _register_streams() -> None:
    from quillmere.plans.queries import ORACLE_SQL, QUERIES

    # The last two forget a key when event time has passed it by.
    streams = {
        "circuit_breaker": (machines.circuit_breaker(3, 24 * 3600.0), False), "adaptive_timeout": (machines.adaptive_timeout(), False),
        "rate_limit_block": (machines.rate_limit(3, 12 * 3600.0, 24 * 3600.0), True), "alert_cooldown": (machines.cooldown(24 * 3600.0), True),
    }

    def streamed(name: str, machine: machines.Machine, clean_up: bool):
        forced = name == "alert_cooldown"

        def run(events: DataFrame) -> DataFrame:
            return machines.run_stream(events.withColumn("ok", F.lit(False)) if forced else events, "user_id", machine, clean_up)

        return lambda spark, sf_dir: _streamed(spark, sf_dir, run)

    for name, (machine, clean_up) in streams.items():
        # The same results as in one batch. [STM4, STM5, STM10, WIN4]
        QUERIES[f"{name}_stream"] = streamed(name, machine, clean_up)
        ORACLE_SQL[f"{name}_stream"] = ORACLE_SQL[name]


_register_streams()


_FILLED = """e AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS same FROM events),
  f(user_id, ts) AS (SELECT user_id, min(ts) FROM events GROUP BY 1 UNION ALL
    SELECT user_id, nxt FROM (SELECT f.user_id, (SELECT min(x.ts) FROM events x WHERE x.user_id = f.user_id AND x.ts > f.ts + INTERVAL 24 HOURS) AS nxt FROM f) WHERE nxt IS NOT NULL)"""


@query(f"WITH RECURSIVE {_FILLED} SELECT e.event_id, CAST(e.user_id AS VARCHAR) AS \"key\", CASE WHEN f.ts IS NULL OR e.same > 1 THEN 'hit' ELSE 'miss' END AS result FROM e LEFT JOIN f ON f.user_id = e.user_id AND f.ts = e.ts")
def cache_entries_stream(spark, sf_dir):
    """[STM6, DT3]"""
    return _streamed(spark, sf_dir, lambda events: machines.run_stream(events, "user_id", machines.cache_entry()))


@query()
def lru_cache_stream(spark, sf_dir):
    """Caches of 20 entries, one for each kind of event, asked for users. SQL has no such state; tests hold it against a model. [STM6, WIN11]"""
    kinds = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"))
    named = lambda events: events.join(kinds, "event_id")
    return _streamed(spark, sf_dir, lambda events: machines.run_cache(named(events), "kind", "user_id", 20))


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_stream(spark, sf_dir):
    """[STM2, STM3]"""
    path = scratch_path(spark, "tumbling")
    table(spark, sf_dir, "events").write.parquet(f"{path}/in")
    events = windows.with_event_time(spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in"), late="1 hour")
    kept: list[DataFrame] = []
    sink = lambda rows, _: rows.write.mode("overwrite").parquet(f"{path}/out{len(kept)}") or kept.append(rows)
    _ended(windows.tumbling(events, "6 hours").writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start())
    found = spark.read.parquet(f"{path}/out{len(kept) - 1}")
    return _kept(spark, path, found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", _r(F.col("total"), 4).alias("total")))
