"""Registered queries of the SQL surface, the segmented index, positions, trigrams and pages."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillmere.functions import catalog
from quillmere.functions import lexicon as L
from quillmere.functions import text as T
from quillmere.operators import blocks, cells, encoder, index, pages, positions, trigrams, vector
from quillmere.operators.positions import All, Any, Not, Phrase, Word
from quillmere.operators.segments import SegmentedIndex
from quillmere.operators.site import Site
from quillmere.plans.queries import _ASKED, _ASKED_SQL, _CASE_AUTHORITY, _HOST, _SKIP, _TERMS, _TOKENS, _UNESCAPE, _hits, _search_sql, _unstemmed, query, table
from quillmere.shared import Scratch, durable
from quillmere.sources import folders


@query(_search_sql("ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))"))
def sql_surface_search(spark, sf_dir):
    """BM25 in SQL alone: the table function reads tokens, the catalogue's functions choose and score them."""
    catalog.register(spark)
    found = catalog.search(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), index.query_table(spark, _ASKED), 10)
    return found.select("query_id", "doc_id", "score", F.col("rank").cast("int").alias("rank"))


_FINAL = """distinct_docs AS (SELECT max(doc_id) AS doc_id, any_value(text) AS text FROM documents GROUP BY md5(text)),
final AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' the extra' ELSE text END AS text FROM distinct_docs WHERE doc_id % 7 <> 0)"""


def _kept_up(spark, sf_dir, path: str) -> SegmentedIndex:
    """An index of all documents after changes: two thirds at once, the last third, other texts for a fifth, a seventh taken out."""
    docs = durable(index.collapse_copies(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text"))
    kept = SegmentedIndex.create(spark, path, stemmed=False).add(docs.where("doc_id % 3 <> 1")).add(docs.where("doc_id % 3 = 1"))
    kept = kept.add(docs.where("doc_id % 5 = 0").withColumn("text", F.concat("text", F.lit(" the extra"))))
    return kept.remove(docs.where("doc_id % 7 = 0").select("doc_id"))


@query(f"""WITH {_FINAL}, tok AS (SELECT doc_id, unnest({_TERMS}) AS term FROM final), post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2)
  SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS total, CAST((SELECT count(*) FROM final) AS BIGINT) AS n,
    round((SELECT avg(dl) FROM (SELECT sum(tf) AS dl FROM post GROUP BY doc_id)), 6) AS average FROM post GROUP BY 1""")
def segmented_index(spark, sf_dir):
    """Frequencies kept up by deltas beside what the live postings hold. [SNK4, AGG7]"""
    scratch = Scratch(spark)
    kept = _kept_up(spark, sf_dir, scratch.path("segments")).index()
    totals = kept.postings.groupBy("term").agg(F.sum("tf").alias("total"))
    found = kept.terms.select("term", "df").join(totals, "term", "full_outer")
    found = durable(found.select("term", "df", "total", F.lit(kept.n).cast("long").alias("n"), F.round(F.lit(kept.average), 6).alias("average")))
    scratch.clear()
    return found


#: Query id to tree, with what it says in SQL over a document's map ``m`` of positions.
_TREES = {
    1: (All((Word("the"), Word("of"))), "has('the') AND has('of')"),
    2: (Phrase(("of", "the")), "phrase('of', 'the')"),
    3: (All((Any((Word("une"), Word("eau"))), Not(Word("des")))), "(has('une') OR has('eau')) AND NOT has('des')"),
    4: (All((Phrase(("in", "the")), Not(Phrase(("of", "the"))))), "phrase('in', 'the') AND NOT phrase('of', 'the')"),
    5: (Any((Phrase(("de", "la")), Word("para"), Word("que"))), "phrase('de', 'la') OR has('para') OR has('que')"),
    6: (Not(Word("the")), "NOT has('the')"),
}


def _tree_sql(number: int) -> str:
    """Matches and cover density of one tree by windows over a document's tokens."""
    tree, holds = _TREES[number]
    positive = positions.words_of(tree, positive=True)
    quoted = ", ".join(f"'{w}'" for w in positive) or "''"
    last = [f"max(CASE WHEN token = '{w}' THEN p END) OVER w" for w in positive] or ["NULL"]
    ok = re.sub(r"has\('(\w+)'\)", r"bool_or(token = '\1')", holds)
    ok = re.sub(r"phrase\('(\w+)', '(\w+)'\)", r"coalesce(bool_or(token = '\1' AND next = '\2'), false)", ok)
    return f"""
    ok{number} AS (SELECT doc_id FROM tok GROUP BY doc_id HAVING {ok}),
    k{number} AS (SELECT doc_id, count(DISTINCT token) AS k FROM tok WHERE token IN ({quoted}) GROUP BY doc_id),
    e{number} AS (
      SELECT doc_id, p, k, least({", ".join(last)}) AS low, {" + ".join(f"(CASE WHEN ({x}) IS NULL THEN 0 ELSE 1 END)" for x in last)} AS seen
      FROM tok JOIN k{number} USING (doc_id) WHERE token IN ({quoted}) WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING)),
    c{number} AS (SELECT doc_id, k, low, min(p) AS p FROM e{number} WHERE seen = k GROUP BY ALL),
    r{number} AS (
      SELECT {number} AS query_id, doc_id, coalesce(sum(CAST(k AS DOUBLE) / (p - low + 1)), 0.0) AS score FROM ok{number} LEFT JOIN c{number} USING (doc_id) GROUP BY 2)"""


_POSITIONAL = f"""WITH tokens AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
    tok AS (SELECT doc_id, token, p, lead(token) OVER (PARTITION BY doc_id ORDER BY p) AS next
      FROM (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM tokens WHERE len(t) > 0 UNION ALL SELECT doc_id, NULL, NULL FROM tokens WHERE coalesce(len(t), 0) = 0)),
    {",".join(_tree_sql(k) for k in _TREES)},
    scored AS ({" UNION ALL ".join(f"SELECT * FROM r{k}" for k in _TREES)}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)
    SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 20"""


@query(_POSITIONAL)
def positional_search(spark, sf_dir):
    """Words, phrases, AND, OR and NOT over all documents, ranked by cover density. [STR37]"""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = positions.search(positions.positional_postings(docs), {k: tree for k, (tree, _) in _TREES.items()}, docs, limit=20)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
_GRAMS = rf"""t AS (SELECT page_id, list_sort(list_distinct(flatten(list_transform(regexp_extract_all(lower({_TITLE}), '{T.TOKEN}'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))) AS g FROM pages),
  c AS (SELECT g, min(page_id) AS class FROM t WHERE len(g) > 0 GROUP BY g),
  s AS (SELECT a.class AS a, b.class AS b, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) AS similarity FROM c a JOIN c b ON a.class <> b.class)"""


def _titles(spark, sf_dir):
    """Titles as they stand in the page, character references and all, so that both sides read the same string."""
    rows = table(spark, sf_dir, "pages")
    return trigrams.TrigramIndex.build(rows.select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title")), "page_id", "title")


@query(f"WITH {_GRAMS} SELECT a, b, round(similarity, 6) AS similarity FROM s WHERE a < b AND similarity >= 0.4")
def similar_titles(spark, sf_dir):
    """Pairs of different titles by their trigrams. [STR36]"""
    return trigrams.similar(_titles(spark, sf_dir), 0.4).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_GRAMS}, q AS (SELECT page_id AS query_id, class FROM t JOIN c USING (g)),
  r AS (SELECT query_id, b AS class, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, b) AS rank FROM q JOIN s ON q.class = s.a WHERE similarity >= 0.3)
  SELECT query_id, class, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def closest_titles(spark, sf_dir):
    """Of every page the five most similar other titles."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("query_id"))
    return trigrams.closest(_titles(spark, sf_dir), rows, 5, 0.3).select("query_id", "class", F.round("similarity", 6).alias("similarity"), "rank")


@query(_search_sql("ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))"))
def block_max_search(spark, sf_dir):
    """The hits of BM25 from the blocks that can hold them. [JN1, TOP1]"""
    scratch = Scratch(spark)
    found, _ = blocks.search(blocks.BlockIndex.save(_unstemmed(spark, sf_dir), scratch.path("blocks")), index.query_table(spark, _ASKED), 10)
    found = durable(_hits(found))
    scratch.clear()
    return found


def _site_sql(turns: int = 20) -> str:
    """Fields by patterns, which fit these pages, then index, links, PageRank and factors."""
    block = lambda name: f"regexp_matches(h, '(?is)<{name}[^>]*>(.*?)</{name}>') THEN regexp_extract(h, '(?is)<{name}[^>]*>(.*?)</{name}>', 1)"
    rank = [
        f"""r{k + 1} AS MATERIALIZED (SELECT v.id, 0.15 / nv + 0.85 * coalesce(g, 0) AS s FROM v CROSS JOIN nv LEFT JOIN (
        SELECT dst, sum(s / d) AS g FROM edges JOIN deg USING (src) JOIN r{k} ON id = src GROUP BY 1) ON dst = id)"""
        for k in range(turns)
    ]
    factors = ("tf_idf", "pagerank", "authority", "recency", "density", "structure", "language")
    weights = " + ".join(f"f_{k} * {L.WEIGHTS[k]}" for k in factors)
    return rf"""WITH b AS (SELECT page_id, url, html, regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'g') AS h FROM pages),
    m AS (SELECT page_id, url, html, CASE WHEN {block("main")} WHEN {block("article")} ELSE regexp_extract(h, '(?is)<body[^>]*>(.*)</body>', 1) END AS h FROM b),
    p AS (SELECT page_id, url, {_HOST} AS d, trim(regexp_replace({_UNESCAPE.format("regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')")}, '\s+', ' ', 'g')) AS text,
      coalesce(nullif(trim({_UNESCAPE.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}), ''), 'Untitled') AS title,
      list_distinct(list_filter(list_transform(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"', 1), lambda x: regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || x), lambda x: NOT regexp_matches(x, '(?i)\.({_SKIP})$'))) AS links FROM m),
    newest AS (SELECT md5(text) AS hash, max(page_id) AS newest FROM p GROUP BY 1),
    docs AS (SELECT page_id AS doc_id, url, d, text, title, links FROM p JOIN newest ON page_id = newest),
    targets AS (SELECT url, max(newest) AS dst FROM p JOIN newest ON md5(text) = hash GROUP BY 1),
    edges AS (SELECT DISTINCT src, dst FROM (SELECT doc_id AS src, unnest(links) AS url FROM docs) JOIN targets USING (url)),
    v AS (SELECT doc_id AS id FROM docs), nv AS (SELECT count(*) AS nv FROM v), deg AS (SELECT src, count(*) AS d FROM edges GROUP BY 1), r0 AS (SELECT id, 1.0 / nv AS s FROM v, nv), {", ".join(rank)},
    pr AS (SELECT id AS doc_id, s / (SELECT max(s) FROM r{turns}) AS pagerank FROM r{turns}),
    tok AS (SELECT doc_id, unnest({_TERMS}) AS term FROM docs), post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2), terms AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    {_ASKED_SQL}, t AS (SELECT query_id, count(*) AS nt, list(term) AS ts FROM q GROUP BY 1),
    c AS (SELECT query_id, doc_id, sum(tf * (ln((nv + 1) / (df + 1)) + 1)) AS s FROM q JOIN post USING (term) JOIN terms USING (term), nv GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rk FROM c),
    f AS (SELECT query_id, doc_id, least(1.0, s / nt / 10) AS f_tf_idf, pagerank AS f_pagerank, least(1.0, CAST({_CASE_AUTHORITY} AS DOUBLE) / 3.5) AS f_authority, 0.5 AS f_recency,
      least(1.0, list_sum(list_transform(ts, lambda w: CASE WHEN contains(lower(title), w) THEN 3 ELSE 0 END + CASE WHEN contains(lower(left(text, 200)), w) THEN 1 ELSE 0 END)) / (nt * 4)) AS f_density,
      CASE WHEN len(links) < 5 THEN len(links) / 5 WHEN len(links) <= 50 THEN 1.0 ELSE 50 / len(links) END AS f_structure,
      least(1.0, CASE WHEN ends_with(d, '.se') THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(lower(title), '[åäö]') THEN 0.3 ELSE 0 END + CASE WHEN contains(d, '.gov.se') OR contains(d, 'riksdag') THEN 0.2 ELSE 0 END) AS f_language
      FROM k JOIN docs USING (doc_id) JOIN pr USING (doc_id) JOIN t USING (query_id) WHERE rk <= 500),
    g AS (SELECT *, greatest(0.0, least(100.0, {weights})) AS s FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM g)
    SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(CAST(s AS DOUBLE), 2) AS score, {", ".join(f"round(CAST(f_{k} AS DOUBLE) * 100, 1) AS {k}" for k in factors)} FROM r WHERE rank <= 10"""


@query(_site_sql())
def pages_search(spark, sf_dir):
    """From the crawled pages to ranked hits with their factors: fields, copies, index, links, PageRank, seven factors."""
    found = Site.build(table(spark, sf_dir, "pages"), stemmed=False).search(_ASKED, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return found.select("query_id", "rank", "doc_id", "score", "factors.*")


@query()
def cell_search(spark, sf_dir):
    """Of each query the true ten nearest that the cells give, and the vectors read for them; recall is measured in tests. [SEM12]"""
    scratch = Scratch(spark)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    held = cells.CellIndex.save(rows, scratch.path("cells"))
    probes = held.tune(asked, 10, 0.9)
    true = vector.search(rows, asked, 10).select("query_id", "vec_id")
    found = held.search(asked, 10, probes).select("query_id", "vec_id", F.lit(1).alias("hit"))
    hits = true.join(found, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
    done = durable(hits.join(held.read_for(asked, probes), "query_id").withColumn("vectors", F.lit(rows.count()).cast("long")))
    scratch.clear()
    return done


@query()
def encoded_search(spark, sf_dir):
    """Texts to vectors by the hashed projection, then of every fiftieth document the five most similar. Tests hold the vectors against a model. [SEM11, SEM12]"""
    vectors = durable(encoder.embed(table(spark, sf_dir, "documents").select("doc_id", "text")))
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return vector.search(vectors, asked, 5)


@query(f"SELECT url, {_HOST} AS domain, md5(html) AS content FROM pages")
def page_folder_source(spark, sf_dir):
    """All pages as one JSON file each in a folder for each host, read by the data source and, as a stream that is ended half-way, again; what both have read. [SRC1, SRC5, SRC7]"""
    folders.register(spark)
    scratch = Scratch(spark)
    path, out, state = scratch.path("folders"), scratch.path("read"), scratch.path("state")
    rows = table(spark, sf_dir, "pages").select("url", pages.host(F.col("url")).alias("domain"), F.md5("html").alias("content")).withColumn("folder", F.col("domain"))
    half = F.pmod(F.xxhash64("url"), F.lit(2)) == 0
    for part in (half, ~half):
        rows.where(part).write.mode("append").partitionBy("folder").option("maxRecordsPerFile", 1).json(path)
        source = spark.readStream.format("crawled_pages").option("settle", 0).load(path).select("url", "domain", "content")
        source.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    batch, stream = spark.read.format("crawled_pages").load(path).select("url", "domain", "content"), spark.read.parquet(out)
    found = durable(folders.compared(batch, stream, "content"))
    scratch.clear()
    return found
