"""Fields of crawled pages, and which URLs to crawl."""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quillmere.functions import lexicon as L
from quillmere.functions import text as T
from quillmere.functions.html import Page, attributes

_AMPERSANDS = ("amp", "#38", "#038", "#x26", "#X26")


def unescape(text: Column) -> Column:
    """Text with its character references, by name (those of HTML 4, with a semicolon) and by number, replaced; others stay as they are."""
    names = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, code)])
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"), F.lit(1)))

    def character(ref: Column) -> Column:
        number = F.when(ref.rlike("^#[xX]"), F.conv(F.substring(ref, F.lit(3), F.length(ref)), 16, 10).cast("int")).when(ref.startswith("#"), F.substring(ref, F.lit(2), F.length(ref)).cast("int"))
        code = F.coalesce(number, names[ref])
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    # Ampersands last, so that what they yield is not taken for a reference.
    ordered = F.concat(F.filter(found, lambda x: ~x.isin(*_AMPERSANDS)), F.filter(found, lambda x: x.isin(*_AMPERSANDS)))
    return F.aggregate(ordered, text, lambda acc, ref: F.replace(acc, F.concat(F.lit("&"), ref, F.lit(";")), F.coalesce(character(ref), F.concat(F.lit("&"), ref, F.lit(";")))))


def _or(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


_FIELDS = StructType([StructField(x, StringType()) for x in ("title", "description", "keywords", "language", "content")] + [StructField("links", ArrayType(StringType()))])
#: Elements whose text is no content.
_UNSEEN = frozenset(["script", "style", "noscript"])


def _content(page: Page) -> str:
    """Text of the first main, else the first article, else the first div of class content, else the body, else all."""
    seen = page.without(_UNSEEN)
    tests = (
        lambda x: page.tags[x] == "main", lambda x: page.tags[x] == "article",
        lambda x: page.tags[x] == "div" and "content" in attributes(page.attrs[x]).get("class", "").split(), lambda x: page.tags[x] == "body",
    )
    top = next((x for x in (page.first(lambda x, test=test: seen[x] and test(x)) for test in tests) if x is not None), 0)
    inside = page.inside(top)
    return " ".join(" ".join(text for node, _, text in page.texts if inside[node] and seen[node]).split())


def _read(html: str | None, url: str | None) -> dict | None:
    if html is None:
        return None
    page = Page(html)
    first = lambda name: page.first(lambda x: page.tags[x] == name)
    own = lambda x: attributes(page.attrs[x]) if x is not None else {}
    named = page.first(lambda x: page.tags[x] == "title")
    metas = [own(x) for x in range(1, len(page.tags)) if page.tags[x] == "meta"]
    said = {name: next((m.get("content", "") for m in metas if m.get("name", "").lower() == name), "") for name in ("description", "keywords")}
    links = set()
    for x in range(1, len(page.tags)):
        if page.tags[x] == "a":
            href = own(x).get("href")
            if href is not None:
                try:
                    links.add(urldefrag(urljoin(url or "", href.strip()))[0])
                except ValueError:  # no URL, a bracket that does not close for instance
                    continue
    return {
        "title": "".join(text for node, _, text in page.texts if node == named).strip() if named else "", **said,
        "language": own(first("html")).get("lang", ""), "content": _content(page), "links": sorted(links),
    }


@F.arrow_udf(_FIELDS)
def _fields(html: pa.Array, url: pa.Array) -> pa.Array:
    return pa.array([_read(h.as_py(), u.as_py()) for h, u in zip(html, url, strict=True)], to_arrow_type(_FIELDS))


def fields(html: Column, url: Column | None = None) -> Column:
    """What a page's markup holds, read once: title, description, keywords, language, content and all links, absolute and without fragment. Null for a null page."""
    return _fields(html, F.lit(None).cast("string") if url is None else url)


def named(found: Column) -> Column:
    """The title among ``fields``. [PRJ1, COL5]"""
    return _or(found["title"], "Untitled")


def title(html: Column) -> Column:
    return named(fields(html))


def meta(html: Column, name: str) -> Column:
    """The content of the meta tag ``description`` or ``keywords``; empty without. [PRJ2]"""
    return F.coalesce(fields(html)[name], F.lit(""))


def language(html: Column) -> Column:
    """[PRJ3]"""
    return _or(fields(html)["language"], "sv")


def main_text(html: Column) -> Column:
    """Text of the first main, article, content block or body, else of all, without scripts and styles, white space collapsed. [PRJ4]"""
    return fields(html)["content"]


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1)


def _without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; ``..`` at the top is dropped."""
    parts = F.split(path, "/", -1)
    step = lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).when(p == ".", a).otherwise(F.concat(a, F.array(p)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step)
    ends = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.array_join(kept, "/"), F.when(ends | (F.size(kept) == 1), F.lit("/")).otherwise(F.lit("")))


def resolve(base: Column, href: Column) -> Column:
    """An absolute URL without dot segments and fragment. [COL10]"""
    scheme, origin = F.regexp_extract(base, "^([a-zA-Z]+)://", 1), F.regexp_extract(base, "^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^[a-zA-Z]+://[^/?#]+(/[^?#]*/|/)?", 1)
    bare = F.regexp_replace(href, "#.*$", "")
    path, rest = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"^[^?]*(.*)$", 1)
    return (
        F.when(bare.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), bare).when(bare.startswith("//"), F.concat(scheme, F.lit(":"), bare))
        .when(bare == "", F.regexp_replace(base, "#.*$", "")).when(bare.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), bare))
        .when(bare.startswith("/"), F.concat(origin, _without_dots(path), rest)).otherwise(F.concat(origin, _without_dots(F.concat(_or(folder, "/"), path)), rest))
    )


def crawlable(url: Column, domain: Column) -> Column:
    """http or https, the domain within the host, no extension of a file. [FLT1]"""
    return F.coalesce(host(url).contains(domain) & url.rlike("^https?://") & ~url.rlike(r"(?i)\.(" + "|".join(L.SKIP_EXTENSIONS) + ")$"), F.lit(False))


def crawled_links(found: Column, url: Column) -> Column:
    """Distinct crawlable links among the ``fields`` of the page at ``url``, sorted. [PRJ5]"""
    return F.filter(F.coalesce(found["links"], F.array().cast("array<string>")), lambda u: crawlable(u, host(url)))


def links(html: Column, url: Column) -> Column:
    return crawled_links(fields(html, url), url)


def extract(pages: DataFrame) -> DataFrame:
    """Fields of raw pages (url, html); one pass over the markup. A null page has an empty content and no links. [PRJ1-PRJ8]"""
    read = pages.select("url", fields(F.col("html"), F.col("url")).alias("f"))
    told = read.select(
        "url", host(F.col("url")).alias("domain"), named(F.col("f")).alias("title"), F.coalesce("f.content", F.lit("")).alias("content"), crawled_links(F.col("f"), F.col("url")).alias("links"),
        F.coalesce("f.description", F.lit("")).alias("meta_description"), F.coalesce("f.keywords", F.lit("")).alias("meta_keywords"), _or(F.col("f.language"), "sv").alias("language"),
    )
    return told.withColumns({"content_hash": F.md5("content"), "word_count": T.word_count(F.col("content")), "snippet": F.substring("content", 1, 200)})


def allowed_domain(url: Column, domains: list[str]) -> Column:
    """Exact or as an ending, without a dot between; www., scheme and path are dropped. [FLT10]"""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "^[a-z]+://", ""), "/.*$", ""), r"^www\.", "")
    return reduce(lambda a, d: a | bare.endswith(d), domains, bare.isin(domains))


def valid_domain(domain: Column) -> Column:
    """[FLT18]"""
    return domain.rlike(L.VALID_DOMAIN)


def valid_url(url: Column, schemes: tuple[str, ...] = ("http", "https")) -> Column:
    return url.rlike("^(" + "|".join(schemes) + r")://[^\s/?#]+[^\s]*$")


def domain_table(spark: SparkSession, domains: dict[str, str] | None = None) -> DataFrame:
    """(domain, category), a domain once for each of its categories. [SRC14, SET7, TOP10]"""
    rows = [(d, k) for k, v in (domains or L.DOMAINS).items() for d in v.split()]
    return spark.createDataFrame(rows, "domain string, category string").distinct()


def domain_categories(domains: DataFrame) -> DataFrame:
    """[AGG27]"""
    return domains.groupBy("category").agg(F.array_sort(F.collect_set("domain")).alias("domains"))


def unvisited(frontier: DataFrame, visited: DataFrame, key: str = "url") -> DataFrame:
    """[FLT2, SRC7, JN17]"""
    return frontier.join(visited.select(key), key, "left_anti")


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """URLs with whether they may be crawled: the longest rule (origin, prefix, allow) that fits decides; none allows. [FLT3]"""
    origin = F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]+)", 1)
    path = _or(F.regexp_replace("url", "^[a-zA-Z]+://[^/?#]+", ""), "/")
    keyed = urls.withColumn("origin", origin).withColumn("_path", path)
    hit = keyed.join(rules, "origin", "left").withColumn("_fits", F.col("_path").startswith(F.col("prefix")))
    decided = hit.groupBy("url").agg(F.max_by(F.when(F.col("_fits"), F.col("allow")), F.when(F.col("_fits"), F.length("prefix"))).alias("allow"))
    return decided.select("url", F.coalesce("allow", F.lit(True)).alias("allowed"))
