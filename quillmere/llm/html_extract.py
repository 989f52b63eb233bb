"""Main texts of pages by consensus of their host: containers are scored page by page, paths are voted on, pages are read again.

1. Each page's containers (body, main, article, section, div, td, ...) are scored by the text they hold that is neither in links nor in
   parts that no article has (menus, headers, footers, sidebars, notices, adverts, forms, comments), the smallest one that holds it winning.
   The page votes for the generalised path of its best container: tags and classes from the root, digits written as one sign, ids left out.
2. Spark adds up the votes of each host; paths with a twentieth of a host's votes win, twenty at most.
3. Each page is read again: the elements on the host's most voted path that the page has and that hold text give its text; a page without
   any such path, or without a host, is taken by its own best container.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions.html import HEADINGS, Page, attributes
from quillmere.llm.common import bound_batches, durable, whole_row

#: A path wins with one vote in so many of its host's, so no more than so many win.
SHARE = 20
#: Hosts whose winning paths are broadcast, at most ``SHARE`` numbers each; more are joined, hosts with a hundredth of all pages in parts.
BROADCAST_HOSTS, HOT_SHARE, PARTS = 100_000, 100, 64
#: Steps of a path that are written out; longer ones are told apart by their hash only.
STEPS = 32

CONTAINERS = frozenset("body main article section div td center blockquote details dd li table".split())
#: Elements that are no part of an article, and roles and words of classes and ids that say so.
DROPPED = frozenset("nav footer aside form script style noscript template iframe noembed noframes xmp object select textarea button dialog menu head title search svg math canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promoted promotion promotions banner banners
    cookie cookies consent gdpr notice notices alert alerts disclaimer newsletter subscribe subscription signup popup modal overlay lightbox sidebar sidebars
    sidenav rail nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager share sharing social related recommended recommendations trending
    comment comments commentlist disqus respond reply replies discussion footer masthead toolbar widget widgets login search copyright legal taboola outbrain""".split()
)
#: Words of classes that name the article, and words before one of the above that turn it round.
ARTICLE_WORDS = frozenset("article content post entry story main body text".split())
NOT = frozenset("no not non has have with without is".split())
#: Weights of a container's text, in fifths.
WEIGHTS = {"article": 8, "main": 7, "body": 4}
NAMED, PLAIN = 6, 5
#: Characters of an element's attributes up to which what it is is remembered.
LONGEST = 512
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")


def _about(tag: str, raw: str) -> tuple[str, bool, bool, bool]:
    """Of an element as written: its step of a path, whether it is no part of an article, a header, and named as an article's."""
    return _remembered(tag, raw) if len(raw) <= LONGEST else _remembered.__wrapped__(tag, raw)


@lru_cache(maxsize=20_000)
def _remembered(tag: str, raw: str) -> tuple[str, bool, bool, bool]:
    own = attributes(raw) if raw else {}
    classes = own.get("class", "").split()
    step = ".".join([tag, *sorted({_DIGITS.sub("#", c.lower()) for c in classes})])
    words = [[w.lower() for w in _WORD.findall(name)] for name in [*classes, *own.get("id", "").split()]]
    plain = {w for name in words for k, w in enumerate(name) if not (k and name[k - 1] in NOT)}
    role = own.get("role", "").lower()
    hidden = "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", ""), re.I) is not None
    named = tag in ("article", "main") or role in ("main", "article") or own.get("itemprop", "").lower() == "articlebody" or bool(plain & ARTICLE_WORDS)
    comment = bool(plain & {"comment", "comments", "reply", "replies"})
    dropped = hidden or tag in DROPPED or role in ROLES or comment or (tag not in ("html", "body", "main", "article") and bool(plain & WORDS))
    return step, dropped, tag == "header" or "header" in plain, named


class Reading:
    """A page with what each of its nodes is worth: ``kept`` by node, ``key`` (of its path) by node."""

    def __init__(self, html: str | None):
        self.page = page = Page(html)
        n = len(page.tags)
        about = [("#page", False, False, False)] + [_about(page.tags[x], page.attrs[x]) for x in range(1, n)]
        # Whatever an article or main stands in is not dropped for its name.
        holds = [False] * n
        for x in range(n - 1, 0, -1):
            if holds[x] or (page.tags[x] in ("article", "main") and not about[x][1]):
                holds[page.parents[x]] = True
        self.kept, self.linked, self.named, self.key = [True] * n, [False] * n, [False] * n, [0] * n
        self.steps = [a[0] for a in about]
        header = [False] * n
        for x in range(1, n):
            up, tag = page.parents[x], page.tags[x]
            step, dropped, head, named = about[x]
            self.named[x] = self.named[up] or named
            header[x] = header[up] or (head and not holds[x] and tag not in ("body", "main", "article"))
            # Of an article's own header the headings stay; of the page's nothing does.
            stays = not header[x] or (self.named[x] and (header[up] and (tag in HEADINGS or self._in_heading(x))))
            own = not dropped or (holds[x] and tag not in DROPPED)
            self.kept[x] = own and stays and (self.kept[up] or (header[up] and stays and self._kept_above(x, header)))
            self.linked[x] = self.linked[up] or tag == "a"
            self.key[x] = xxhash.xxh3_64_intdigest(step.encode("utf-8", "surrogatepass"), self.key[up]) if tag != "html" else self.key[up]
        self._menus()

    def _in_heading(self, x: int) -> bool:
        page = self.page
        while x > 0 and page.tags[x] not in HEADINGS:
            x = page.parents[x]
        return x > 0

    def _kept_above(self, x: int, header: list[bool]) -> bool:
        """Whether what the header of a heading stands in is kept."""
        while x > 0 and header[x]:
            if self.page.tags[x] in DROPPED:
                return False
            x = self.page.parents[x]
        return self.kept[x]

    def _menus(self) -> None:
        """Lists that hold links and nothing else, three or more and outside anything named as an article's, are menus."""
        page, n = self.page, len(self.page.tags)
        lists = [False] * n
        links, other = [0] * n, [False] * n
        for x in range(1, n):
            lists[x] = page.tags[x] in ("ul", "ol") and not self.named[x]
            links[x] = page.tags[x] == "a"
        for node, _, text in page.texts:
            if not self.linked[node] and text.strip():
                other[node] = True
        for x in range(n - 1, 0, -1):
            links[page.parents[x]] += links[x]
            other[page.parents[x]] |= other[x]
        menu = [False] * n
        for x in range(1, n):
            menu[x] = menu[page.parents[x]] or (lists[x] and links[x] >= 3 and not other[x])
            self.kept[x] = self.kept[x] and not menu[x]

    def best(self) -> tuple[int | None, int]:
        """(node, score) of the container with the best score, the innermost of those; none where there is no text. Node 0 counts as a body."""
        page = self.page
        mass = [0] * len(page.tags)
        for node, _, text in page.texts:
            if self.kept[node]:
                size = len(" ".join(text.split()))
                mass[node] += -size if self.linked[node] else size
        for x in range(len(mass) - 1, 0, -1):
            mass[page.parents[x]] += mass[x]
        score, best = 0, None
        for x, tag in enumerate(page.tags):
            if (x == 0 or tag in CONTAINERS) and self.kept[x] and mass[x] > 0:
                weight = WEIGHTS["body"] if x == 0 else WEIGHTS.get(tag) or (NAMED if self._names_article(x) else PLAIN)
                if mass[x] * weight >= score:
                    score, best = mass[x] * weight, x
        return best, score

    def _names_article(self, x: int) -> bool:
        return self.named[x] and not self.named[self.page.parents[x]]

    def path(self, x: int) -> str:
        steps = []
        while x > 0 and len(steps) < STEPS:
            if self.page.tags[x] != "html":
                steps.append(self.steps[x])
            x = self.page.parents[x]
        return ("..." if x > 0 else "") + ">".join(reversed(steps))

    def on_path(self, key: int) -> list[int]:
        """Outermost kept nodes whose path has this key."""
        taken, parents = [False] * len(self.key), self.page.parents
        found = []
        for x in range(len(self.key)):
            taken[x] = x > 0 and taken[parents[x]]
            if not taken[x] and self.key[x] == key and self.kept[x]:
                taken[x] = True
                found.append(x)
        return found

    def text(self, tops: list[int]) -> str:
        """Kept texts inside ``tops``, one line a block."""
        page, inside = self.page, [False] * len(self.page.tags)
        for x in tops:
            inside[x] = True
        for x in range(1, len(inside)):
            inside[x] = inside[x] or inside[page.parents[x]]
        blocks: dict[int, list[str]] = {}
        for node, block, text in page.texts:
            if inside[node] and self.kept[node]:
                blocks.setdefault(block, []).append(text)
        return "\n".join(line for line in (" ".join("".join(parts).split()) for parts in blocks.values()) if line)


def best_container(html: str | None) -> tuple[int | None, str | None, int]:
    """(key, path, score) of a page's best container; nulls without one."""
    found = Reading(html)
    node, score = found.best()
    return (_signed(found.key[node]), found.path(node), score) if node is not None else (None, None, 0)


def _signed(key: int) -> int:
    return key - (1 << 64) if key >= 1 << 63 else key


def main_text(html: str | None, winners: list[int] | None) -> str:
    """The page's text on the first winning path that holds any, else that of its own best container; empty without one."""
    if not html:
        return ""
    found = Reading(html)
    for key in winners or ():
        text = found.text(found.on_path(key % (1 << 64)))
        if text:
            return text
    node, _ = found.best()
    return found.text([node]) if node is not None else ""


def host_of(url: Column) -> Column:
    """The host in lower case, without what stands before an @ and the port; null where there is none."""
    found = F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#@:]+)", 1)
    return F.lower(F.nullif(found, F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, pages, winners): of each host its number of votes and its winning paths (key, path, votes), most votes first.

    Ties go to the higher sum of scores, then to the smaller key. Pages with a null url, a null html or no text have no vote; no pages give no rows.
    """
    bound_batches(pages.sparkSession)

    def scored(html: pa.Array) -> pa.Array:
        rows = [best_container(x.as_py()) for x in html]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["key", "path", "score"])

    best = F.arrow_udf(scored, "key long, path string, score long").asNondeterministic()(F.col("html").cast("string"))
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").where("host is not null and html is not null").select("host", best.alias("b")).where("b.key is not null")
    counted = durable(votes.groupBy("host", F.col("b.key").alias("key")).agg(F.min("b.path").alias("path"), F.count("*").alias("votes"), F.sum("b.score").alias("score")))
    totals = counted.groupBy("host").agg(F.sum("votes").alias("pages"))
    winning = counted.join(totals, "host").where(F.col("votes") * SHARE >= F.col("pages"))
    best_first = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "key", "path", "votes")))
    listed = winning.groupBy("host").agg(F.max("pages").alias("pages"), best_first.alias("w"))
    return listed.select("host", "pages", F.transform("w", lambda x: F.struct(x["key"].alias("key"), x["path"].alias("path"), x["votes"].alias("votes"))).alias("winners"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(row, text): each row of ``pages`` (url, html, any other columns) as a struct, and the page's main text, one line a block.

    A null or empty html, and a page without an article's text, give an empty text. Rows with a null url or one without a host are read by themselves;
    repeated rows vote and are read each. Very long pages are read whole, one at a time. No pages give no rows.
    """
    paths = durable(host_paths(pages).select(F.col("host").alias("_host"), "pages", F.col("winners.key").alias("winners")))

    def read(html: pa.Array, winners: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py(), w.as_py()) for x, w in zip(html, winners, strict=True)], pa.string())

    rows = pages.select(whole_row(pages).alias("row"), host_of(F.col("url")).alias("_own"))
    if paths.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(paths), F.col("_own") == F.col("_host"), "left")
    else:
        # At most HOT_SHARE hosts have that share of the pages; their rows are dealt out in parts.
        every = paths.agg(F.sum("pages")).first()[0]
        hot = [r[0] for r in paths.where(F.col("pages") * HOT_SHARE >= F.lit(every)).select("_host").collect()]
        parts = F.sequence(F.lit(0), F.when(F.col("_host").isin(hot), F.lit(PARTS - 1)).otherwise(F.lit(0)))
        dealt = paths.withColumn("_part", F.explode(parts))
        part = F.when(F.col("_own").isin(hot), F.pmod(F.xxhash64("row.html"), F.lit(PARTS)).cast("int")).otherwise(F.lit(0))
        joined = rows.withColumn("_at", part).join(dealt, (F.col("_own") == F.col("_host")) & (F.col("_at") == F.col("_part")), "left")
    text = F.arrow_udf(read, "string").asNondeterministic()(F.col("row.html").cast("string"), F.col("winners"))
    return joined.select("row", text.alias("text"))
