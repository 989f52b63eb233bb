"""A small reader of HTML: tags on a stack, texts in page order with the block each stands in.

One pass over the page, for use inside an Arrow function. It follows the rules that matter for text: elements without
content, elements whose content is no markup, end tags that are left out (``p``, ``li``, table cells, ...), references decoded in
texts and attribute values. Whatever a page holds, it gives a tree: stray end tags are passed over, what is not closed ends
with what it stands in.
"""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag. Of the second set references are decoded.
RAW, DECODED = frozenset("script style iframe noembed noframes xmp".split()), frozenset(["title", "textarea"])
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre script search section select style summary table tbody td
    template textarea tfoot th thead title tr ul""".split()
)
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: An element that ends where one of these begins, unless one of the others stands between.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
    "body": (("head",), ()),
}
#: No end tag reaches beyond these, other than their own.
_SCOPES = frozenset("table td th caption template object".split())

_TAG = re.compile(r"<!--(?:-?>|.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>][^\s=/>]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")


def attributes(raw: str) -> dict[str, str]:
    """Names in lower case and decoded values; of a repeated name the first."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), unescape(next((v for v in values if v), "")))
    return found


class Page:
    """The tree of a page. Node 0 is the page; ``tags``, ``parents`` and ``attrs`` (as written) are by node, in page order.

    ``texts`` has (node, block, text) in page order, references decoded. Two texts of one ``block`` have no begin or end of a block between them.
    """

    def __init__(self, html: str | None):
        self.tags, self.parents, self.attrs = ["#page"], [-1], [""]
        self.texts: list[tuple[int, int, str]] = []
        self._open, self._block = [0], 0
        self._read((html or "").replace("\0", ""))

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        for tag in iter(lambda: _TAG.search(html, at), None):
            if tag.start() > at:
                self._text(html[at : tag.start()])
            at = tag.end()
            name = tag.group(2)
            if not name:
                continue
            name = name.lower()
            if tag.group(1):
                self._close(name)
                continue
            self._start(name, tag.group(3) or "")
            if name in RAW or name in DECODED:
                stop = re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I).search(html, at)
                stop = stop.start() if stop else end
                self._text(html[at:stop], name in DECODED)
                at = stop
                if stop == end:
                    self._close(name)
        if at < end:
            self._text(html[at:])

    def _text(self, text: str, decode: bool = True) -> None:
        if text:
            self.texts.append((self._open[-1], self._block, unescape(text) if decode and "&" in text else text))

    def _cut(self, depth: int) -> None:
        """Ends what is open from ``depth`` on."""
        if any(self.tags[x] in BLOCKS for x in self._open[depth:]):
            self._block += 1
        del self._open[depth:]

    def _start(self, name: str, raw: str) -> None:
        tags, open_ = self.tags, self._open
        if name in ("html", "head", "body") and name in (tags[x] for x in open_):
            return
        if name in BLOCKS:
            # A paragraph ends where another block begins.
            for depth in range(len(open_) - 1, 0, -1):
                if tags[open_[depth]] in BLOCKS:
                    if tags[open_[depth]] == "p":
                        self._cut(depth)
                    break
        if name in _ENDS:
            ended, limits = _ENDS[name]
            first = None
            for depth in range(len(open_) - 1, 0, -1):
                if tags[open_[depth]] in limits:
                    break
                if tags[open_[depth]] in ended:
                    first = depth
            if first:
                self._cut(first)
        if name in BLOCKS:
            self._block += 1
        self.tags.append(name)
        self.parents.append(open_[-1])
        self.attrs.append(raw)
        if name not in VOID:
            open_.append(len(self.tags) - 1)
        elif name == "br":
            self.texts.append((len(self.tags) - 1, self._block, "\n"))

    def _close(self, name: str) -> None:
        tags, open_ = self.tags, self._open
        block = name in BLOCKS
        for depth in range(len(open_) - 1, 0, -1):
            tag = tags[open_[depth]]
            if tag == name or (name in HEADINGS and tag in HEADINGS):
                return self._cut(depth)
            if (tag in BLOCKS and not block) or tag in _SCOPES or (name == "p" and tag in BLOCKS):
                return None
        return None

    def first(self, test) -> int | None:
        """The first node for which ``test(node)`` holds."""
        return next((node for node in range(1, len(self.tags)) if test(node)), None)

    def inside(self, top: int) -> list[bool]:
        """By node, whether it is ``top`` or stands in it."""
        found = [False] * len(self.tags)
        found[top] = True
        for node in range(top + 1, len(self.tags)):
            found[node] = found[self.parents[node]]
        return found

    def without(self, names) -> list[bool]:
        """By node, whether it stands outside all elements of these names."""
        found = [True] * len(self.tags)
        for node in range(1, len(self.tags)):
            found[node] = found[self.parents[node]] and self.tags[node] not in names
        return found
