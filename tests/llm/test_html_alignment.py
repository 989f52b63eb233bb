"""op11 and op12 against brute force and models."""

import hashlib
import random
from collections import Counter
from html import escape

import numpy as np
import pytest

from quillmere.llm import html_extract
from quillmere.llm.alignment import Aligner, align_tokens
from quillmere.llm.html_extract import extract_pages, host_paths, main_text
from quillmere.llm.vocabularies import vocabulary_path

A, B = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "é", "▁", "<s>", "<|endoftext|>", "　", "中", "😀", "'s", "1", "\x00", "\x1c", " ", "​", "ﬁ", "word", "Ing", ". ", "-", "᠎", "\r\n", "<0x41>"]


def brute(aligner: Aligner, text: str | None):
    """Groups and links of one text, token by token."""
    if not text:
        return [], [], [], []
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    a_bytes, b_bytes = [aligner.a_bytes[x] for x in a], [aligner.b_bytes[x] for x in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return [], [], [], []
    spans = lambda parts: [(sum(map(len, parts[:i])), sum(map(len, parts[: i + 1]))) for i in range(len(parts))]
    x, y = spans(a_bytes), spans(b_bytes)
    links = [(p, q) for i, p in enumerate(a) for j, q in enumerate(b) if x[i][0] < y[j][1] and y[j][0] < x[i][1]]
    cuts = sorted({e for _, e in x} & {e for _, e in y})
    groups = [",".join(str(p) for i, p in enumerate(a) if low < x[i][1] <= high) + "|" + ",".join(str(q) for j, q in enumerate(b) if low < y[j][1] <= high) for low, high in zip([0, *cuts], cuts)]
    return a, b, groups, links


@pytest.mark.parametrize("mapped", [True, False])
def test_alignment_equals_brute_force(spark, mapped):
    rng = random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(0, 14))) for _ in range(300)] + [None, "", " ", "the cat sat", "the cat sat", "x" * 300, "one two  three\n\nfour"]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, "the cat", "x"), (3, "again", "x")]
    aligner = Aligner(A, B)
    whole = [brute(aligner, t) for _, t, _ in rows]
    counts = Counter(link for _, _, _, links in whole for link in links)
    best = {}
    for (_, q), n in counts.items():
        best[q] = max(best.get(q, 0), n)
    want = Counter()
    for (doc, _, _), (a, b, groups, links) in zip(rows, whole):
        n_best = sum(counts[x] == best[x[1]] for x in links)
        want[doc, len(a), len(b), len(groups), len(links), n_best, sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""] += 1
    assert sum(1 for a, *_ in whole if not a) > 5 and sum(1 for a, *_ in whole if a) > 100
    got = align_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(5), A, B, mapped)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_whole_texts_without_cuts_give_the_same():
    cut, whole = Aligner(A, B), Aligner(A, B)
    whole.cut = whole.fine = False
    rng = random.Random(4)
    assert cut.cut and cut.fine
    for _ in range(3000):
        text = "".join(rng.choices(PARTS, k=rng.randrange(0, 20)))
        x, y = cut.text(text), whole.text(text)
        assert x[:4] == y[:4] and Counter(x[4].tolist()) == Counter(y[4].tolist())


def test_no_documents(spark):
    assert align_tokens(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    assert align_tokens(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B).first().groups_sha256 == ""


NAV = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
LAYOUTS = {
    "article.se": lambda body: f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>'</script></head><body>{NAV}<div class=ad>buy</div><article>{body}</article><footer>&copy; f</footer>",
    "div.se": lambda body: f"<html><body><div id='top-menu'><a href=/>x</a></div><div class='row'><div class='post-{random.Random(body).randrange(99)}'>{body}</div><div class=sidebar><p>{'side text ' * 40}</p></div></div><section id=comments><p>{'first! ' * 90}</p></section></body></html>",
    "main.se": lambda body: f"<body class='has-sidebar'><header><h1>Site</h1></header><main>{body}<form><input><p>your name</p></form><aside>more</aside></main><div class='cookie-notice'>ok?</div></body>",
}


def page(rng):
    blocks, lines = [], []
    for _ in range(rng.randrange(1, 6)):
        words = [rng.choice(["one", "two & three", "é<x>", "four", "five"]) for _ in range(rng.randrange(6, 30))]
        text = " ".join(words)
        lines.append(" ".join(text.split()))
        marked = escape(text).replace("four", "<b>four</b>").replace("five", "<i>five", 1)
        blocks.append(rng.choice(["<p>{}</p>", "<h2>{}</h2>", "<div>{}</div>", "<p>{}<!-- c --></p>", "<blockquote><p>{}</blockquote>"]).format(marked.replace(" ", rng.choice([" ", "\n ", "<br>"]), 1)))
    return "".join(blocks), "\n".join(lines)


def test_extraction_of_planted_pages(spark):
    rng, rows, want = random.Random(9), [], {}
    for k in range(120):
        host = rng.choice(list(LAYOUTS))
        body, text = page(rng)
        rows.append((k, f"https://{host}/{k}", LAYOUTS[host](body), "x"))
        want[k] = text
    odd = {200: None, 201: "", 202: "<p>just this", 203: NAV, 204: "<article>no host here</article>"}
    rows += [(k, None if k == 204 else "https://odd.se/", h, "x") for k, h in odd.items()]
    want |= {200: "", 201: "", 202: "just this", 203: "", 204: "no host here"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in extract_pages(pages).select("row.page_id", "text").collect()}
    assert got == want


def test_hosts_vote(spark, monkeypatch):
    """A page on which a long aside would win by itself is read on its host's path."""
    usual = "<body><div class='story'><p>" + "text " * 60 + "</p></div><div class='extra'><p>short</p></div></body>"
    odd = "<body><div class='story'><p>brief news</p></div><div class='extra'><p>" + "long " * 90 + "</p></div></body>"
    rows = [(k, "http://h.se/", usual) for k in range(9)] + [(9, "http://h.se/x", odd)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    winners = host_paths(pages).collect()
    assert [(w.path, w.votes) for r in winners for w in r.winners] == [("body>div.story", 9), ("body>div.extra", 1)]
    assert main_text(odd, None).startswith("long")
    for most in (100_000, -1):
        monkeypatch.setattr(html_extract, "BROADCAST_HOSTS", most)
        got = {r.page_id: r.text for r in extract_pages(pages).select("row.page_id", "text").collect()}
        assert got[9] == "brief news" and len(got) == 10
    assert extract_pages(pages.limit(0)).count() == 0


def test_lengths_are_whole():
    body = "<p>" + "w " * 200_000 + "</p>"
    assert len(main_text(f"<article>{body * 2}</article>", None)) == 2 * 399_999 + 1
    assert np.array([len(main_text("<div>" * 3000 + "deep" + "</div>" * 3000, None))]) == 4
