"""op2, op6 and op7 against brute force on small documents."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillmere.llm import line_dedup, near_dedup
from quillmere.llm.components import connected_components
from quillmere.llm.line_dedup import drop_frequent_lines
from quillmere.llm.near_dedup import near_duplicates
from quillmere.llm.sharding import assign_shards, write_shards

STRIP = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, n_dropped long, c string")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def kept_lines(rows, least, keep_first=False):
    keys = [[lower(x.strip(STRIP)) for x in (t or "").split("\n")] for _, t in rows]
    df = Counter(k for ks in keys for k in set(ks) if k)
    return [[x for x, k in zip((t or "").split("\n"), ks, strict=True) if not (k and df[k] >= least)] for (_, t), ks in zip(rows, keys, strict=True)]


LINES = ["Alpha beta", " ALPHA BETA\t", "gamma", "Ä line", "ä line", "x", "", "  ", "\x0bdelta\x0c", "Delta"]


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
def test_drop_frequent_lines(spark, broadcast_keys):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choices(LINES, k=rng.randrange(1, 6)) + [f"own {i}"])) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n"), (None, "gamma\nAlpha beta"), (5, rows[5][1]), (63, "z" * 100_000 + "\ngamma")]
    found = drop_frequent_lines(frame(spark, rows), 12, broadcast_keys=broadcast_keys)
    got = Counter((r.row.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect())
    want = Counter((i, "\n".join(k), len((t or "").split("\n")), len((t or "").split("\n")) - len(k)) for (i, t), k in zip(rows, kept_lines(rows, 12), strict=True))
    assert got == want
    assert drop_frequent_lines(frame(spark, rows).limit(0), 10).count() == 0


@pytest.mark.parametrize("broadcast_keys", [1000, 0])
def test_keep_first_keeps_each_line_once(spark, broadcast_keys):
    rows = [(i, f"shared line\nown {i}\nShared line") for i in range(30)]
    found = drop_frequent_lines(frame(spark, rows), 10, keep_first=True, broadcast_keys=broadcast_keys).collect()
    whole = [r for r in found if "hared" in r.text]
    assert len(whole) == 1 and whole[0].n_dropped == 1 and all(r.n_dropped == 2 for r in found if r is not whole[0])


def test_runs_compact_and_settle(spark):
    runs = line_dedup.LineRuns(spark, min_docs=4, fanout=2)
    try:
        for b in range(5):
            rows = [(k, k, 1, (b, False, b * 10 + k)) for k in range(6) if k <= b]
            runs.add(spark.createDataFrame(rows, "h1 long, h2 long, n long, first struct<b:int,u:boolean,d:long>"))
        got = sorted((r.h1, r.first.b, r.first.d) for r in runs.frequent().collect())
    finally:
        runs.close()
    assert got == [(0, 0, 0), (1, 1, 11)]


def brute_components(rows, percent=75):
    sets = {}
    for n, (i, t) in enumerate(rows):
        words = lower(t or "").translate({ord(c): " " for c in STRIP}).split(" ")
        words = [w for w in words if w]
        sets[n] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]
            both = rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]
            if same or (both and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for n in range(len(rows)):
        groups[find(n)].append(n)
    out = Counter()
    for members in groups.values():
        ids = [rows[n][0] for n in members if rows[n][0] is not None]
        for n in members:
            i = rows[n][0]
            component = min(ids) if ids and i is not None else None
            out[(i, len(sets[n]), component, component == i if component is not None else True)] += 1
    return out


def near_rows(seed, n=70):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [rng.choices(words, k=rng.choice([3, 5, 6, 20, 60, 150])) for _ in range(6)]
    rows = [(100, None), (101, ""), (102, " \t\n"), (103, "one two"), (104, "ONE  two"), (105, "one two"), (None, "one two"), (None, None)]
    passage = rng.choices(words, k=40)
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.3:
            text = text + passage
        rows.append((i, " ".join(text)))
    rows += [(3, rows[-1][1]), (3, rows[-1][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates_against_brute_force(spark, seed):
    rows = near_rows(seed)
    got = Counter(tuple(r) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == brute_components(rows)


def test_near_duplicates_without_broadcast_and_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 3000)
    rows = near_rows(7)
    assert Counter(tuple(r) for r in near_duplicates(frame(spark, rows)).collect()) == brute_components(rows)
    assert near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, k) for k in range(100, 130)] + [(None, 3)]
    best = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(60):
        for a, b in edges:
            if a is not None and a != b:
                best[a] = best[b] = min(best[a], best[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == best


def test_shards(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "é" * rng.randrange(0, 60)) for i in range(300)] + [(7, "a" * 20)] * 50 + [(None, "b"), (400, None), (401, "c" * 3000)]
    limit = 600
    got = assign_shards(frame(spark, rows), limit).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((i, len((t or "").encode())) for i, t in rows)
    size, hashes = defaultdict(int), {i: int(hashlib.md5(str(i if i is not None else "").encode()).hexdigest()[:15], 16) for i, _ in rows}
    total = defaultdict(int)
    for i, t in rows:
        for depth in range(61):
            total[depth, hashes[i] >> (60 - depth)] += len((t or "").encode())
    for r in got:
        size[r.depth, r.prefix, r.chunk] += r.n_bytes
        assert r.prefix == hashes[r.doc_id] >> (60 - r.depth)
        if total[60, hashes[r.doc_id]] <= limit:
            assert r.depth == min(d for d in range(61) if total[d, hashes[r.doc_id] >> (60 - d)] <= limit)
    big = {(r.depth, r.prefix, r.chunk) for r in got if r.n_bytes > limit}
    assert all(n <= limit or key in big for key, n in size.items()) and len(big) == 1
    assert assign_shards(frame(spark, rows).limit(0), limit).count() == 0
    docs = frame(spark, [(i, "t" * 50) for i in range(100)] + [(3, "r" * 40)] * 30 + [(None, "n" * 30)] * 3).withColumnRenamed("c", "shard")
    column = write_shards(docs, str(tmp_path / "s"), limit)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert column == "shard_" and back.where("shard = 'x'").count() == 133 and back.groupBy(column).agg(F.sum(F.length("text")).alias("n")).where(f"n > {limit}").count() == 0
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in docs.collect())
