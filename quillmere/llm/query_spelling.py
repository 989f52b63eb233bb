"""op13: spelling variants of the words of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.common import table
from quillmere.llm.spelling import LEAST_COUNT, LEAST_LENGTH, TIMES, planted, runs, spelling_variants, word_counts


def counted_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the documents' runs after the planted deletions. A deletion makes a run shorter only, so short runs go first."""
    found = docs.select("doc_id", F.explode(runs(F.col("text"))).alias("run")).where(F.length("run") >= LEAST_LENGTH)
    return word_counts(found.select(planted(F.col("doc_id").cast("long"), F.col("run")).alias("word")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(counted_words(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
#: The checksum is worked out byte by byte from a table of 256 remainders; near words meet on what is left when one code point is deleted (at the same place in both, or in the longer one).
ORACLE_SQL = {
    "op13_spelling_variants": rf"""
    WITH RECURSIVE bits(v, c, k) AS (
      SELECT v, v, 0 FROM range(256) AS t(v) UNION ALL SELECT v, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
    crc AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
    r AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
    d AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= {LEAST_LENGTH} GROUP BY 1, 2),
    b AS (
      SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
        lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END)) AS bytes FROM d),
    h AS (
      SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(bytes, lambda y: CAST(y AS BIGINT))),
        lambda a, y: xor(a // 256, t[xor(a % 256, y) + 1])), CAST(4294967295 AS BIGINT)) AS h FROM b, crc),
    p AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h),
    w AS (SELECT word, sum(n) AS n FROM p WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT}),
    cut AS (SELECT word, n, i, left(word, CAST(i - 1 AS INTEGER)) || substring(word, CAST(i + 1 AS INTEGER)) AS k FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
    pairs AS (
      SELECT a.word AS word, b.word AS other FROM cut a JOIN cut b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
      UNION SELECT k, cut.word FROM cut JOIN w ON k = w.word UNION SELECT cut.word, k FROM cut JOIN w ON k = w.word),
    near AS (SELECT pairs.word, other, w.n AS m FROM pairs JOIN w ON other = w.word),
    best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM near GROUP BY 1),
    f AS (SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * w.n THEN other END AS form, CASE WHEN m >= {TIMES} * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
    chain(word, here, depth) AS (SELECT word, word, 0 FROM f UNION ALL SELECT chain.word, f.form, depth + 1 FROM chain JOIN f ON f.word = chain.here WHERE f.form IS NOT NULL),
    ends AS (SELECT word, arg_max(here, depth) AS root FROM chain GROUP BY 1)
    SELECT word, form, root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN ends USING (word)
    """,
}
