"""op7: near-duplicate documents and the one that stays of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmere.llm.common import table
from quillmere.llm.near_dedup import near_duplicates


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op7_minhash_near_dedup": op7_minhash_near_dedup}
ORACLE_SQL = {
    "op7_minhash_near_dedup": r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
      FROM documents),
    s AS (
      SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, CAST(len(words) - 3 AS BIGINT)), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh
      FROM w),
    n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n, md5(array_to_string(list_sort(sh), chr(10))) AS d FROM s),
    cls AS (SELECT d, min(doc_id) AS c, any_value(n) AS n FROM n WHERE n > 0 GROUP BY d),
    e AS (SELECT c, unnest(sh) AS x FROM s JOIN cls ON doc_id = c),
    p AS (SELECT a.c AS a, b.c AS b, count(*) AS m FROM e a JOIN e b ON a.x = b.x AND a.c < b.c GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN cls ca ON ca.c = a JOIN cls cb ON cb.c = b WHERE 100 * m >= 75 * (ca.n + cb.n - m)),
    both_ways AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
    reach(node, target) AS (SELECT c, c FROM cls UNION SELECT node, v FROM reach JOIN both_ways ON target = u),
    comp AS (SELECT node, min(target) AS component FROM reach GROUP BY node)
    SELECT n.doc_id, n.n AS n_shingles, coalesce(component, n.doc_id) AS component_id, coalesce(component, n.doc_id) = n.doc_id AS kept
    FROM n LEFT JOIN cls ON n.d = cls.d AND n.n > 0 LEFT JOIN comp ON comp.node = cls.c
    """,
}
