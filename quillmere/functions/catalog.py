"""What SQL gets beside Spark's own functions: scalar SQL functions in the session's catalogue, and a table function of tokens.

    register(spark)
    spark.sql("SELECT doc_id, t.token FROM documents, LATERAL tokenize(text) t")
    spark.sql("SELECT bm25(tf, dl, 100, df, 5000) FROM postings")

The scalar functions are SQL themselves, so the optimizer puts their expressions into the plan; only ``tokenize`` and the compound
splitters run in Python, by Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import lexicon as L
from quillmere.session import ship_package
from quillmere.shared import durable

#: A run of letters, digits and underscores, hyphenated ones whole, as the column function takes it.
_TOKEN = re.compile(r"\w+(?:-\w+)*")


class Tokenize:
    """(position, token) of a text, position from 0; a null text has none."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(_TOKEN.findall(text.lower()))


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _authority() -> str:
    exact = " ".join(f"WHEN domain = {_quote(k)} THEN {v}D" for k, v in L.AUTHORITY.items())
    suffix = " ".join(f"WHEN endswith(domain, {_quote(k)}) THEN {v}D" for k, v in L.AUTHORITY.items())
    return f"CASE {exact} {suffix} ELSE 1.0D END"


def definitions() -> dict[str, str]:
    """Signature and body of each scalar function, by name."""
    stop = ", ".join(_quote(w) for w in L.STOPWORDS)
    return {
        "idf_smooth": "(n DOUBLE, df DOUBLE) RETURNS DOUBLE RETURN ln((n + 1) / (df + 1)) + 1",
        "idf_relational": "(n DOUBLE, df DOUBLE) RETURNS DOUBLE RETURN ln((n + 1) / (df + 1))",
        "bm25": """(tf DOUBLE, dl DOUBLE, avgdl DOUBLE, df DOUBLE, n DOUBLE, k1 DOUBLE DEFAULT 1.5D, b DOUBLE DEFAULT 0.75D) RETURNS DOUBLE
            RETURN ln((n - df + 0.5D) / (df + 0.5D) + 1) * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / avgdl))""",
        "authority": f"(domain STRING) RETURNS DOUBLE RETURN {_authority()}",
        "recency": f"""(moment TIMESTAMP, as_of TIMESTAMP) RETURNS DOUBLE
            RETURN coalesce(exp(-floor((unix_seconds(as_of) - unix_seconds(moment)) / 86400) / {float(L.DECAY_DAYS)}D), 0.5D)""",
        "is_term": f"""(token STRING) RETURNS BOOLEAN
            RETURN length(token) BETWEEN {L.MIN_WORD} AND {L.MAX_WORD} AND token RLIKE '[a-zåäöÅÄÖ]' AND lower(token) NOT IN ({stop})""",
    }


def register(spark: SparkSession) -> list[str]:
    """Puts the functions into the session's catalogue (temporary, replacing those of the same name) and gives their names."""
    from quillmere.functions import swedish

    ship_package(spark)
    for name, text in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{text}")
    spark.udtf.register("tokenize", F.udtf(Tokenize, returnType="position int, token string", useArrow=True))
    for name, udf in swedish.registered().items():
        spark.udf.register(name, udf)
    return [*definitions(), "tokenize", *swedish.registered()]


#: What a search by ``{asked}`` (query_id, term) needs of ``{documents}`` (doc_id, text): of each document how often it has a term that is asked for, and under no term
#: how many others it has. Few rows a document, so that no task holds all terms of its documents. ``docs``: the documents of that id, in its row without a term.
COUNTED = """
WITH docs AS (SELECT max(doc_id) AS doc_id, any_value(text) AS text FROM {documents} GROUP BY md5(text)),
tok AS (SELECT doc_id, t.token AS token FROM docs, LATERAL tokenize(text) t WHERE is_term(t.token) UNION ALL SELECT doc_id, NULL FROM docs),
wanted AS (SELECT DISTINCT term FROM {asked})
SELECT doc_id, term, count(token) AS tf, count(*) - count(token) AS docs FROM tok LEFT JOIN wanted ON token = term GROUP BY doc_id, term
"""

#: The best ``{limit}`` documents of each row's query in ``{asked}`` (query_id, term) by BM25 over what was ``{counted}`` for it.
SEARCH = """
WITH n AS (SELECT sum(docs) AS n FROM {counted}),
dl AS (SELECT doc_id, sum(tf) AS dl FROM {counted} GROUP BY doc_id HAVING sum(tf) > 0),
mean AS (SELECT avg(dl) AS avgdl FROM dl),
hit AS (SELECT query_id, q.term, doc_id, tf FROM {counted} p JOIN {asked} q ON p.term = q.term),
df AS (SELECT term, count(*) AS df FROM {counted} WHERE term IS NOT NULL GROUP BY term),
scored AS (
  SELECT query_id, hit.doc_id, sum(bm25(tf, dl, avgdl, df, n)) AS score
  FROM hit JOIN df ON hit.term = df.term JOIN dl ON hit.doc_id = dl.doc_id CROSS JOIN n CROSS JOIN mean GROUP BY query_id, hit.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= {limit}
"""


def search(spark: SparkSession, documents: DataFrame, asked: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank) in SQL alone, after ``register``. What is counted is kept in the shared folder, so texts are read once."""
    counted = durable(spark.sql(COUNTED, documents=documents, asked=asked))
    return spark.sql(SEARCH, counted=counted, asked=asked, limit=limit)
