"""Query that drops lines which many documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.catalog import query, table
from tallyframe.llm.line_dedup import cleaned_documents, empty_index, insert_documents


@query(
    "op13_line_dedup",
    r"""
    WITH lines AS (
        SELECT row, doc_id, i, line,
               translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT row, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
              FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
    ), blocked AS (
        SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10
    )
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(b.key) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b.key IS NULL), '')) AS kept_sha256
    FROM lines l LEFT JOIN blocked b ON l.key = b.key GROUP BY row
    """,
)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = insert_documents(empty_index(spark, min_docs=10, min_chars=1), docs)
    cleaned = cleaned_documents(index, docs)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
