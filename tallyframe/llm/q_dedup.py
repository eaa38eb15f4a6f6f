"""Queries that find copies of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm.catalog import query, table
from tallyframe.llm.exact_dedup import exact_groups
from tallyframe.llm.ngram_join import near_duplicates


@query("op9_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op7_exact_dedup",
    r"""
    WITH t AS (
        SELECT doc_id, coalesce(length(text), 0) AS points,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare
        FROM documents
    )
    SELECT doc_id,
           first_value(doc_id) OVER w AS keep_id,
           count(*) OVER (PARTITION BY bare) AS group_size,
           row_number() OVER w = 1 AS kept,
           sha256(bare) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY bare ORDER BY points DESC, doc_id)
    """,
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))
