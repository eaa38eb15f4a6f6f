"""Queries over web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm.catalog import query, table
from tallyframe.llm.page_text import main_text
from tallyframe.llm.url_rules import RULES, judged_urls
from tallyframe.llm.warc import archived_pages


@query(
    "op5_url_rules",
    r"""
    WITH u AS (
        SELECT page_id,
               coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages
    ), r AS (
        SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                              ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) t(h, p, v)
    ), j AS (
        SELECT u.*, h, p, v, row_number() OVER (PARTITION BY u.rid ORDER BY length(h || p) DESC NULLS LAST) AS n
        FROM (SELECT *, row_number() OVER () AS rid FROM u) u
        LEFT JOIN r ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)
    )
    SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict FROM j WHERE n = 1
    """,
)
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judged_urls(table(spark, sf_dir, "pages"), rules)


@query(
    "op6_warc_archives",
    """
    WITH p AS (
        SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
    ), k AS (
        SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM p
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> keeper THEN keeper END AS refers_to
    FROM k
    """,
)
def warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


@query("op4_main_text")
def page_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
