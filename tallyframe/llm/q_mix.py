"""Query that mixes sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.catalog import query, table
from tallyframe.llm.mixing import mixed_sizes


@query(
    "op3_source_mix",
    r"""
    WITH d AS (
        SELECT doc_id, source,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
               length(text) AS chars,
               length(regexp_replace(text, '[^!-/:-@\[-`{-~]+', '', 'g')) AS signs,
               (CAST(concat('0x', substr(md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 12)) AS BIGINT) + 0.5::DOUBLE)
                   / 281474976710656.0::DOUBLE AS u
        FROM documents
    ), k AS (
        SELECT *, -ln(u) / coalesce(0.1::DOUBLE + 0.9::DOUBLE * (chars - signs) / nullif(chars, 0), 0.1::DOUBLE) AS draw FROM d
    ), s AS (
        SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
    ), w AS (
        SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s
    ), l AS (
        SELECT *, cap / weight AS level,
               (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS share
        FROM w WINDOW b AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), t AS (
        SELECT source, source_size,
               CASE WHEN level <= share THEN CAST(cap AS DOUBLE)
                    ELSE weight * (SELECT arg_min(share, level) FROM l WHERE level > share) END AS target
        FROM l
    ), e AS (
        SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
    ), r AS (
        SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
               e.target - e.epochs * e.source_size
                   - coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.draw, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under
        FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
    )
    SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
           (size * (epochs + CASE WHEN under > 0 AND under >= size / 2 THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM r
    """,
)
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixed_sizes(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")
