"""Query over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.catalog import query, table
from tallyframe.llm.conversation_trie import ordered_turns, prefix_trie, spliced
from tallyframe.llm.crc_sql import crc32


@query(
    "op11_conversation_trie",
    rf"""
    WITH t AS (
        SELECT conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat_ws(':', length(coalesce(role, '')), coalesce(role, ''), coalesce(text, '')))) AS i
        FROM conversations WHERE conv_id IS NOT NULL
    ), c AS (
        SELECT conv_id, list(x ORDER BY i) AS own FROM t GROUP BY conv_id
    ), r AS (
        SELECT c.conv_id, coalesce(b.own, [])[:h] || c.own[h + 1:] AS s
        FROM (SELECT *, {crc32("conv_id::VARCHAR")} % 4 AS h FROM c) c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20
    ), p AS (
        SELECT conv_id, unnest(range(len(s) + 1)) AS depth, s FROM r
    ), n AS (
        SELECT s[:depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
               (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(s[depth].t), '[^\x20\x09-\x0D]+')) END AS own,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(s) = depth), '')) AS ends_sha256
        FROM p GROUP BY k, depth
    ), kids AS (
        SELECT k[:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
    ), m AS (
        SELECT n.*, coalesce(kids.n_children, 0) AS n_children FROM n LEFT JOIN kids ON n.k = kids.k
    ), below AS (
        SELECT k[:d] AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens
        FROM (SELECT k, own, n_children, unnest(range(depth + 1)) AS d FROM m) GROUP BY 1
    )
    SELECT m.conv_id, m.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, b.n_leaves, b.saved_tokens, m.ends_sha256
    FROM m JOIN below b ON m.k = b.k LEFT JOIN n u ON m.depth > 0 AND u.depth = m.depth - 1 AND u.k = m.k[:m.depth - 1]
    """,
)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    turns = ordered_turns(table(spark, sf_dir, "conversations"))
    head = F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(4))
    rebuilt, all_ids = spliced(turns, base=conv - conv % 20, head=head, longest=3)
    return prefix_trie(rebuilt, all_ids)
