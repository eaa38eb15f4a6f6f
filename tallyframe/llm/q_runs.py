"""Query that finds periodic runs inside documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.catalog import query, table
from tallyframe.llm.crc_sql import crc32
from tallyframe.llm.periodic_runs import periodic_runs

WORD = r"[^\x20\x09-\x0D]+"


def _looped(text: Column, doc_id: Column) -> Column:
    """Of every tenth document by hash, the text whose words from some place on repeat a stretch of the original."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def rewritten(found: Column) -> Column:
        n = F.size(found).cast("bigint")
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("bigint")
        at = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(found, at(i).cast("int"))), " ")

    looped = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, rewritten(w)).otherwise("")), 1)
    return F.when(F.pmod(h, F.lit(10)) == 0, looped).otherwise(text)


@query(
    "op12_periodic_runs",
    rf"""
    WITH d AS (
        SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n, {crc32("doc_id::VARCHAR")} AS h
        FROM documents
    ), e AS (
        SELECT *, (h // 10) % greatest(n, 1) AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM d
    ), w AS (
        SELECT row, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN o[a + (i - a) % p + 1] ELSE o[i + 1] END AS w
        FROM (SELECT *, unnest(range(n)) AS i FROM e)
    ), same AS (
        SELECT x.row, y.i - x.i AS q, x.i
        FROM w x JOIN w y ON x.row = y.row AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
    ), island AS (
        SELECT row, q, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS k, i FROM same
    ), run AS (
        SELECT row, start, length, min(q) AS period
        FROM (SELECT row, q, min(i) AS start, count(*) + q AS length FROM island GROUP BY row, q, k)
        WHERE length >= greatest(24, 3 * q) GROUP BY ALL
    ), best AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM run)
        WHERE place = 1
    ), listed AS (
        SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM run GROUP BY row
    ), kept AS (
        SELECT w.row, string_agg(w.w, ' ' ORDER BY w.i) AS words
        FROM w WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.row = w.row AND w.i >= r.start + r.period AND w.i < r.start + r.length) GROUP BY w.row
    )
    SELECT d.doc_id, coalesce(l.n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
           (1000 * b.length // b.period)::BIGINT AS exponent_milli,
           sha256(coalesce(l.runs, '')) AS runs_sha256, sha256(coalesce(k.words, '')) AS collapsed_sha256
    FROM d LEFT JOIN listed l USING (row) LEFT JOIN best b USING (row) LEFT JOIN kept k USING (row)
    """,
)
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _looped(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs)
    listed = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(listed, lambda r: F.concat(r, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
