"""Queries that judge documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import license_digests
from tallyframe.llm.catalog import query, table
from tallyframe.llm.license_store import STORED
from tallyframe.llm.quality_rules import quality_rules
from tallyframe.llm.quality_vote import quality


@query("op8_quality_vote")
def quality_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op10_quality_rules",
    r"""
    WITH d AS (
        SELECT doc_id, lang, source, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM documents
    ), win AS (
        SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
    ), rep AS (
        SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p
              FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1)
        GROUP BY doc_id
    ), m AS (
        SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words,
               length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
               length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
               len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
               coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
        FROM d LEFT JOIN rep USING (doc_id)
    ), r AS (
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               coalesce(n_symbols / nullif(word_chars, 0), 0) AS a, coalesce(word_chars / nullif(n_words, 0), 0) AS b,
               coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS c
        FROM m
    ), q AS (
        SELECT grouping(lang, source) AS level, lang, source, count(*) AS n, quantile_disc(n_words, 0.5)::DOUBLE AS m,
               quantile_disc(a, 0.25) AS a1, quantile_disc(a, 0.75) AS a3, quantile_disc(b, 0.25) AS b1,
               quantile_disc(b, 0.75) AS b3, quantile_disc(c, 0.25) AS c1, quantile_disc(c, 0.75) AS c3
        FROM r WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source), (lang), ())
    ), f AS (
        SELECT r.*, own.n AS n1, l.n AS n2,
               [own.m, own.a1, own.a3, own.b1, own.b3, own.c1, own.c3] AS v1, [l.m, l.a1, l.a3, l.b1, l.b3, l.c1, l.c3] AS v2, [e.m, e.a1, e.a3, e.b1, e.b3, e.c1, e.c3] AS v3
        FROM r
        LEFT JOIN q own ON own.level = 0 AND own.lang IS NOT DISTINCT FROM r.lang AND own.source IS NOT DISTINCT FROM r.source
        LEFT JOIN q l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM r.lang
        LEFT JOIN q e ON e.level = 3
    ), g AS (
        SELECT *, CASE WHEN n2 IS NULL THEN v3 ELSE list_transform(list_zip(v2, v3), lambda z: (n2 * z[1] + 50.0::DOUBLE * z[2]) / (n2 + 50.0::DOUBLE)) END AS w2 FROM f
    ), h AS (
        SELECT *, CASE WHEN n1 IS NULL THEN w2 ELSE list_transform(list_zip(v1, w2), lambda z: (n1 * z[1] + 50.0::DOUBLE * z[2]) / (n1 + 50.0::DOUBLE)) END AS v FROM g
    ), x AS (
        SELECT *, word_chars * (v[3] + 3.0::DOUBLE * (v[3] - v[2])) AS signs, n_lines * (v[7] + 3.0::DOUBLE * (v[7] - v[6])) AS again,
               3.0::DOUBLE * ((v[5] - v[4]) * greatest(1.0::DOUBLE, sqrt(v[1] / greatest(n_words, 1))) + 1.0::DOUBLE / sqrt(greatest(n_words, 1)::DOUBLE)) AS reach
        FROM h
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed
           AND n_symbols <= signs + 3.0::DOUBLE * sqrt(signs) + 3.0::DOUBLE
           AND n_dup_lines <= again + 3.0::DOUBLE * sqrt(again) + 3.0::DOUBLE
           AND b BETWEEN v[4] - reach AND v[5] + reach AS kept
    FROM x
    """,
)
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _spelled(text: str) -> str:
    for other, one in license_digests.SPELLINGS:
        text = f"replace({text}, '{other}', '{one}')"
    return text


def _words(text: str) -> str:
    return rf"trim(regexp_replace({_spelled(f'lower({text})')}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _canonical(text: str) -> str:
    return _words(f"regexp_replace(coalesce({text}, ''), '(?i){license_digests.OWNER_LINE}', '', 'g')")


def _body(text: str) -> str:
    """The text from its first opening words on, where only titles and notices precede them."""
    rules = license_digests
    before = rf"regexp_extract({text}, '^([\s\S]*?){rules.OPENING}', 1)"
    parts = rf"list_filter(regexp_split_to_array(regexp_replace({before}, '[.][ \t]', '! ', 'g'), '{rules.PARAGRAPH_END}'), lambda p: regexp_matches(p, '[\p{{L}}\p{{N}}]'))"
    good = f"len(list_filter({parts}, lambda p: NOT regexp_matches(p, '{rules.LEADING}') OR regexp_matches(p, '{rules.NOT_LEADING}'))) = 0"
    return f"CASE WHEN regexp_matches({text}, '{rules.OPENING}') AND {good} THEN {_words(f'substr({text}, length({before}) + 1)')} END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KNOWN = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in license_digests.KNOWN)
_STORED = ", ".join(f"({_quoted(n)}, {_quoted(d)})" for n, d in STORED)


@query(
    "op2_license_digests",
    f"""
    WITH texts AS (
        SELECT name, unnest([{_canonical("body")}, {_words("body")}, {_body("body")}]) AS t FROM (VALUES {_KNOWN}) k(name, body)
    ), known AS (
        SELECT digest, min(name) AS license
        FROM (SELECT name, sha256(t) AS digest FROM texts WHERE t <> '' UNION ALL SELECT name, digest FROM (VALUES {_STORED}) s(name, digest)) GROUP BY 1
    ), d AS (
        SELECT doc_id, {_canonical("text")} AS t, {_words("text")} AS w, {_body("text")} AS b FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    )
    SELECT doc_id, length(t)::BIGINT AS canonical_chars, sha256(t) AS digest, coalesce(x.license, y.license, z.license) AS license
    FROM d LEFT JOIN known x ON sha256(d.t) = x.digest LEFT JOIN known y ON sha256(d.w) = y.digest LEFT JOIN known z ON sha256(d.b) = z.digest
    """,
)
def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(license_digests.KNOWN, "license string, text string")
    stored = spark.createDataFrame(STORED, "license string, digest string")
    return license_digests.license_matches(table(spark, sf_dir, "documents"), known, stored=stored)
