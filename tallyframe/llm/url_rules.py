"""Judge URLs by host and path rules found through hashed expressions.

Every URL is expanded into its host suffixes at dots and its path prefixes of
the lengths that rules have. Short prefixes of the expressions' SHA-256 digests
are joined with those of the rules, full digests confirm, and the longest rule
wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage

PREFIX = 8  # hex digits of a digest that the join compares
SPREAD = 64  # parts a rule's key is dealt over, so that one rule may fit most URLs

#: Host, path and verdict of the rules that the query applies (fixed values).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    raw = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expression(host: Column, path: Column) -> Column:
    """One text for a host and a path; a host has no slash, so it tells them apart."""
    return F.sha2(F.concat(host, F.lit(" "), path), 256)


def host_suffixes(host: Column) -> Column:
    """The host and every part of it that follows a dot."""
    labels = F.split(host, "\\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def judged_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict``.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all
    subdomains of it if the path starts with the rule's path. The longest rule
    wins, of equally long ones a blocking one, then the smaller text. A URL that
    no rule fits gets NULL and ``default``; so does a NULL URL or one without
    ``://``, whose host and path are empty. Repeated rows are judged alike; an
    empty table gives no rows. Other columns are not read, whatever their names.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null")
    known = rules.select(
        F.concat("host", "path").alias("rule"), "verdict", F.length("path").alias("path_length"), expression(F.col("host"), F.col("path")).alias("digest")
    ).distinct()
    known = cut_lineage(known)
    urls = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    lengths = known.agg(F.array_sort(F.collect_set("path_length")).alias("lengths"))  # as many as the longest path has characters
    # equal hosts and paths are judged once
    distinct = urls.select("host", "path").where("host != ''").distinct()
    expanded = distinct.withColumn("lengths", lengths.scalar())
    fits = F.filter("lengths", lambda n: n <= F.length("path"))
    expanded = expanded.select("host", "path", F.explode(host_suffixes(F.col("host"))).alias("suffix"), fits.alias("fits"))
    expanded = expanded.select("host", "path", "suffix", F.explode("fits").alias("n")).withColumn("digest", expression(F.col("suffix"), F.expr("substring(path, 1, n)")))
    expanded = expanded.withColumns({"short": F.substring("digest", 1, PREFIX), "part": F.pmod(F.xxhash64("host", "path"), F.lit(SPREAD)).cast("int")})
    dealt = known.withColumns({"short": F.substring("digest", 1, PREFIX), "part": F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))}).withColumnRenamed("digest", "full")
    hits = expanded.join(dealt, ["short", "part"]).where("digest = full")
    rank = F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"))
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("top"), F.collect_set(F.struct("rule", "verdict")).alias("all"))
    chosen = F.array_min(F.filter("all", lambda x: (F.length(x["rule"]) == F.col("top.n")) & ((x["verdict"] == "block") == F.col("top.b"))))
    best = best.select("host", "path", chosen.alias("chosen"))
    out = urls.alias("u").join(best.alias("b"), (F.col("u.host") == F.col("b.host")) & (F.col("u.path") == F.col("b.path")), "left")
    return out.select(
        F.col("u.id").alias(id_col), "u.host", "u.path", F.col("chosen.rule").alias("rule"), F.coalesce("chosen.verdict", F.lit(default)).alias("verdict")
    )
