"""Known licences, found by the digest of their canonical text, whatever its line width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that the SQL check deletes where the operator applies ``without_notices``, whose pattern looks ahead. They
#: include any line that begins with "copyright", which on the given tables is no line of a licence body.
OWNER_LINE = r"(?m)^[ \t/*#;>-]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$"

#: Words with which licence texts open, and with which a notice before them ends (fixed values).
OPENINGS = (
    "permission is hereby granted",
    "permission to use",
    "redistribution and use in source and binary forms",
    "everyone is permitted to copy",
    "licensed under",
    "this software is provided",
    "this program is free software",
    "this library is free software",
)
_GAP = r"[\s/*#;>-]"
_OPENING = "(?i:" + "|".join(rf"{_GAP}+".join(o.split()) for o in OPENINGS) + r")\b"
_SIGN = r"(?:\(c\)|©|(?:19|20)\d\d\b|[<\[{])"
#: Words that follow "copyright" in licence bodies and in titles, and so begin no name (fixed values).
_NO_NAME = "holders?|owners?|notices?|laws?|licen[sc]es?|acts?|and|or|in|on|of|to|is|for|the|statements?|interests?|protection|treaty|rights?|related|office|information|infringement|status|term"
#: "copyright" with a sign, a year or a name, or a sign with a year or a name; "(c) You must" of a list is none.
_NOTICE = (
    rf"(?:(?i:copyright[ \t:,]*(?:by[ \t]+)?{_SIGN}|\(c\)[ \t]*(?:copyright\b|(?:19|20)\d\d\b|[<\[{{])|©)"
    rf"|(?i:copyright)[ \t:]+(?:(?i:by)[ \t]+)?(?:[Tt]he[ \t]+)?(?!(?i:{_NO_NAME})\b)\p{{Lu}}\p{{L}}*\p{{Ll}}"
    r"|(?i:\(c\))[ \t]+\p{Lu}\p{L}*\p{Ll}\p{L}*[ \t]+\p{Lu})"
)
_DECOR = r"[ \t/*#;>-]*+"
_TITLE = r"(?:(?:[\p{L}\d.-]++[ \t]++){0,5}?(?i:licen[sc]e)\b[ \t:.]*+(?:\([^)\n]{0,40}\)[ \t:]*+)?)?"
#: A notice at the start of a line or after a title. It runs up to the opening of a licence text in or after its
#: paragraph, as far as 400 characters are a notice, else to the end of its line.
OWNER_NOTICE = rf"(?m)^({_DECOR}{_TITLE}){_NOTICE}(?:(?:(?!\n[ \t/*#;>-]*\n)[\s\S]){{0,400}}?(?={_GAP}*{_OPENING})|[^\n]*)"
#: Reserved rights that fill a line or stand before a licence text.
RESERVED = rf"(?m)^{_DECOR}(?i:all[ \t]+rights[ \t]+reserved)\b[ \t.,!*/#]*(?=\n|\z|{_OPENING})"

#: What may stand before the opening of a licence in a text that is this licence as a whole: paragraphs of a title, a
#: notice, or both, however long. Both patterns are plain enough for any regular expression engine.
OPENING = _OPENING
PARAGRAPH_END = r"\n[ \t/*#;>-]*\n"
_LEAD = r"^[\s/*#;>-]*(?:[^\n!?;,]*\b(?i:licen[sc]e)\b[ \t:.]*(?:\([^)\n]*\))?[\s/*#;>:.-]*)?"
LEADING = _LEAD + r"(?:(?i:copyright|\(c\)|©|all[ \t]+rights[ \t]+reserved)[\s\S]*)?\z"
NOT_LEADING = _LEAD + rf"(?i:copyright)[ \t]+(?i:{_NO_NAME})\b"

#: Equivalent spellings; the first form becomes the second (fixed values).
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("modernise", "modernize"),
    ("noncommercial", "non-commercial"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("http://", "https://"),
)

#: Public licence texts (fixed values).
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
KNOWN = (
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", MIT),
    ("ISC", "ISC License\n\n" + ISC),
    ("ISC", ISC),
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
)


def without_notices(text: Column) -> Column:
    """The text without owner notices and lines that only reserve rights."""
    bare = F.regexp_replace(F.regexp_replace(text, OWNER_NOTICE, "$1"), RESERVED, "")
    return F.when(text.rlike(r"(?i)copyright|\(c\)|©|all[ \t]+rights"), bare).otherwise(text)


def words_alone(text: Column) -> Column:
    """Lower case, one spelling, and one space for all that is neither letter nor digit."""
    text = F.lower(text)
    for other, one in SPELLINGS:
        text = F.replace(text, F.lit(other), F.lit(one))
    return F.trim(F.regexp_replace(text, "[^\\p{L}\\p{N}]+", " "))


def from_opening(text: Column) -> Column:
    """The text from its first opening words on, if only titles and notices stand before them; else NULL.

    A full stop inside a line ends what can be a title.
    """
    at = F.regexp_instr(text, F.lit(f"({OPENING})"))
    before = F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"[.][ \t]", "! ")
    parts = F.filter(F.split(before, PARAGRAPH_END, -1), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    only = F.forall(parts, lambda p: p.rlike(LEADING) & ~p.rlike(NOT_LEADING))
    return F.when((at > 0) & only, F.substring(text, at, F.length(text)))


def canonical_forms(rows: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """``keep`` with ``t``, the canonical text without owner notices, ``full``, the one with them, and ``body``.

    Line ends decide what is a notice, but not what ``full`` is: a licence whose
    own words look like a notice in some line width is still found by it. ``body``
    is what follows titles and notices of any length, NULL if other words precede.
    """
    rows = rows.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumns({"_bare": without_notices(F.col("_text")), "_body": from_opening(F.col("_text"))})
    rows = rows.select(*keep, "_text", "_body", (F.col("_bare") == F.col("_text")).alias("_same"), words_alone(F.col("_bare")).alias("t"))
    full = F.when(F.col("_same"), F.col("t")).otherwise(words_alone(F.col("_text"))).alias("full")
    return rows.select(*keep, "t", full, words_alone(F.col("_body")).alias("body"))


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known_digests(known: DataFrame) -> DataFrame:
    """``license, digest`` of texts with owner notices and without them."""
    texts = canonical_forms(known.where("license is not null"), "text", "license")
    texts = texts.select("license", F.explode(F.array_distinct(F.array("t", "full", "body"))).alias("t")).where("t != ''")
    return texts.select("license", _sha256(F.col("t")).alias("digest"))


def license_matches(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: DataFrame | None = None) -> DataFrame:
    """One row per document: ``doc_id, canonical_chars, digest, license``.

    ``known`` has ``license, text``, ``stored`` has ``license, digest`` as
    ``known_digests`` gives them; of licences with one canonical text the
    smallest name counts, and a text without letters and digits none.
    ``license`` is NULL for documents that are no known licence as a whole, be
    it with owner notices or without them. The digest is of the text without
    them. A NULL text is empty. Repeated rows match alike; an empty table gives
    no rows. Other columns are not read, whatever their names.
    """
    digests = known_digests(known)
    if stored is not None:
        digests = digests.unionByName(stored.where("license is not null"))
    digests = digests.groupBy(F.col("digest").alias("known")).agg(F.min("license").alias("license"))
    rows = canonical_forms(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "id")
    rows = rows.select("id", F.length("t").cast("bigint").alias("canonical_chars"), _sha256(F.col("t")).alias("digest"), _sha256(F.col("full")).alias("full"), _sha256(F.col("body")).alias("body"))
    rows = rows.join(digests.withColumnRenamed("license", "bare_license"), F.col("digest") == F.col("known"), "left").drop("known")
    rows = rows.join(digests.withColumnRenamed("license", "full_license"), F.col("full") == F.col("known"), "left").drop("known")
    rows = rows.join(digests, F.col("body") == F.col("known"), "left")
    return rows.select(F.col("id").alias(id_col), "canonical_chars", "digest", F.coalesce("bare_license", "full_license", "license").alias("license"))
