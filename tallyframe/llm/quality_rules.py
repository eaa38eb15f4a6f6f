"""Quality rules with thresholds that follow each language and source.

Counts of words, signs, repeated lines and repeated five-word windows are built
from column functions. The rates taken from them are summarised per language
and source by mergeable quantile sketches, and rows are filtered by a join with
the fences that follow from them.

A group's quartiles are drawn towards those of its language, and these towards
those of all rows, by the weight ``n / (n + PRIOR)`` of their rows: one rule for
groups of every size. A rate's fence lies ``SPREAD`` quartile ranges beyond the
quartiles. What a document may hold beyond it follows from its own size: as much
as chance adds to a count expected at the fence, and for the mean word length as
much more spread as its words are fewer than the group's median. No rate has a
cut-off of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage

BLANK = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
WIDTH = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
SPREAD = 3.0  # quartile ranges, and standard deviations of chance, that a value may lie outside
PRIOR = 50.0  # rows' worth of weight of the wider group's quartiles
COUNTS = {"symbol_rate": ("n_symbols", "word_chars"), "dup_line_rate": ("n_dup_lines", "n_lines")}
RATES = (*COUNTS, "mean_word")
ACCURACY = 10_000  # of the sketches: ranks are off by at most one in so many


def repeated_words(docs: DataFrame, words: str, name: str) -> DataFrame:
    """Add the number of words that lie in five-word windows found twice or more."""
    at = lambda a, k: F.get(F.col(a), k)
    docs = docs.withColumn("_hash", F.transform(words, lambda w: F.xxhash64(w)))
    window = lambda i: F.xxhash64(*[at("_hash", i + k) for k in range(WIDTH)])
    n = F.size("_hash")
    empty = F.expr("cast(array() as array<bigint>)")
    docs = docs.withColumn("_windows", F.when(n >= WIDTH, F.transform(F.sequence(F.lit(0), n - WIDTH), window)).otherwise(empty))
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.array_sort(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    docs = docs.withColumn("_sorted", F.when(some, pairs))
    same = lambda a, b: F.coalesce(at("_sorted", a)["w"] == at("_sorted", b)["w"], F.lit(False))
    twice = F.filter("_sorted", lambda x, k: same(k, k - 1) | same(k, k + 1))
    docs = docs.withColumn("_starts", F.when(F.col("_sorted").isNotNull(), F.array_sort(F.transform(twice, lambda x: x["i"]))))
    # a window covers its words up to the start of the next one
    covered = F.aggregate(
        F.transform("_starts", lambda p, k: F.coalesce(F.least(at("_starts", k + 1) - p, F.lit(WIDTH)), F.lit(WIDTH))), F.lit(0).cast("bigint"), lambda total, x: total + x
    )
    return docs.withColumn(name, F.coalesce(covered, F.lit(0).cast("bigint"))).drop("_hash", "_windows", "_sorted", "_starts")


def measures(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Counts of each document, without its text."""
    rows = docs.select(
        F.col(id_col).alias("doc"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    rows = rows.select("*", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"))
    rows = rows.select(
        "doc", "lang", "source", "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("text", BLANK, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
    )
    return repeated_words(rows, "words", "n_repeat_words").drop("words")


def rates() -> dict[str, Column]:
    per = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    return {name: per(*parts) for name, parts in COUNTS.items()} | {"mean_word": per("word_chars", "n_words")}


def summaries(rows: DataFrame, accuracy: int = ACCURACY) -> DataFrame:
    """Rows, quartiles of every rate and the median length per language and source, per language, and over all rows."""
    quartiles = [F.percentile_approx(r, [0.25, 0.75], accuracy).alias(r) for r in RATES]
    length = F.percentile_approx("n_words", 0.5, accuracy).cast("double").alias("median_words")
    grouped = rows.groupingSets([["lang", "source"], ["lang"], []], "lang", "source")
    out = grouped.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), length, *quartiles)
    values = F.array("median_words", *[F.col(r)[k] for r in RATES for k in (0, 1)])
    return out.select("level", "lang", "source", "n", values.alias("values"))


def _drawn(n: Column, own: Column, wider: Column) -> Column:
    """A group's values with ``PRIOR`` rows' worth of the wider group's; these alone for a group without rows."""
    mixed = F.zip_with(own, wider, lambda x, y: (n * x + PRIOR * y) / (n + PRIOR))
    return F.coalesce(mixed, wider)


def inside(values: Column, spread: float) -> Column:
    """Whether a row lies within the fences of its group's ``values``."""
    low_high = {r: (values[1 + 2 * k], values[2 + 2 * k]) for k, r in enumerate(RATES)}
    good = F.lit(True)
    for rate, (count, size) in COUNTS.items():
        low, high = low_high[rate]
        expected = F.col(size) * (high + spread * (high - low))
        good = good & (F.col(count) <= expected + spread * F.sqrt(expected) + spread)
    low, high = low_high["mean_word"]
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    reach = spread * ((high - low) * F.greatest(F.lit(1.0), F.sqrt(values[0] / words)) + 1.0 / F.sqrt(words))
    return good & (F.col("mean_word") >= low - reach) & (F.col("mean_word") <= high + reach)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", spread: float = SPREAD
) -> DataFrame:
    """One row per document with its counts, ``base_failed`` and ``kept``.

    A NULL text has no words and fails. NULL languages and sources form groups
    of their own. Repeated rows are judged alike; an empty table gives no rows.
    Other columns are not read, whatever their names. Fences are drawn from rows
    that pass the base rules.
    """
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = measures(docs, id_col, text_col, lang_col, source_col).withColumn("base_failed", base).withColumns(rates())
    rows = cut_lineage(rows)
    found = cut_lineage(summaries(rows.where(~F.col("base_failed"))))
    named = lambda level, out: found.where(F.col("level") == level).select(F.col("lang").alias(f"{out}_lang"), F.col("source").alias(f"{out}_source"), F.struct("n", "values").alias(out))
    own, of_lang, of_all = named(0, "own"), named(1, "wide").drop("wide_source"), named(3, "every").select("every")
    out = rows.join(own, F.col("lang").eqNullSafe(F.col("own_lang")) & F.col("source").eqNullSafe(F.col("own_source")), "left")
    out = out.join(of_lang, F.col("lang").eqNullSafe(F.col("wide_lang")), "left")
    out = out.withColumn("every", F.lit(of_all.select("every.values").scalar()))
    out = out.withColumn("wide", _drawn(F.col("wide.n"), F.col("wide.values"), F.col("every")))
    out = out.withColumn("fence", _drawn(F.col("own.n"), F.col("own.values"), F.col("wide")))
    good = F.coalesce(inside(F.col("fence"), spread), F.lit(False))
    return out.select(
        F.col("doc").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & good).alias("kept")
    )
