"""Integrity checks as tables of named counts or violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.functions.labels import counting_question
from tallyframe.operators.joins import coverage_gaps
from tallyframe.taxonomy import CLASS_NAMES, LEAVES

MAX_CONTENT = 300


def completeness(rows: DataFrame, universe: DataFrame, keys: Sequence[str], by: str = "dataset") -> DataFrame:
    """Rows, distinct ids, expected ids, missing and extra ids per dataset."""
    per_key = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("_have", F.lit(1))
    want = universe.select(*keys).distinct().withColumn("_want", F.lit(1))
    both = per_key.join(want, list(keys), "full")
    return both.groupBy(by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("_have").alias("distinct_ids"),
        F.count("_want").alias("expected_ids"),
        F.count_if(F.col("_have").isNull()).alias("missing"),
        F.count_if(F.col("_want").isNull()).alias("extra"),
        F.count_if(F.col("n") > 1).alias("duplicated"),
    )


def gap_examples(rows: DataFrame, universe: DataFrame, keys: Sequence[str], show: int = 5) -> DataFrame:
    """The first missing and extra ids."""
    gaps = coverage_gaps(universe, rows, keys)
    parts = [
        gaps.where(F.col("side") == s).orderBy(*keys).limit(show) for s in ("missing", "extra")
    ]
    return parts[0].unionByName(parts[1])


def column_pairs(df: DataFrame, pairs: Mapping[str, tuple[str, str]], keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Mismatches of column pairs that must agree, NULL equal to NULL; long form."""
    aggs = [F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(name) for name, (a, b) in pairs.items()]
    return _long(df.groupBy(*keys).agg(*aggs), keys, list(pairs))


def close_pairs(df: DataFrame, a: str, b: str, name: str, tolerance: float = 1e-9, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Rows in which two numbers differ by more than the tolerance."""
    far = ~F.coalesce(F.abs(F.col(a) - F.col(b)) <= tolerance, F.lit(False))
    return _long(df.groupBy(*keys).agg(F.count_if(far).alias(name)), keys, [name])


def _long(wide: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    each = F.array(
        *[F.struct(F.lit(n).alias("check"), F.col(n).cast("bigint").alias("offenders")) for n in names]
    )
    return wide.select(*keys, F.inline(each))


def run_health(df: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Errors, empty outputs and timeouts."""
    aggs = {
        "errors": F.count_if(F.length(F.coalesce("error", F.lit(""))) > 0),
        "empty_outputs": F.count_if(text.is_blank(F.col("raw_model_output"))),
        "timeouts": F.count_if(F.coalesce("timed_out", F.lit(False))),
    }
    return _long(df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), keys, list(aggs))


def unknown_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values outside a taxonomy, with their row counts; must be empty."""
    return (
        df.where(F.col(column).isNull() | ~F.col(column).isin(*allowed))
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def unknown_capabilities(df: DataFrame, column: str = "capability_code") -> DataFrame:
    return unknown_values(df, column, [code for code, _ in LEAVES])


def invalid_timestamps(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Timestamps that do not parse, per column."""
    aggs = [
        F.count_if(F.col(c).isNotNull() & text.stamp_seconds(F.col(c)).isNull()).alias(c) for c in columns
    ]
    return _long(df.groupBy(*keys).agg(*aggs), keys, list(columns))


def unexpected_tracks(df: DataFrame, track: str) -> DataFrame:
    return unknown_values(df.where(F.col("track").isNotNull()).withColumn("track", F.lower("track")), "track", [track])


def answer_contract(
    requests: DataFrame, answers: DataFrame, require_text: bool = True, key: str = "qID"
) -> DataFrame:
    """Violations of the request/answer contract, one row per id and rule."""
    want = requests.groupBy(key).agg(F.count(F.lit(1)).alias("_asked"))
    have = answers.groupBy(key).agg(
        F.count(F.lit(1)).alias("_given"),
        F.bool_or(F.col("content").isNull()).alias("_null"),
        F.bool_or(F.trim("content") == "").alias("_blank"),
        F.max(F.length(F.trim("content"))).alias("_length"),
        F.bool_or(
            F.col("latency").isNull() | F.isnan("latency") | (F.col("latency") < 0) | (F.col("latency") == float("inf"))
        ).alias("_latency"),
    )
    both = want.join(have, key, "full")
    rules = {
        "missing_answer": F.col("_given").isNull(),
        "unknown_id": F.col("_asked").isNull(),
        "repeated_id": F.col("_given") > 1,
        "invalid_id": F.coalesce(F.col(key).cast("string"), F.lit("")) == "",
        "content_not_text": F.col("_null"),
        "content_empty": F.col("_blank") if require_text else F.lit(False),
        "content_too_long": F.col("_length") > MAX_CONTENT,
        "invalid_latency": F.col("_latency"),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()]))
    return both.select(key, F.explode(broken).alias("rule"))


def settings_conflicts(meta: DataFrame, group: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """Settings that differ between runs of one group.

    ``meta`` holds one JSON document per run in ``settings``.
    """
    pairs = meta.select(
        *group, F.explode(F.from_json("settings", "map<string,string>")).alias("key", "value")
    ).where(F.col("key").isin(*wanted))
    return (
        pairs.groupBy(*group, "key")
        .agg(
            F.count_distinct("value").alias("values"),
            F.min("value").alias("lowest"),
            F.max("value").alias("highest"),
        )
        .where(F.col("values") > 1)
    )


def unexpected_settings(meta: DataFrame, run: str, expected: DataFrame) -> DataFrame:
    """Runs whose setting differs from an expected ``key, value`` table, or lacks it.

    Settings meet expectations on their key; only missing keys are found per
    run, against the list of expected keys, which is as short as that table.
    """
    wanted = expected.select("key", F.col("value").alias("expected"))
    docs = meta.select(run, F.from_json("settings", "map<string,string>").alias("doc"))
    found = docs.select(run, F.explode("doc").alias("key", "actual"))
    keys = docs.withColumn("keys", expected.agg(F.collect_set("key")).scalar())
    absent = F.array_except("keys", F.coalesce(F.map_keys("doc"), F.array().cast("array<string>")))
    missing = keys.select(run, F.explode(absent).alias("key"), F.lit(None).cast("string").alias("actual"))
    rows = found.unionByName(missing).join(wanted, "key")
    return rows.where(~F.col("expected").eqNullSafe(F.col("actual"))).select(run, "key", "expected", "actual")


def rerun_audit(df: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Rows that were not changed but were judged differently the second time."""
    first, second = F.col("first_correct") == 1, F.col("second_correct") == 1
    same = df.where(~F.col("changed"))
    return same.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unchanged_rows"),
        F.count_if(first != second).alias("judge_mismatches"),
        F.count_if(first & ~second).alias("first_only_correct"),
        F.count_if(~first & second).alias("rerun_only_correct"),
    )


def prompt_contract(df: DataFrame, wording: Mapping[str, str], keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Whether every prompt of a format holds its required wording."""
    needed = F.lit(None).cast("string")
    for fmt, words in wording.items():
        needed = F.when(F.col("answer_format") == fmt, F.lit(words)).otherwise(needed)
    rows = df.withColumn("_words", needed).where(F.col("_words").isNotNull())
    holds = F.contains(F.coalesce("prompt", F.lit("")), F.col("_words"))
    return rows.groupBy(*keys, "answer_format").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~holds).alias("offenders"),
        F.bool_and(holds).cast("int").alias("ok"),
    )


REPLACEMENT_COLUMNS = ("sample_id", "question", "answer_format", "prompt_strategy", "prediction")


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def replacement_violations(
    df: DataFrame, strategy: str = "bbox-json", names: Sequence[str] = CLASS_NAMES
) -> DataFrame:
    """Replacement rows of another strategy, or that do not ask for a count."""
    lacking = missing_columns(df, REPLACEMENT_COLUMNS)
    if lacking:
        raise ValueError(f"replacement predictions missing columns: {lacking}")
    asked = counting_question(F.col("question"), F.col("answer_format"), names)
    rules = {
        "other_strategy": ~F.col("prompt_strategy").eqNullSafe(F.lit(strategy)),
        "not_a_count": asked.isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))
    return df.select("sample_id", F.explode(broken).alias("rule"))


def failed(checks: DataFrame, offenders: Column | None = None) -> DataFrame:
    """Checks with at least one offender."""
    return checks.where((offenders if offenders is not None else F.col("offenders")) > 0)
