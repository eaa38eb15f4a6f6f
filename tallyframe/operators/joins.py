"""Joins with a declared contract: cardinality, coverage, upsert, lookup, overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A join or table broke its declared contract."""


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def require_none(df: DataFrame, message: str, show: int = 5) -> None:
    """Fail with a few offenders when ``df`` has any row."""
    offenders = df.limit(show).collect()
    if offenders:
        raise ContractError(f"{message}: {[tuple(r) for r in offenders]}")


def _held(df: DataFrame, broken: Column, message: str, keys: Sequence[str]) -> DataFrame:
    """Rows pass unless one is broken, which ends the job that reads them; no job of its own runs."""
    shown = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    stop = F.raise_error(F.concat(F.lit(f"{message}: "), shown)).cast("boolean")
    return df.where(F.when(broken, stop).otherwise(F.lit(True)))


def unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """The rows of ``df``, keys first; the job fails if a key occurs twice.

    Counting groups by the keys, which is the partitioning that a join on them needs.
    """
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(F.lit(0).alias("_"), *rest)).alias("_row"))
    return _held(one, F.col("_n") > 1, f"{what}: duplicate key", keys).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def one_to_one(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", check: bool = True
) -> DataFrame:
    """Join of two tables that are both unique on ``keys``; the job that reads it fails if they are not."""
    if check:
        left, right = unique(left, keys, "left side"), unique(right, keys, "right side")
    return left.join(right, list(keys), how)


def covered(left: DataFrame, right: DataFrame, keys: Sequence[str], what: str = "left row") -> DataFrame:
    """Left join in which every left row must find its match, or the job that reads it fails."""
    joined = left.join(right.withColumn("_hit", F.lit(True)), list(keys), "left")
    return _held(joined, F.col("_hit").isNull(), f"{what} without a match", keys).drop("_hit")


def coverage_gaps(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, tagged ``missing`` (left only) or ``extra`` (right only)."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, list(keys), "full").where(F.col("_l").isNull() | F.col("_r").isNull())
    return both.select(*keys, F.when(F.col("_l").isNull(), "extra").otherwise("missing").alias("side"))


def same_ids(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> bool:
    return coverage_gaps(left, right, keys).isEmpty()


def suffixed(left: DataFrame, right: DataFrame, keys: Sequence[str], tags: tuple[str, str], how: str = "full") -> DataFrame:
    """Join with all other columns renamed by side."""
    def rename(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(f"{c}_{tag}") for c in df.columns if c not in keys])

    return rename(left, tags[0]).join(rename(right, tags[1]), list(keys), how)


AUDITED = ("model_name", "prompt", "raw_model_output", "prediction", "latency_sec")
DEFAULTS = {
    "prompt_strategy": ("direct", "string"),
    "counting_mode": ("", "string"),
    "counting_target": ("", "string"),
    "structured_output_valid": (None, "boolean"),
    "structured_output_status": ("", "string"),
    "detected_objects": ("", "string"),
    "derived_count": (None, "int"),
}


def replace_by_id(
    baseline: DataFrame,
    replacements: DataFrame,
    keys: Sequence[str],
    model_name: str,
    audited: Sequence[str] = AUDITED,
) -> DataFrame:
    """Baseline rows overwritten by replacement rows of the same id.

    Keeps every baseline row, its audited columns under ``baseline_*`` and a
    ``changed_by_prompt`` flag. Columns only replacements have get a default.
    Row order travels in an explicit ordinal column of the baseline, if any.
    """
    new = [c for c in replacements.columns if c not in keys]
    right = replacements.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new], F.lit(True).alias("_hit"))
    joined = baseline.join(right, list(keys), "left")
    changed = F.coalesce("_hit", F.lit(False))

    def merged(column: str) -> Column:
        if column not in new:
            return F.col(column)
        if column in baseline.columns:
            old = F.col(column)
        else:
            value, kind = DEFAULTS.get(column, (None, replacements.schema[column].dataType.simpleString()))
            old = F.lit(value).cast(kind)
        return F.when(changed, F.col(f"_new_{column}")).otherwise(old)

    columns = [*baseline.columns, *[c for c in new if c not in baseline.columns]]
    return joined.select(
        *keys,
        *[
            (F.lit(model_name) if c == "model_name" else merged(c)).alias(c)
            for c in columns
            if c not in keys
        ],
        *[F.col(c).alias(f"baseline_{c}") for c in audited if c in baseline.columns],
        changed.alias("changed_by_prompt"),
    )


def unknown_replacements(baseline: DataFrame, replacements: DataFrame, keys: Sequence[str]) -> DataFrame:
    return replacements.join(baseline, list(keys), "left_anti").select(*keys)


def substitute(df: DataFrame, changed: Column, new: Column, old: Column, name: str) -> DataFrame:
    """Take the new value only where the row was changed."""
    return df.withColumn(name, F.when(changed, new).otherwise(old))


def salted_lookup(
    facts: DataFrame, dimension: DataFrame, keys: Sequence[str], hot_rows: int = 1_000_000, how: str = "inner"
) -> DataFrame:
    """Lookup that stays balanced when one key holds a large share of the facts.

    Facts of a key with more than ``hot_rows`` rows are spread over as many parts as it
    has times that number, and only such a key's row of the dimension is repeated,
    once per part. There are at most rows / ``hot_rows`` hot keys, a table that every
    task gets. The spread follows the row content, so a re-run task places its rows
    the same way.
    """
    hot = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    spread = facts.join(hot, list(keys), "left").withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), parts).cast("int")).drop("_parts")
    repeated = dimension.join(hot, list(keys), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")


def best_overlap(ids: DataFrame, universes: DataFrame, run: Sequence[str] = ("run",)) -> DataFrame:
    """Split whose id set overlaps the ids of a run most; a tie goes to the first name."""
    hits = (
        ids.join(universes, ["dataset", "qid"])
        .groupBy(*run, "split")
        .agg(F.count_distinct("dataset", "qid").alias("overlap"))
    )
    ranked = hits.groupBy(*run).agg(F.min(F.struct((-F.col("overlap")).alias("o"), "split")).alias("b"))
    return ranked.select(*run, F.col("b.split").alias("split"), (-F.col("b.o")).alias("overlap"))


def first_available(
    wanted: DataFrame, dense: DataFrame, sparse: DataFrame, keys: Sequence[str], value: str
) -> DataFrame:
    """Prefer the dense grid, then the sparse one; ``source`` names which."""
    a = dense.select(*keys, F.col(value).alias("_dense"))
    b = sparse.select(*keys, F.col(value).alias("_sparse"))
    out = wanted.join(a, list(keys), "left").join(b, list(keys), "left")
    return out.select(
        *wanted.columns,
        F.coalesce("_dense", "_sparse").alias(value),
        F.when(F.col("_dense").isNotNull(), "dense").when(F.col("_sparse").isNotNull(), "sparse").otherwise("none").alias("source"),
    )
