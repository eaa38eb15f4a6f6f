"""Ranks, running sums and exact quantiles that never put a whole group in one task.

A window over a hot key sorts all its rows in one task. The helpers here split
each group into buckets that follow the sort order: bucket totals are small, so
their running sum is cheap, and the rows are only sorted inside a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.session import cut_lineage


def spread(scan: DataFrame, *columns: str) -> DataFrame:
    """Deal rows of costly texts out where their files cannot be split into a task per core.

    ``scan`` reads files and shuffles nothing, so its number of splits is known
    without running it. With as many splits as cores, as large inputs have, the
    rows stay where they are; how many partitions there are else is left to adaptive
    execution. Only the placement depends on it, never the result.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(*columns)


ROWS_A_TASK = 1_000_000


def dealt(keys: Sequence[str], rows: int, *tables: DataFrame) -> list[DataFrame]:
    """Tables dealt by ``keys`` to tasks of about a million of ``rows``.

    Where the session's shuffles have as many tasks, the tables stay as they are; so a
    task's memory is bounded on large inputs whatever the session says.
    """
    tasks = math.ceil(rows / ROWS_A_TASK)
    if tasks <= int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return list(tables)
    return [t.repartition(tasks, *keys) for t in tables]


def value_bucket(x: Column, per_octave: int = 256) -> Column:
    """A bucket number that grows with ``x``; their count depends on the range only."""
    return (F.signum(x) * F.floor(F.log2(1.0 + F.abs(x)) * per_octave)).cast("bigint")


def hash_bucket(digest: Column, digits: int = 3) -> Column:
    """Bucket of a hex digest, in digest order."""
    return F.substring(digest, 1, digits)


def _bucket_offsets(df: DataFrame, keys: Sequence[str], weight: Column) -> DataFrame:
    totals = df.groupBy(*keys, "_bucket").agg(F.sum(weight).alias("_size"))
    running = Window.partitionBy(*keys).orderBy("_bucket")
    before = running.rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys,
        "_bucket",
        "_size",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias("_total"),
    )


def _with_group(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])


def grouped_rank(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    name: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """``row_number`` in each group, for groups of any size.

    ``bucket`` must rise along ``order``: rows of a smaller bucket come first.
    """
    base, by = _with_group(df.withColumn("_bucket", bucket), keys)
    offsets = _bucket_offsets(base, by, F.lit(1))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    joined = base.join(offsets, [*by, "_bucket"])
    out = joined.withColumn(name, (F.col("_before") + F.row_number().over(inside)).cast("bigint"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_bucket", "_size", "_before", "_total", "_all")


def range_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "rank",
    total: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """``row_number`` in each group for any size and any spread of keys, without buckets.

    Rows are dealt to ranges of (keys, order) at sampled split points, sorted there and
    written once. A row's place in its range is the running number that Spark gives
    it, and a group's place at the begin of a range follows from the ranges' counts, a
    row per range and group. Ranges that begin behind ``limit`` are not read again. A
    NULL key is a group of its own.
    """
    base, by = _with_group(df, keys)
    sorted_ = base.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = cut_lineage(sorted_.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy("_range", *by).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("_range").alias("_begin"),
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)],
        (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.sum("_size").over(group).alias("_total"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
    )
    if limit is not None:
        starts = starts.where(F.col("_before") < limit)
    same = F.col("_range") == F.col("_begin")
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = placed.join(starts, same).withColumn(name, (F.col("_at") + F.col("_shift")).cast("bigint"))
    if limit is not None:
        out = out.where(F.col(name) <= limit)
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_at", "_range", "_begin", "_shift", "_total", "_before", "_all", *[f"_k{i}" for i in range(len(by))])


def first_by_hash(df: DataFrame, keys: Sequence[str], digest: Column, limit: int) -> DataFrame:
    """The ``limit`` rows of each group with the smallest digest.

    The limit is a constant, so every task cuts its groups before the shuffle.
    """
    tagged = df.withColumn("_digest", digest)
    if not keys:
        return tagged.orderBy("_digest").limit(limit).drop("_digest")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_digest"))
    return tagged.withColumn("_place", place).where(F.col("_place") <= limit).drop("_digest", "_place")


def grouped_running(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, before: str = "before"
) -> DataFrame:
    """Weight of all smaller values in the group, next to each distinct value.

    Input must hold one row per (keys, value).
    """
    base, by = _with_group(df.withColumn("_bucket", value_bucket(F.col(value))), keys)
    offsets = _bucket_offsets(base, by, F.col(weight))
    inside = (
        Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    out = base.join(offsets, [*by, "_bucket"]).withColumn(
        before, F.col("_before") + F.coalesce(F.sum(weight).over(inside), F.lit(0))
    )
    return out.drop("_bucket", "_size", "_before", "_total", "_all")


def weighted_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, quantiles: Mapping[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group with any value.

    Input holds one row per (keys, value) with its row count in ``weight``.
    Only the buckets in which a wanted rank falls are sorted. NULL values weigh
    nothing; they are not filtered, as that filter would be pushed into the
    input and compute its value expressions a second time.
    """
    known = F.col(value).isNotNull()
    base, by = _with_group(df.withColumn("_w", F.when(known, F.col(weight)).otherwise(0)), keys)
    bucket = F.coalesce(value_bucket(F.col(value).cast("double")), F.lit(-(2**62)))
    base = base.withColumn("_bucket", bucket)
    offsets = _bucket_offsets(base, by, F.col("_w"))

    def place(q: float) -> Column:
        return F.lit(float(q)) * (F.col("_total") - 1)

    wanted = [f(place(q)).cast("bigint") for q in quantiles.values() for f in (F.floor, F.ceil)]
    hit = F.lit(False)
    for rank in wanted:
        hit = hit | ((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_size")))
    inside = (
        Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = (
        base.join(offsets.where(hit), [*by, "_bucket"])
        .withColumn("_from", F.col("_before") + F.coalesce(F.sum("_w").over(inside), F.lit(0)))
        .withColumn("_to", F.col("_from") + F.col("_w"))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col(value)).cast("double"))

    picks = []
    for name, q in quantiles.items():
        picks += [
            at(F.floor(place(q)).cast("bigint")).alias(f"_lo_{name}"),
            at(F.ceil(place(q)).cast("bigint")).alias(f"_hi_{name}"),
        ]
    out = rows.groupBy(*by).agg(F.max("_total").alias("_total"), *picks)
    final = [
        (
            F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (place(q) - F.floor(place(q)))
        ).alias(n)
        for n, q in quantiles.items()
    ]
    return out.select(*keys, *final)


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float]
) -> DataFrame:
    """Exact quantiles of raw rows."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return weighted_quantiles(counts, keys, value, "_n", wanted)
