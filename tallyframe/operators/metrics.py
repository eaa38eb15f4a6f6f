"""Accuracy cubes: row, per-video and bucket averages over any slice.

All slices come from one pre-aggregate with the video in its key, so distinct
videos and the mean of per-video means stay exact while the scan and the wide
shuffle happen once. Grouping sets run over that aggregate, not over rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import text
from tallyframe.functions.numbers import wilson
from tallyframe.operators.scale import weighted_quantiles
from tallyframe.taxonomy import GROUPS, LEAVES

POINT = ("rows", "videos", "correct", "micro_accuracy", "video_macro_accuracy")


def video_cells(
    df: DataFrame, dims: Sequence[str], correct: str = "correct", extra: Mapping[str, Column] | None = None
) -> DataFrame:
    """Rows ``n`` and hits ``k`` per (dims, video)."""
    more = [c.alias(a) for a, c in (extra or {}).items()]
    return df.groupBy(*dims, "video").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("int")).alias("k"), *more
    )


def point_columns() -> list[Column]:
    """Aggregates over cells that hold one row per (slice, video)."""
    return [
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("videos"),
        F.sum("k").alias("correct"),
        (F.sum("k") / F.sum("n")).alias("micro_accuracy"),
        F.avg(F.col("k") / F.col("n")).alias("video_macro_accuracy"),
    ]


def metrics_of(cells: DataFrame, keys: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Point metrics per ``keys`` from finer cells."""
    per_video = cells.groupBy(*keys, "video").agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), *[F.sum(s).alias(s) for s in sums]
    )
    return per_video.groupBy(*keys).agg(*point_columns(), *[F.sum(s).alias(s) for s in sums])


def point_metrics(df: DataFrame, keys: Sequence[str], correct: str = "correct") -> DataFrame:
    """Point metrics per ``keys`` straight from rows."""
    return video_cells(df, keys, correct).groupBy(*keys).agg(*point_columns())


def stacked_slices(cells: DataFrame, keys: Sequence[str], slices: Mapping[str, Column]) -> DataFrame:
    """``level, name`` rows of several one-dimension slices, from one expansion of the cells."""
    tags = F.array(
        *[F.struct(F.lit(lv).alias("level"), c.cast("string").alias("name")) for lv, c in slices.items()]
    )
    long = cells.select(*keys, "video", "n", "k", F.inline(tags))
    return metrics_of(long, [*keys, "level", "name"])


def _shares(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    total = F.sum("rows").over(Window.partitionBy(*keys))
    return df.withColumn("row_share", F.col("rows") / total)


def filled(metrics: DataFrame, keys: Sequence[str], entries: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """Every entry of a fixed taxonomy for every key, zeros and NULLs where empty."""
    scaffold = metrics.select(*keys).distinct().select(
        *keys,
        F.inline(
            F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(e, names)]) for e in entries])
        ),
    )
    out = scaffold.join(metrics, [*keys, *names], "left")
    return out.fillna(0, subset=["rows", "videos", "correct"])


def overall(df: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Point metrics with counts of flags and failures."""
    flags = {
        "clinical_rows": F.count_if("clinical"),
        "ood_rows": F.count_if("ood"),
        "timed_out_rows": F.count_if("timed_out"),
        "error_rows": F.count_if(F.length(F.coalesce("error", F.lit(""))) > 0),
        "empty_output_rows": F.count_if(text.is_blank(F.col("raw_model_output"))),
    }
    return metrics_of(video_cells(df, keys, extra=flags), keys, list(flags))


def by_group(cells: DataFrame) -> DataFrame:
    """All five capability groups per dataset, with their share of rows."""
    metrics = _shares(metrics_of(cells, ["dataset", "group_code"]), ["dataset"])
    out = filled(metrics, ["dataset"], [(c,) for c, _ in GROUPS], ["group_code"])
    return out.fillna(0.0, subset=["row_share"])


def by_leaf(cells: DataFrame) -> DataFrame:
    """All fifteen leaves per dataset, with their share of rows."""
    metrics = _shares(metrics_of(cells, ["dataset", "capability_code"]), ["dataset"])
    out = filled(metrics, ["dataset"], [(c,) for c, _ in LEAVES], ["capability_code"])
    return out.fillna(0.0, subset=["row_share"])


def by_format(cells: DataFrame) -> DataFrame:
    """Every answer format seen in any dataset, for every dataset."""
    metrics = _shares(metrics_of(cells, ["dataset", "answer_format"]), ["dataset"])
    # formats are a fixed few, so each dataset's row lists them all
    seen = metrics.agg(F.collect_set("answer_format")).scalar()
    scaffold = metrics.select("dataset").distinct().withColumn("formats", seen).select("dataset", F.explode("formats").alias("answer_format"))
    out = scaffold.join(metrics, ["dataset", "answer_format"], "left")
    return out.fillna(0, subset=["rows", "videos", "correct"]).fillna(0.0, subset=["row_share"])


def by_leaf_and_format(cells: DataFrame) -> DataFrame:
    return metrics_of(cells, ["dataset", "capability_code", "answer_format"])


def by_secondary(df: DataFrame) -> DataFrame:
    """All leaves as secondary tags; a row counts once under each of its tags."""
    tagged = df.select(
        "dataset", "video", "correct", F.explode("secondary_capabilities").alias("capability_code")
    )
    metrics = metrics_of(video_cells(tagged, ["dataset", "capability_code"]), ["dataset", "capability_code"])
    return filled(metrics, ["dataset"], [(c,) for c, _ in LEAVES], ["capability_code"])


def by_flag(cells: DataFrame) -> DataFrame:
    """Generation, clinical and out-of-distribution slices in one long table."""
    return stacked_slices(
        cells,
        ["dataset"],
        {"generation": F.col("generation"), "clinical": F.col("clinical"), "ood": F.col("ood")},
    )


def by_video(cells: DataFrame) -> DataFrame:
    per = cells.groupBy("dataset", "video").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    return per.select(
        "dataset",
        "video",
        F.col("n").alias("rows"),
        F.lit(1).cast("bigint").alias("videos"),
        F.col("k").alias("correct"),
        (F.col("k") / F.col("n")).alias("micro_accuracy"),
        (F.col("k") / F.col("n")).alias("video_macro_accuracy"),
    )


def rescore_summary(df: DataFrame, old: str = "correct", new: str = "correct_new") -> DataFrame:
    """Old and new accuracy over all, format, leaf, ood and clinical slices."""
    base = df.groupBy("dataset", "answer_format", "capability_code", "ood", "clinical").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(old).cast("int")).alias("old"),
        F.sum(F.col(new).cast("int")).alias("new"),
    )
    out = df.sparkSession.sql(
        """
        SELECT dataset,
               CASE grouping_id()
                 WHEN 15 THEN 'overall' WHEN 7 THEN 'answer_format' WHEN 11 THEN 'primary'
                 WHEN 13 THEN 'ood' ELSE 'clinical' END AS level,
               coalesce(answer_format, capability_code, cast(ood AS string),
                        cast(clinical AS string), 'MEAN') AS name,
               sum(n) AS count, sum(old) / sum(n) AS acc_old, sum(new) / sum(n) AS acc_new
        FROM {cells}
        GROUP BY dataset, answer_format, capability_code, ood, clinical
          GROUPING SETS ((dataset), (dataset, answer_format), (dataset, capability_code),
                         (dataset, ood), (dataset, clinical))
        """,
        cells=base,
    )
    return out.withColumn("delta", F.col("acc_new") - F.col("acc_old"))


def latency_profile(df: DataFrame, limits: Sequence[int] = (5, 15, 30)) -> DataFrame:
    """Mean, exact median and p95, maximum and over-limit counts per scope.

    Equal latencies are merged before the scopes expand and before any sort.
    """
    dims = ["dataset", "group_code", "capability_code", "answer_format"]
    counted = df.groupBy(*dims, "latency_sec").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("timed_out").alias("late")
    )
    scopes = F.array(
        *[
            F.struct(F.lit(s).alias("scope"), c.alias("name"))
            for s, c in (
                ("dataset", F.lit("all")),
                ("group", F.col("group_code")),
                ("leaf", F.col("capability_code")),
                ("answer_format", F.col("answer_format")),
            )
        ]
    )
    keys = ["dataset", "scope", "name"]
    values = (
        counted.select("dataset", "latency_sec", "n", "late", F.inline(scopes))
        .groupBy(*keys, "latency_sec")
        .agg(F.sum("n").alias("n"), F.sum("late").alias("late"))
    )
    x, known = F.col("latency_sec"), F.col("latency_sec").isNotNull()
    over = [
        F.coalesce(F.sum(F.when(x > s, F.col("n"))), F.lit(0)).alias(f"over_{s}_sec_rows") for s in limits
    ]
    simple = values.groupBy(*keys).agg(
        F.sum("n").alias("rows"),
        (F.sum(x * F.col("n")) / F.sum(F.when(known, F.col("n")))).alias("mean_latency_sec"),
        F.max(x).alias("max_latency_sec"),
        *over,
        F.sum("late").alias("timed_out_rows"),
    )
    spread = weighted_quantiles(
        values, keys, "latency_sec", "n", {"median_latency_sec": 0.5, "p95_latency_sec": 0.95}
    )
    return simple.join(spread, keys, "left")


def bucket_cells(cells: DataFrame, keys: Sequence[str] = (), axis: str = "dataset") -> DataFrame:
    """Populated (group x axis) buckets with size, accuracy and Wilson interval."""
    out = cells.groupBy(*keys, "group_code", axis).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return out.select(
        *keys,
        "group_code",
        axis,
        "n",
        (F.col("k") / F.col("n")).alias("accuracy"),
        low.alias("ci_low"),
        high.alias("ci_high"),
    )


def bucket_macro(cells: DataFrame, keys: Sequence[str] = (), axis: str = "dataset") -> DataFrame:
    """Unweighted mean over populated buckets."""
    return bucket_cells(cells, keys, axis).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("buckets"), F.avg("accuracy").alias("bucket_macro")
    )


def three_views(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row, per-video and bucket averages side by side, with the worst bucket.

    A video is counted under its dataset, so equal video names do not merge.
    """
    named = cells.withColumn("video", F.struct("dataset", "video"))
    points = metrics_of(named, keys).select(*keys, "rows", "micro_accuracy", "video_macro_accuracy")
    buckets = bucket_cells(cells, keys)
    cell = F.concat_ws("/", "group_code", "dataset")
    best = buckets.groupBy(*keys).agg(
        F.avg("accuracy").alias("bucket_macro"),
        F.min(F.struct("accuracy", cell.alias("cell"))).alias("worst"),
    )
    return points.join(best, list(keys)).select(
        *keys,
        "rows",
        "micro_accuracy",
        "video_macro_accuracy",
        "bucket_macro",
        F.col("worst.cell").alias("worst_cell"),
        F.col("worst.accuracy").alias("worst_accuracy"),
    )


def majority_vote(judgements: DataFrame, keys: Sequence[str], vote: str = "vote") -> DataFrame:
    """Verdict of several judges: right when more than half say so."""
    return judgements.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("judges"),
        F.sum(F.col(vote).cast("int")).alias("votes"),
        (F.sum(F.col(vote).cast("int")) * 2 > F.count(F.lit(1))).cast("int").alias("correct"),
    )


def accuracy_by_condition(df: DataFrame, condition: str, selection: str, slices: str = "answer_format") -> DataFrame:
    """Rows, hits and accuracy per condition and selection group, for each slice and for ``all``."""
    sums = df.groupBy(condition, selection, slices).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("int")).alias("k"))
    out = sums.groupingSets([[condition, selection, slices], [condition, selection]], condition, selection, slices).agg(
        F.sum("n").alias("count"), F.sum("k").alias("correct"), (F.sum("k") / F.sum("n")).alias("accuracy"), F.grouping(slices).alias("_every")
    )
    return out.withColumn(slices, F.when(F.col("_every") == 1, F.lit("all")).otherwise(F.col(slices))).drop("_every")
